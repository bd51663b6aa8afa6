"""Token counts of fields and sections by mapping tokens to their offsets.

A document's fields are joined into one text that is encoded once, so the
total is what a model sees. Byte lengths of the tokens give each token's span by
a running sum. Section borders are byte offsets of the same text, and the
sorted token starts are joined to the sorted borders by binary search. A token that
crosses a border belongs, as ``rule`` says, to the section of its first byte
(``start``), of its last byte (``end``), or to the section that holds most of its
bytes (``most``; the earlier one in a tie).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

RULES = ("start", "end", "most")
COUNTS = "doc_id long, section int, field string, start int, end int, n_tokens long, n_crossing long"


def token_ends(tokens: list[int], lengths: np.ndarray) -> np.ndarray:
    """Exclusive end of every token, in bytes."""
    return np.cumsum(lengths[np.asarray(tokens, np.int64)]) if tokens else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses a border). ``borders`` are the exclusive ends of the sections."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    first = np.searchsorted(borders, starts, "right")
    last = np.searchsorted(borders, ends - 1, "right")
    if rule == "start":
        return first, first != last
    if rule == "end":
        return last, first != last
    owner = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[starts[i]], borders[first[i]:last[i]], [ends[i]]])
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return owner, first != last


def line_borders(data: bytes) -> list[int]:
    """Exclusive byte ends of the lines, each with its line feed; an empty text is one empty line."""
    ends = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def count_document(values: list[str | None], names: list[str], encode, lengths: np.ndarray, rule: str) -> list[tuple]:
    """(field, start, end, tokens, crossing) per line of every field; starts and ends are code points inside the field."""
    texts = [v or "" for v in values]
    whole = "\n".join(texts)
    sections, borders, at = [], [], 0
    for i, (name, text) in enumerate(zip(names, texts)):
        data = text.encode()
        done = chars = 0
        for border in line_borders(data):
            n = len(data[done:border].decode())
            sections.append([name, chars, chars + n])
            borders.append(at + border)
            done, chars = border, chars + n
        at += len(data) + 1
        if i + 1 < len(texts):
            borders[-1] += 1  # the line feed between two fields goes to the line in front of it
    owner, crossing = attribute(token_ends(encode(whole), lengths), np.array(borders, np.int64), rule)
    tokens = np.bincount(owner, minlength=len(sections))
    crossed = np.bincount(owner[crossing], minlength=len(sections))
    return [(*s, int(n), int(c)) for s, n, c in zip(sections, tokens, crossed)]


def count_tokens(docs: DataFrame, fields: list[str], rule: str = "start", vocabulary_path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """Rows (doc_id, section, field, start, end, n_tokens, n_crossing), one per line of every field of ``docs``.

    The fields are joined by line feeds, in the order given. The counts of a document add up to
    the tokens of its joined text. A null field counts as empty and is one
    empty section; a null doc_id stays null; repeated rows are counted each; no rows give
    no rows. Texts of any length and runs of white space of any length are encoded. ``n_crossing`` of a section's tokens reach over a border.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = vocabulary.share(docs.sparkSession, vocabulary_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = vocabulary.encoder(shared)
        for batch in batches:
            columns = [batch.column(f"f{i}") for i in range(len(fields))]
            for low in range(0, batch.num_rows, 256):
                part = [c.slice(low, 256).to_pylist() for c in columns]
                rows = []
                for doc, values in zip(batch.column("doc_id").slice(low, 256).to_pylist(), zip(*part)):
                    rows += [(doc, i, *row) for i, row in enumerate(count_document(list(values), fields, lambda t: vocabulary.encode(encoding, t), lengths, rule))]
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing"])

    picked = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *picked).mapInArrow(task, COUNTS)
