"""Secret scan: known forms, and random strings exposed by poor token efficiency.

A byte-pair vocabulary packs ordinary words and identifiers into few tokens; random
strings break into tokens of one or two characters. A candidate is a run of key
characters; its parts between separators are encoded one by one, and it is reported when
consecutive tokens with ``MIN_LENGTH`` characters or more have fewer than
``MAX_CHARS_PER_TOKEN`` characters per token, so words beside a secret do not hide it. Left
out are UUIDs, digests of the usual lengths that no key word leads, and runs without letters (dates, numbers).

The base forms (assignments, access keys, long hex) are always reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary

#: The base forms, each with the group that is measured and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),  # runs are maximal, so shorter ones are skipped by the pattern itself
}
KINDS = ["assign", "access", "hex", "efficiency"]
MIN_LENGTH = 20
MAX_LENGTH = 4096
MAX_CHARS_PER_TOKEN = 2.0
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = {32, 40, 56, 64, 96, 128}

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
_PLAIN = re.compile(r"[0-9_/+=-]*")
_PART = re.compile(r"[A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base forms, leftmost and non-overlapping per kind."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind))
    return out


def _digest(part: str) -> bool:
    return len(part) in DIGESTS and bool(_HEX.fullmatch(part))


def badly_packed(run: str, encode, size) -> bool:
    """Whether consecutive tokens of a run, ``MIN_LENGTH`` characters or more, have too few characters each.

    UUIDs and digests inside the run end a stretch. ``ahead`` is characters minus ``MAX_CHARS_PER_TOKEN`` per token
    so far; it has to fall over a stretch, so the highest value that lies far enough back decides, in one pass.
    """
    for text in _UUID.split(run):
        chars, ahead, high, back = [0], [0.0], float("-inf"), 0
        for m in _PART.finditer(text):
            part = m.group()
            if _digest(part):
                chars, ahead, high, back = [0], [0.0], float("-inf"), 0
                continue
            for i in range(0, len(part), MAX_LENGTH):
                for token in encode(part[i:i + MAX_LENGTH]):
                    n = int(size(token))
                    chars.append(chars[-1] + n)
                    ahead.append(ahead[-1] + n - MAX_CHARS_PER_TOKEN)
                    while chars[-1] - chars[back] >= MIN_LENGTH:
                        high = max(high, ahead[back])
                        back += 1
                    if ahead[-1] < high:
                        return True
    return False


def efficiency_spans(text: str, encode, size=None, taken: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """Runs of key characters that hold a stretch the vocabulary packs badly; ``taken`` spans cut runs.

    ``size`` gives the characters of a token; without it the encoder is asked. A run is encoded in windows, so its length costs nothing.
    """
    size = size or (lambda token: len(encode.__self__.decode_single_token_bytes(token)))
    out = []
    for m in _CANDIDATE.finditer(text):
        at, pieces = m.start(), []
        for start, end, _ in sorted(taken):
            if start < m.end() and at < end:
                pieces.append((at, start))
                at = max(at, end)
        for start, end in [*pieces, (at, m.end())]:
            run = text[start:end]
            if len(run) >= MIN_LENGTH and not _PLAIN.fullmatch(run) and badly_packed(run, encode, size):
                out.append((start, end, "efficiency"))
    return out


def scan_text(text: str, encode, size=None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each ordered by start, then kind as listed; added spans overlap no base span."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + efficiency_spans(text, encode, size, base), key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCAN = "doc_id long, spans array<struct<kind: string, start: int, end: int>>, base_sha256 string"


def scan(docs: DataFrame, vocabulary_path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """Rows (doc_id, spans, base_sha256) for every row of ``docs`` (doc_id, text).

    Spans count code points, ends are exclusive. ``base_sha256`` names the base
    spans, written ``kind:start:end`` and joined by commas. A null text counts as
    empty and has no spans; a null doc_id stays null; repeated rows give repeated
    results; no rows give no rows.
    """
    shared = vocabulary.share(docs.sparkSession, vocabulary_path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = vocabulary.encoder(shared)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            rows, digests = [], []
            for text in batch.column("text"):
                base, spans = scan_text(text.as_py() or "", encoding.encode_ordinary, lengths.__getitem__)
                rows.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.list_(kind)), pa.array(digests, pa.string())],
                                  ["doc_id", "spans", "base_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCAN)
