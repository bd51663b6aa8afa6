"""Cut positions of long texts, in one pass per separator, with numpy.

The text is never copied while it is cut: pieces are pairs of positions, packing
is a binary search in their summed lengths, and only the finished chunks are
sliced out. The work grows with the text, not with its square.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import fixed, tables

_VISIBLE = re.compile(f"[^{tables.BLANK}]")
_MEANINGLESS = re.compile("[^一-鿿㐀-䶿a-zA-Z0-9]+")


def _finer(text: str, start: int, end: int, mark: str) -> list[tuple[int, int]]:
    """Pieces of one part, each closed by the mark it ends with; blank ones are left out."""
    stops = [m.end() for m in re.finditer(re.escape(mark), text[start:end])]
    if not stops:
        return [(start, end)]
    edges = [start, *(start + s for s in stops), end]
    return [(a, b) for a, b in zip(edges, edges[1:]) if _VISIBLE.search(text, a, b)]


def cut_positions(text: str, max_size: int, separators: list[str] = fixed.SEPARATORS) -> np.ndarray:
    """(start, end) of the fragments, none longer than ``max_size``."""
    spans = [(0, len(text))] if text else []
    for mark in separators:
        spans = [s for a, b in spans for s in ([(a, b)] if b - a <= max_size else _finer(text, a, b, mark))]
    spans = [(i, min(i + max_size, b)) for a, b in spans for i in range(a, b, max_size)]
    return np.array(spans, np.int64).reshape(-1, 2)


def packed(spans: np.ndarray, max_size: int, min_size: int) -> list[tuple[int, int]]:
    """Runs of neighbouring fragments (first, past last) that fill ``max_size``; a short last run joins the one before."""
    total = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])])
    runs, at = [], 0
    while at < len(spans):
        to = int(np.searchsorted(total, total[at] + max_size, "right")) - 1
        runs.append((at, to))
        at = to
    if len(runs) > 1 and total[runs[-1][1]] - total[runs[-1][0]] < min_size:
        runs[-2:] = [(runs[-2][0], runs[-1][1])]
    return runs


def split_text(text: str | None, max_size: int, min_size: int, separators: list[str] = fixed.SEPARATORS) -> list[str]:
    """Chunks of a text, as :func:`operators.chunks.recursive_split` cuts them."""
    spans = cut_positions(text or "", max_size, separators)
    return ["".join(text[a:b] for a, b in spans[i:j].tolist()) for i, j in packed(spans, max_size, min_size)]


def split_batches(max_size: int, min_size: int):
    """A task for ``mapInArrow``: (key, text) rows to (key, pos, chunk) rows, one text after the other."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                chunks = split_text(text.as_py(), max_size, min_size)
                key = batch.column(0).slice(i, 1)
                yield pa.record_batch([key.take(pa.array(np.zeros(len(chunks), np.int64))), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.string())],
                                      ["key", "pos", "chunk"])
    return task


@dataclass
class Piece:
    """A chunk in the making; its text is the parts joined by line feeds."""

    kind: str
    chunk_id: str
    parts: list[str]
    count: int
    html: str | None = None
    rows: int | None = None


def meaningful(text: str) -> int:
    """Han characters, ASCII letters and digits."""
    return len(_MEANINGLESS.sub("", text))


def raw_pieces(parent_id: str, text: str, max_size: int, min_size: int, max_rows: int, keep_blank: bool = False) -> Iterator[Piece]:
    """Tables by rows and texts by separators, numbered by kind, in document order; blank pieces only on demand."""
    number = {"content": 0, "table": 0}
    for kind, body in tables.segments(text):
        name = f"{parent_id}#{'c' if kind == 'content' else 't'}{number[kind]}"
        number[kind] += 1
        if kind == "content":
            chunks = split_text(body, max_size, min_size)
            for j, chunk in enumerate(chunks):
                if keep_blank or _VISIBLE.search(chunk):
                    yield Piece(kind, f"{name}p{j}" if len(chunks) > 1 else name, [chunk], meaningful(chunk))
        else:
            found = tables.parts(body, max_rows)
            for j, (html, shown, _, _, rows) in enumerate(found):
                yield Piece(kind, f"{name}p{j}" if len(found) > 1 else name, [shown], meaningful(shown), html, rows)


def merged(pieces: Iterator[Piece], min_size: int) -> list[Piece]:
    """Short text pieces join the nearest text piece before, else the next one; tables in between are passed over."""
    out: list[Piece] = []
    held = host = None  # a short text without one before it; the last text that was kept
    for piece in pieces:
        if piece.kind == "content":
            if held:
                held.parts.extend(piece.parts)
                piece = Piece("content", piece.chunk_id, held.parts, held.count + piece.count + 1)
                held = None
            if piece.count < min_size:
                if host:
                    host.parts.extend(piece.parts)
                    host.count += piece.count + 1
                else:
                    held = piece
                continue
            host = piece
        out.append(piece)
    return [*out, held] if held else out


def section_chunks(parent_id: str, text: str | None, max_size: int = fixed.CHUNK_MAX, min_size: int = fixed.CHUNK_MIN,
                   max_rows: int = fixed.TABLE_ROWS, keep_blank: bool = False) -> list[Piece]:
    """Chunks of one section in order."""
    return merged(raw_pieces(parent_id, text, max_size, min_size, max_rows, keep_blank), min_size) if text else []


def chunk_batches(max_size: int, min_size: int, max_rows: int, keep_blank: bool = False, rows: int = 2000):
    """A task for ``mapInArrow``: (row, parent_id, text) to chunk rows, some ``rows`` of them at a time."""
    kinds = {"chunk_id": pa.string(), "chunk_pos": pa.int32(), "text": pa.string(), "char_count": pa.int32(), "is_table": pa.bool_(),
             "table_html": pa.string(), "table_rows": pa.int32()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            source: list[int] = []

            def done() -> pa.RecordBatch:
                at = pa.array(source, pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds.values())]
                return pa.record_batch([batch.column("row").take(at), batch.column("parent_id").take(at), *columns], ["row", "parent_id", *kinds])

            for i in range(batch.num_rows):
                for pos, p in enumerate(section_chunks(batch.column("parent_id")[i].as_py(), batch.column("text")[i].as_py(), max_size, min_size, max_rows, keep_blank)):
                    held.append((p.chunk_id, pos, "\n".join(p.parts), p.count, p.kind == "table", p.html, p.rows))
                    source.append(i)
                    if len(held) >= rows:
                        yield done()
                        held, source = [], []
            if held:
                yield done()
    return task
