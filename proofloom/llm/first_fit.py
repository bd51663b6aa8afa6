"""Packing documents into token sequences by first-fit decreasing over a tournament tree.

Documents are encoded where they are read and dealt at random to groups of about ``GROUP_BYTES`` of text; a group is
packed on its own. Full sequences are cut off the front of long documents. What is left goes, longest first,
into the first sequence with room: a tournament tree holds the free room of all sequences, each
inner node the larger of its two, so the leftmost one that fits is found from the top down.

Padding that first-fit leaves is then filled by cutting: the emptiest sequences are taken apart and poured into the gaps of the
fullest, and the one sequence that is left with a gap is cut at powers of two, which need no padding.

Encoding is the costly part. Tokens never cross ASCII white space in this vocabulary, so a task encodes every distinct word
once and remembers it, up to ``REMEMBERED`` words. Most words are found by their hash in a table of
``2 ** SEEN_BITS`` places, the others by their bytes. Words of ASCII and Latin-1 letters go straight to the merges of the
tokenizer's model, piece by piece; all others go through the whole tokenizer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

CAPACITY = 2048
GROUP_BYTES = 4 << 20
REMEMBERED, REMEMBERED_PIECES = 1_200_000, 200_000
SEEN_BITS = 21
END = 1
MAX_FILE = 16 << 20
_CUT = 1 << 20

ENCODED = "doc_id long, part long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: How this vocabulary's file cuts lower-cased text into pieces, and how it writes bytes as letters.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_letters() -> dict[int, str]:
    letters = {b: chr(b) for b in _PLAIN_BYTES}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


def _grown(array: np.ndarray, at: int, values) -> np.ndarray:
    """``array`` with ``values`` from place ``at``, twice as long if they do not fit."""
    end = at + len(values)
    if end > len(array):
        array = np.concatenate([array[:at], np.zeros(2 * end - at, array.dtype)])
    array[at:end] = values
    return array


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer, from ids of their words."""

    def __init__(self, data: bytes, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        self.split = regex.compile(_PIECES).findall
        self.usual = regex.compile(r"[\x21-\x7eÀ-ÿ]*").fullmatch
        self.letters = _byte_letters()
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.n_words = self.n_ids = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint16)
        self.seen, self.seen_row = np.zeros(1 << SEEN_BITS, np.uint64), np.full(1 << SEEN_BITS, -1, np.int32)

    def word(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if not self.usual(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for piece in self.split(text.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                if len(self.pieces) >= REMEMBERED_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
            out += ids
        return out

    def rows(self, raw: list[bytes]) -> np.ndarray:
        """Places of distinct words among the remembered ones."""
        place, n = self.place, self.n_words
        out = []
        ids: list[int] = []
        lengths: list[int] = []
        for word in raw:
            at = place.get(word)
            if at is None:
                at = place[word] = n + len(lengths)
                new = self.word(word)
                ids += new
                lengths.append(len(new))
            out.append(at)
        if lengths:
            self.start = _grown(self.start, n, self.n_ids + np.cumsum([0, *lengths[:-1]]))
            self.length = _grown(self.length, n, lengths)
            self.flat = _grown(self.flat, self.n_ids, ids)
            self.n_words, self.n_ids = n + len(lengths), self.n_ids + len(ids)
        return np.array(out, np.int64)

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a slice, without an end."""
        if self.n_words > self.remembered:
            self.forget()
        w = words.words(texts)
        data, _ = words.text_bytes(texts)
        slot = (w.hash & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)
        row = np.where(self.seen[slot] == w.hash, self.seen_row[slot], -1)
        new = np.flatnonzero(row < 0)
        if len(new):
            raw = data.tobytes()
            _, first, inverse = np.unique(w.hash[new], return_index=True, return_inverse=True)
            first = new[first]
            found = self.rows([raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())])
            row[new] = found[inverse]
            places, one = np.unique(slot[first], return_index=True)
            self.seen[places], self.seen_row[places] = w.hash[first[one]], found[one]
        start, length = self.start[row], self.length[row]
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        ids = self.flat[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        return [ids[a:b] for a, b in zip(ends[w.first[:-1]].tolist(), ends[w.first[1:]].tolist())]


class Tournament:
    """Free room of sequences in order; ``n`` is the most there can be."""

    def __init__(self, n: int, capacity: int):
        self.base = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.base)

    def take(self, size: int) -> int:
        """Take ``size`` of the first sequence that has it, and return its place."""
        best, node = self.best, 1
        while node < self.base:
            node *= 2
            if best[node] < size:
                node += 1
        place = node - self.base
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return place


def first_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Places of items per sequence, by first-fit decreasing; items of equal size keep their order."""
    room = Tournament(max(1, len(sizes)), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = room.take(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) without padding: full ones, and ones as long as a power of two.

    The emptiest sequences are poured into the gaps of the fullest; at most one is left with a
    gap, and it is cut at the powers of two that make up its length.
    """
    size = lambda b: sum(length for _, _, length in b)
    out = [b for b in bins if size(b) == capacity]
    gaps = sorted((b for b in bins if size(b) < capacity), key=size, reverse=True)
    low, high = 0, len(gaps) - 1
    while low < high:
        room = capacity - size(gaps[low])
        while room and low < high:
            doc, start, length = gaps[high].pop()
            part = min(room, length)
            gaps[low].append((doc, start, part))
            if part < length:
                gaps[high].append((doc, start + part, length - part))
            room -= part
            if not gaps[high]:
                high -= 1
        if not room:
            out.append(gaps[low])
            low += 1
    for rest in gaps[low:high + 1]:
        left, pieces = size(rest), list(reversed(rest))
        while left:
            room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            left -= room
            part: list[tuple[int, int, int]] = []
            while room:
                doc, start, length = pieces.pop()
                taken = min(room, length)
                part.append((doc, start, taken))
                if taken < length:
                    pieces.append((doc, start + taken, length - taken))
                room -= taken
            out.append(part)
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of all documents once."""
    full = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    return full + fill([[rest[i] for i in b] for b in first_fit([r[2] for r in rest], capacity)], capacity)


def _encoder(shared) -> Encoder:
    """The worker's encoder; it stays, with the words it knows, beside the broadcast vocabulary for the next task."""
    held = shared.value
    if "encoder" not in held:
        held["encoder"] = Encoder(held["vocabulary"])
    return held["encoder"]


def _long_text(encoder: Encoder, texts: pa.Array) -> list[np.ndarray]:
    """Ids of one text that fills a slice, encoded in stretches that end at white space."""
    data, _ = words.text_bytes(texts)
    ids, low = [], 0
    while low < len(data):
        high = min(len(data), low + _CUT)
        if high < len(data):
            gaps = np.flatnonzero(words._SPACE[data[low:high]])
            if not len(gaps):
                later = np.flatnonzero(words._SPACE[data[high:]])
                high = high + int(later[0]) if len(later) else len(data)
            else:
                high = low + int(gaps[-1]) + 1
        ids += encoder.texts(pa.array([data[low:high].tobytes().decode()]))
        low = high
    return [np.concatenate(ids)] if ids else [np.zeros(0, np.uint16)]


def _encode(shared, end: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        tail = np.array([end], np.uint16)
        for batch in batches:
            for at, texts in words.slices(batch.column("text")):
                long = len(texts) == 1 and words.text_bytes(texts)[1][-1] > _CUT
                ids = _long_text(encoder, texts) if long else encoder.texts(texts)
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), batch.column("part").slice(at, len(texts)),
                                       pa.array([np.concatenate([i, tail]).tobytes() for i in ids], pa.binary())], ["doc_id", "part", "ids"])
    return task


def _packer(capacity: int):
    def pieces(part: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        bodies = [np.frombuffer(ids, np.uint16).astype("<u4") for _, ids in docs]
        rows = []
        for number, sequence in enumerate(pack_group([len(b) for b in bodies], capacity)):
            offset = 0
            for doc, start, length in sequence:
                rows.append((docs[doc][0], start, length, zlib.crc32(bodies[doc][start:start + length].tobytes()), len(bodies[doc]), part << 32 | number, offset))
                offset += length
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PIECES.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if part != now and held:
                    yield pieces(now, held)
                    held = []
                now = part
                held.append((doc, ids))
        if held:
            yield pieces(now, held)
    return task


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end: int = END, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece of a document.

    ``docs`` has (doc_id, text). A document is its ids under the vocabulary, then ``end``; ``start`` counts its
    ids before the piece, ``offset`` those of the sequence before it. Sequences hold ``capacity`` ids or a power of two of them.

    A null or empty text is the end alone; a null doc_id stays null; repeated rows are packed each, as documents of
    their own; no rows give no rows. Rows are dealt to groups by their place in the input, so a
    rerun over the same files deals them alike. Columns besides the two are not looked at.
    """
    with open(vocabulary_path, "rb") as file:
        data = file.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"{vocabulary_path} is larger than {MAX_FILE} bytes")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-int(size) // group_bytes))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("part"))
    encoded = dealt.mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast({"vocabulary": data}), end), ENCODED)
    return encoded.repartition("part").sortWithinPartitions("part").mapInArrow(_packer(capacity), PIECES)
