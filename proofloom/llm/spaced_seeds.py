"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over ``SPAN`` consecutive words that looks at some of them and
ignores the rest, so two passages share a seed hash although words at
ignored places differ. Hashes of all benchmark windows are joined with the hashes of
all training windows; every hit fixes a diagonal (place in the document minus
place in the item), along which the words are compared one by one. A document is
contaminated by an item when, along a diagonal that holds a hit,

- a stretch of ``WINDOW`` words (or the whole item, if it is shorter) agrees in at least ``AGREE`` of its words, or
- the document's start or end leaves less of the item than that, but at least ``LEAST`` words, and ``AGREE`` of them agree, or
- a shorter stretch inside other text, of at least ``LEAST`` words, agrees in at least ``EXCERPT`` of its words, or
- one of these holds when words also count on the ``DRIFT`` diagonals to either side, in the order of both texts,
  so that inserted or deleted words do not split an item (items of at least ``SPAN`` words).

The benchmark is the stated query set. It is taken in blocks of at most
``BLOCK_WORDS`` words; a block's index (a sorted table of hashes) has a size
bound and is sent to the tasks, and each block is one pass over the documents, without
a shuffle. The usual benchmarks fit one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Masks over consecutive words: 1 looks, 0 ignores. Together they leave no gap: however a quarter of 13 to 32 words
#: is substituted, some window's substitutions all fall on places that one mask ignores.
MASKS = ("01011111", "11111010", "11110001", "10010111", "11101100")
SPAN = 8
WINDOW = 32
AGREE = 0.75
LEAST = 13
EXCERPT = 0.8
DRIFT = 4
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22

HITS = "doc_id long, item_id long, start int, end int, n_words int, n_agree int"


class Index(NamedTuple):
    """Seed hashes in order with their place, and the words of all items of a block."""

    seed: np.ndarray
    place: np.ndarray
    item: np.ndarray
    first: np.ndarray
    word: np.ndarray
    near: np.ndarray


def _masks(width: int) -> list[np.ndarray]:
    """The masks as places; a text of fewer words than a mask is one window, looked at in full."""
    return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS] if width == SPAN else [np.arange(width)]


def seed_hashes(hashed: np.ndarray, width: int = SPAN) -> Iterator[np.ndarray]:
    """One array of window hashes per mask; a hash depends on the mask and on the words it looks at."""
    n = len(hashed) - width + 1
    for number, looks in enumerate(_masks(width)):
        total = np.full(max(n, 0), np.uint64(number + 1 + 16 * (width if width < SPAN else 0)))
        for k, j in enumerate(looks.tolist()):
            total += hashed[j:j + max(n, 0)] * words._PLACE[k]
        yield words.mix(total)


def build(items: list[tuple[int, np.ndarray]]) -> Index:
    """Index of (item_id, hashed words) rows. Items without words are left out."""
    items = [(i, w) for i, w in items if len(w)]
    first = np.cumsum([0, *(len(w) for _, w in items)])
    seeds, places = [], []
    for k, (_, w) in enumerate(items):
        for hashed in seed_hashes(w, min(SPAN, len(w))):
            seeds.append(hashed)
            places.append(first[k] + np.arange(len(hashed)))
    seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    order = np.argsort(seed, kind="stable")
    near = np.zeros(1 << FILTER_BITS, bool)
    near[seed & np.uint64((1 << FILTER_BITS) - 1)] = True
    return Index(seed[order], place[order], np.array([i for i, _ in items], np.int64), first,
                 np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64), near)


def best_stretch(agree: np.ndarray, width: int) -> tuple[int, int]:
    """(start, agreeing words) of the first best window of ``width`` words."""
    run = np.concatenate([[0], np.cumsum(agree)])
    sums = run[width:] - run[:-width]
    at = int(np.argmax(sums))
    return at, int(sums[at])


def drifting(body: np.ndarray, hashed: np.ndarray, shift: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(start in the item, words, agreeing words) of the first best stretch of 1, 2, ... ``width`` words of an item.

    Words agree on the diagonals ``shift - DRIFT`` to ``shift + DRIFT``. To a later one words of the
    document are passed over; to an earlier one words of the item, which count as not agreeing. Stretches
    without a word that agrees on ``shift`` itself are left to other hits.
    """
    reach = np.arange(len(body))[:, None] + np.arange(shift - DRIFT, shift + DRIFT + 1)
    inside = (reach >= 0) & (reach < len(hashed))
    agree = (inside & (hashed[np.clip(reach, 0, len(hashed) - 1)] == body[:, None])).astype(np.int32)
    run = np.concatenate([[0], np.cumsum(agree[:, DRIFT])])
    first = np.arange(len(body))
    first = first[run[np.minimum(first + width, len(body))] > run[first]]
    total = np.zeros((len(first), agree.shape[1]), np.int32)
    for k in range(width):
        there = first + k < len(body)
        if not there.any():
            return
        first, total = first[there], total[there]
        skipped = np.concatenate([total[:, 1:], total[:, -1:]], axis=1)
        total = np.maximum(np.maximum.accumulate(total, axis=1) + agree[first + k], skipped)
        most = total.max(axis=1)
        at = int(np.argmax(most))
        yield int(first[at]), k + 1, int(most[at])


def excerpts(body: np.ndarray, hashed: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(start in the item, words, agreeing words) of stretches that count though no whole window does."""
    least, width = min(LEAST, len(body)), min(WINDOW, len(body))
    low, high = max(0, -shift), min(len(body), len(hashed) - shift)
    same = body[low:high] == hashed[low + shift:high + shift]
    for n in range(least, min(width, high - low + 1)):
        start, agree = best_stretch(same, n)
        if agree >= (AGREE if n == high - low else EXCERPT) * n:
            yield low + start, n, agree
    if len(body) >= SPAN:
        for start, n, agree in drifting(body, hashed, shift, width):
            if n >= least and agree >= (AGREE if n == width else EXCERPT) * n:
                yield start, n, agree


def find(hashed: np.ndarray, index: Index, short: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(item_id, start, end, words, agreeing words) of every item that one text holds, by word places of the text."""
    found: set[tuple[int, int]] = set()
    for width in [SPAN, *short]:
        if len(hashed) < width:
            continue
        for seeds in seed_hashes(hashed, width):
            here = np.flatnonzero(index.near[seeds & np.uint64((1 << FILTER_BITS) - 1)])
            if not len(here):
                continue
            low = np.searchsorted(index.seed, seeds[here], "left")
            times = np.searchsorted(index.seed, seeds[here], "right") - low
            at = np.repeat(here, times)
            place = index.place[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            item = np.searchsorted(index.first, place, "right") - 1
            found.update(zip(item.tolist(), (at - place + index.first[item]).tolist()))
    best: dict[int, tuple] = {}
    for item, shift in found:
        body = index.word[index.first[item]:index.first[item + 1]]
        low, high = max(0, -shift), min(len(body), len(hashed) - shift)
        width = min(WINDOW, len(body))
        if high - low < width:
            continue
        start, agree = best_stretch(body[low:high] == hashed[low + shift:high + shift], width)
        if agree >= AGREE * width:
            row = (int(index.item[item]), low + shift + start, low + shift + start + width, width, agree)
            if item not in best or (-row[4], row[1]) < (-best[item][4], best[item][1]):
                best[item] = row
    whole = set(best)
    for item, shift in found:
        if item in whole:
            continue
        for start, n, agree in excerpts(index.word[index.first[item]:index.first[item + 1]], hashed, shift):
            at, end = max(0, start + shift), min(len(hashed), start + shift + n)
            if end - at < min(LEAST, int(index.first[item + 1] - index.first[item])):
                continue  # the document holds fewer words than count
            row = (int(index.item[item]), at, end, end - at, min(agree, end - at))
            if item not in best or (-row[4], row[3], row[1]) < (-best[item][4], best[item][3], best[item][1]):
                best[item] = row
    return sorted(best.values())


def hopeful(w: words.Words, index: Index, short: list[int]) -> list[int]:
    """Texts of a slice with a window that passes the index's filter and is in the index."""
    out: set[int] = set()
    for width in [SPAN, *short]:
        for seeds in seed_hashes(w.hash, width):
            here = np.flatnonzero(index.near[seeds & np.uint64((1 << FILTER_BITS) - 1)])
            at = np.minimum(np.searchsorted(index.seed, seeds[here]), max(len(index.seed) - 1, 0))
            here = here[index.seed[at] == seeds[here]] if len(index.seed) else here[:0]
            out.update((np.searchsorted(w.first, here, "right") - 1).tolist())
    return sorted(out)


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            w = words.words(texts)
            bodies = [words.signed(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.record_batch([batch.column("item_id").slice(at, len(texts)), pa.array(bodies, pa.list_(pa.int64()))], ["item_id", "words"])


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The benchmark's items, at most ``block_words`` words (or one item) at a time."""
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct() \
        .mapInArrow(item_words, "item_id long, words array<long>")
    block, size = [], 0
    for row in rows.toLocalIterator():
        body = np.array(row["words"], np.int64).view(np.uint64)
        if block and size + len(body) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], body))
        size += len(body)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, n_words, n_agree), one per document and item it holds.

    ``docs`` has (doc_id, text), ``benchmark`` (item_id, text). Words are
    lower-cased runs of characters other than white space; start and end are word
    places in the document of its best stretch, on the diagonal of its hit; n_words is ``end - start``.

    Null or wordless texts hold nothing and are held by nothing; items of fewer words
    than a mask must agree in every word; rows without item_id are no items; a null
    doc_id stays null; repeated documents are reported each; an empty table
    on either side gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], HITS)
    for block in blocks(benchmark, block_words):
        index = build(block)
        short = sorted({len(w) for _, w in block if 0 < len(w) < SPAN})
        out = out.unionByName(docs.mapInArrow(_scanner(spark.sparkContext.broadcast(index), short), HITS))
    return out


def _scanner(shared, short: list[int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = ["doc_id", "item_id", "start", "end", "n_words", "n_agree"]
        for batch in batches:
            for at, texts in words.slices(batch.column("text")):
                w = words.words(texts)
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                rows = [(ids[t], *hit) for t in hopeful(w, index, short)
                        for hit in find(w.hash[w.first[t]:w.first[t + 1]], index, short)]
                yield pa.record_batch([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(zip(*rows) if rows else [[]] * 6)], names)
    return task


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay.

    Each row is judged by its own text, where it is read, so nothing is shuffled and
    rows without doc_id or with a repeated one need no special case.
    """
    context = docs.sparkSession.sparkContext
    for block in blocks(benchmark, block_words):
        short = sorted({len(w) for _, w in block if 0 < len(w) < SPAN})
        docs = docs.mapInArrow(_sieve(context.broadcast(build(block)), short), docs.schema)
    return docs


def _sieve(shared, short: list[int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for at, texts in words.slices(batch.column("text")):
                w = words.words(texts)
                for t in hopeful(w, index, short):
                    clean[at + t] = not find(w.hash[w.first[t]:w.first[t + 1]], index, short)
            yield batch.filter(pa.array(clean))
    return task
