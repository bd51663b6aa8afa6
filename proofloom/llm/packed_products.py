"""Hard negatives by inner products of Kronecker-packed integers.

Components become integers, ``floor(SCALE * x)``. For one component, those of several
candidates are biased by their least value, so that none is negative, and laid side by side
in the fields of one wide integer. An anchor's component multiplies that integer once, and
the sum over all components holds every candidate's biased score in its own field. One
more component, 1 in every field of the candidates, carries for each anchor what turns a
biased score into ``score + half``, so a shift and a mask unpack exact scores.

The wide integer is held in the 53 bits of a double, so that the products are one matrix
product, as long as two fields fit (unit vectors need some 20 bits each). Fields of
larger components go into Python integers of any width, ``FIELDS`` at a time, by the same steps.

Anchors are the stated query set. They are taken in blocks of at most ``ANCHORS`` rows, which are
sent to the tasks; a block is two passes over all rows, one for positives and one for negatives.
A task keeps the best rows per list, so what is shuffled is lists times tasks times the length of a list.
Rows of a batch with equal vectors and labels are cut to those with the smallest ids that a list can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, top_n, work_folder
from . import words

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ANCHORS = 16_384
FIELDS = 8
TILE = 1024
_DOUBLE_BITS = 53
_LONG = (-2**63, 2**63 - 1)
_NO_LABEL = -1

POSITIVE_ROWS = "anchor_id long, positive_id long, positive_score long"
NEGATIVE_ROWS = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


class Anchors(NamedTuple):
    """One block: ids, label codes, integer components as doubles, and the labels that the codes stand for."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    names: pa.Array


class Lists(NamedTuple):
    """Lists to fill: the anchor's place, the bounds of a score, and what else names the list."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive: np.ndarray
    score: np.ndarray


def integers(column: pa.Array, dimensions: int) -> np.ndarray:
    """``floor(SCALE * x)`` as doubles, rows x ``dimensions``; missing components are 0, further ones are left out."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), dimensions))
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < dimensions
    out[row[inside], place[inside]] = flat[inside]
    return out


def _exact(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers of any width."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def products(candidates: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of candidates, their scores: candidates x anchors) by packed products, field by field."""
    n = len(candidates)
    bias = max(0, -int(candidates.min(initial=0)))
    most = bias + max(0, int(candidates.max(initial=0)))
    large = np.abs(anchors).max(initial=0) >= 2**31
    weight = max((sum(map(abs, row)) for row in _exact(anchors)), default=0) if large else int(np.abs(anchors).sum(axis=1).max(initial=0))
    width = (weight * max(bias, most - bias)).bit_length() + 2
    half = 1 << (width - 1)
    partial = weight * most + half + weight * bias  # no partial sum of one field is larger
    wide = partial * ((1 << width) + 1) >= 1 << _DOUBLE_BITS
    fields = FIELDS if wide else 2
    kind = _exact if wide else np.asarray
    rows = -(-n // fields)
    packed = np.zeros((rows, candidates.shape[1] + 1), object if wide else float)
    for f in range(fields):
        part = candidates[f * rows:(f + 1) * rows]
        packed[:len(part), :-1] += (kind(part) + bias) * (1 << (width * f))
        packed[:, -1] += 1 << (width * f)
    a = kind(anchors)
    last = np.full(len(a), half, packed.dtype)
    for column in a.T:
        last -= bias * column
    total = packed @ np.column_stack([a, last]).T
    if not wide:
        total = total.astype(np.int64)
    for f in range(fields):
        here = np.arange(f * rows, min(n, (f + 1) * rows))
        if len(here):
            score = ((total[:len(here)] >> (width * f)) & ((1 << width) - 1)) - half
            yield here, np.clip(score, *_LONG).astype(np.int64) if wide else score


def first_copies(rows: np.ndarray, label: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest ids among rows with equal components and label.

    Rows meet by a hash; two different ones that share it only stay apart or uncut, never get lost.
    """
    code = (rows.view(np.uint64) * words.seeds(rows.shape[1], 23)).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), np.uint64)
    order = np.lexsort((ids, words.mix(code ^ label.astype(np.uint64))))
    rows, label = rows[order], label[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1) | (label[1:] != label[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[np.arange(len(order)) - start < n]


class Best:
    """The best ``k`` (score, id) of every list of some anchors: higher scores first, ties to smaller ids."""

    def __init__(self, lists: Lists, anchors: np.ndarray, k: int):
        low, high = np.searchsorted(lists.anchor, [anchors[0], anchors[-1] + 1])
        self.k, self.at, self.high = k, low, lists.high[low:high]
        self.least = lists.low[low:high].copy()  # a row below it cannot enter its list
        self.first = np.searchsorted(lists.anchor[low:high], np.append(anchors, anchors[-1] + 1))
        self.anchors = anchors
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that some list of every anchor still takes."""
        return np.minimum.reduceat(self.least, self.first[:-1]), np.maximum.reduceat(self.high, self.first[:-1])

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows for all lists of an anchor, given by its place among the anchors of this object."""
        each = self.first[anchor + 1] - self.first[anchor]
        where = np.repeat(self.first[anchor] - np.cumsum(each) + each, each) + np.arange(each.sum())
        score, ids = np.repeat(score, each), np.repeat(ids, each)
        fits = (score >= self.least[where]) & (score <= self.high[where])
        if not fits.any():
            return
        where, score, ids = (np.concatenate([a, b[fits]]) for a, b in ((self.list, where), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, where))  # ~x falls as x rises, for every long
        where, score, ids = where[order], score[order], ids[order]
        start = np.ones(len(where), bool)
        start[1:] = where[1:] != where[:-1]
        place = np.arange(len(where)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        last = place == self.k - 1
        self.least[where[last]] = score[last]
        keep = place < self.k
        self.list, self.score, self.id = where[keep], score[keep], ids[keep]


def scan(batches: Iterator[pa.RecordBatch], block: Anchors, lists: Lists, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(list, score, id) of the rows that fill ``lists``, of the anchor's label (``same``) or of others, from all batches.

    The lists of an anchor follow each other. A tile of rows and anchors is tested first against the loosest
    bounds of an anchor's lists, and only what passes is tested list by list.
    """
    asked = np.unique(lists.anchor)
    parts = [Best(lists, asked[at:at + TILE], k) for at in range(0, len(asked), TILE)]
    for batch in batches:
        codes = pc.fill_null(pc.index_in(batch.column("label"), value_set=block.names), _NO_LABEL).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        rows = integers(batch.column("embedding"), block.values.shape[1])
        picked = first_copies(rows, codes, ids, k + 1)
        if same:
            picked = picked[codes[picked] != _NO_LABEL]
        for low in range(0, len(picked), 2 * TILE):
            part = picked[low:low + 2 * TILE]
            for best in parts:
                least, most = best.bounds()
                for here, score in products(rows[part], block.values[best.anchors]):
                    r, c = np.nonzero((score >= least) & (score <= most))
                    who, anchor = part[here[r]], best.anchors[c]
                    fits = ((codes[who] == block.labels[anchor]) == same) & (ids[who] != block.ids[anchor])
                    best.offer(c[fits], score[r[fits], c[fits]], ids[who[fits]])
    found = [(b.list + b.at, b.score, b.id) for b in parts]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _positives(shared, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Anchors(*shared.value)
        n = len(block.ids)
        free = Lists(np.arange(n), np.full(n, _LONG[0]), np.full(n, _LONG[1]), np.zeros(n), np.zeros(n))
        at, score, ids = scan(batches, block, free, True, k)
        yield pa.record_batch([pa.array(block.ids[at]), pa.array(ids), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])
    return task


def _negatives(shared, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = Anchors(*shared.value[0]), Lists(*shared.value[1])
        at, score, ids = scan(batches, block, lists, False, k)
        yield pa.record_batch([pa.array(x) for x in (block.ids[lists.anchor[at]], lists.positive[at], lists.score[at], ids, score)],
                              ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return task


def _lists(block: Anchors, rows: list, low: int, high: int) -> Lists:
    """One list per (anchor, positive): scores from ceil(low / 100 of the positive's) to floor(high / 100 of it)."""
    place = {int(i): p for p, i in enumerate(block.ids)}
    rows = sorted((place[r["anchor_id"]], r["positive_id"], r["positive_score"]) for r in rows)
    at, positive, score = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    bounds = np.clip(np.array([(-(-low * s // 100), high * s // 100) for s in score.tolist()], object).reshape(-1, 2), *_LONG).astype(np.int64)
    return Lists(at, bounds[:, 0], bounds[:, 1], positive, score)


def blocks(anchors: DataFrame, rows: int) -> Iterator[Anchors]:
    """Anchors, at most ``rows`` at a time."""
    held: list = []

    def block() -> Anchors:
        values = integers(pa.array([r["embedding"] for r in held], pa.list_(pa.float64())), max(len(r["embedding"]) for r in held))
        names, code = np.unique([r["label"] for r in held], return_inverse=True)
        return Anchors(np.array([r["vec_id"] for r in held], np.int64), code.astype(np.int64), values, pa.array(names.tolist(), pa.string()))

    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield block()
            held = []
    if held:
        yield block()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label as text, embedding) of the rows that take part, one per id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * SCALE) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding") \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block_rows: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has (vec_id, label, embedding); ``anchor`` is a condition on vec_id. An anchor's positives are
    the first ``positives`` other rows of its label; each is given the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's, both included. Higher scores come first,
    ties by smaller vec_id; ``rank`` counts from 1.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite
    (also after scaling) take no part. An id that stands at several rows counts once, by its smallest (label,
    vector). Vectors of different lengths are filled up with zeros. An anchor without a positive, or a
    positive without a negative, has no rows, nor has an empty table. A score beyond the bounds of
    a long counts as the bound. Columns besides the three are not looked at.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors))
    folder = f"{work_folder(spark)}/found"
    spark.createDataFrame([], NEGATIVE_ROWS).write.parquet(folder)  # so that the folder exists without anchors
    for block in blocks(rows.filter(anchor), block_rows):
        near = rows.mapInArrow(_positives(spark.sparkContext.broadcast(tuple(block)), positives), POSITIVE_ROWS)
        near = top_n(near, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives).drop("rank").collect()
        lists = _lists(block, near, low, high)  # at most ``positives`` rows per anchor of the block
        task = _negatives(spark.sparkContext.broadcast((tuple(block), tuple(lists))), negatives)
        rows.mapInArrow(task, NEGATIVE_ROWS).write.mode("append").parquet(folder)
    found = spark.read.schema(NEGATIVE_ROWS).parquet(folder)
    ranked = top_n(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
