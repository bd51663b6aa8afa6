"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model is ``P(grade >= k) = sigmoid(w . x - cut_k)`` with one weight vector for all
ordered cuts; ``x`` is ``log2(1 + times)`` of every word of the model that a text holds. The expected
severity is the sum of these probabilities over the grades.

Words are hashed into ``2 ** BITS`` buckets. Only buckets whose document counts
speak for toxicity (a likelihood ratio of at least ``LEAST_RATIO`` on the labelled rows) get
a weight, so words without evidence add nothing, however long a text is. Labels may be
grades 0, 1, 2, ...; where they only say toxic or not, there is no severity to learn from, and
as a substitute toxic rows are graded by how often they hold such words: up to twice, up to four times, or more.
The cuts above the first then follow the features themselves.

Only the fit leaves the tasks: bucket numbers of at most ``SAMPLE`` labelled documents, picked
by a hash of their ids, come to the driver. The model's table has 2 ** BITS entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .line_crf import labelled, _minimise

BITS = 18
SAMPLE = 8000
LEAST_RATIO = 20.0
LEAST_DOCUMENTS = 4
GRADE_STEPS = (2, 4)
_L2 = 1e-4


class Model(NamedTuple):
    """Weight per bucket (zero where there is no evidence) and the ordered cuts."""

    weights: np.ndarray
    cuts: np.ndarray


def buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word buckets in order, times of each) for every text of a slice."""
    w = words.words(texts)
    at = (_stripped(w, texts) >> np.uint64(64 - BITS)).astype(np.int64)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield np.unique(at[a:b], return_counts=True)


_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?'\"()[]{}|%&*$#-_/\\<>"]] = True


def _stripped(w: words.Words, texts: pa.Array) -> np.ndarray:
    """Word hashes without marks at the ends of a word; a word of marks only keeps its own hash."""
    data, _ = words.text_bytes(texts)
    start, end = w.start.copy(), w.end.copy()
    if not len(start):
        return w.hash
    plain = ~_MARK[data]
    # The next plain byte from the start, the last plain byte before the end.
    ahead = np.where(plain, np.arange(len(data)), len(data))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(plain, np.arange(len(data)), -1))
    new_start, new_end = ahead[start], behind[end - 1] + 1
    good = new_start < new_end
    changed = np.flatnonzero(good & ((new_start != start) | (new_end != end)))
    out = w.hash.copy()
    out[changed] = words.span_hashes(data, new_start[changed], new_end[changed])
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            yield pa.record_batch([batch.column("label").slice(at, len(texts)),
                                   pa.array([np.array(bag, np.int32).tobytes() for bag in buckets(texts)], pa.binary())], ["label", "bag"])


def evidence(bags: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Buckets that occur more in toxic documents, by the likelihood ratio of their document counts."""
    inside = np.bincount(np.concatenate([b for b, t in zip(bags, toxic) if t] or [np.zeros(0, int)]), minlength=size).astype(float)
    outside = np.bincount(np.concatenate([b for b, t in zip(bags, toxic) if not t] or [np.zeros(0, int)]), minlength=size).astype(float)
    n, m = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    share = (inside + outside) / (n + m)
    part = lambda k, of, p: k * np.log(np.maximum(k, 1e-12) / np.maximum(of * p, 1e-12)) + \
        (of - k) * np.log(np.maximum(of - k, 1e-12) / np.maximum(of * (1 - p), 1e-12))
    ratio = 2 * (part(inside, n, share) + part(outside, m, share))
    return np.flatnonzero((ratio >= LEAST_RATIO) & (inside / n > outside / m) & (inside >= LEAST_DOCUMENTS))


def fit(bags: list[np.ndarray], labels: np.ndarray, size: int = 1 << BITS) -> Model | None:
    """A model from (buckets, times) per document and grades; ``None`` unless two grades occur."""
    if len(set(labels.tolist())) < 2:
        return None
    chosen = evidence([b[0] for b in bags], labels > 0, size)
    place = np.full(size, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    held = [place[b][place[b] >= 0] for b, _ in bags]
    times = [t[place[b] >= 0] for b, t in bags]
    n_held = np.array([len(h) for h in held])
    grades = labels.copy()
    if labels.max() == 1:
        grades[labels == 1] = 1 + np.searchsorted(np.array(GRADE_STEPS), np.array([t.sum() for t in times])[labels == 1], "left")
    top = int(grades.max())
    column = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bags)), n_held)
    x = np.log2(1 + np.concatenate(times)) if times else np.zeros(0)
    width = len(chosen)

    def cuts_of(p):
        return p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1:]))])

    def loss(p):
        eta = np.bincount(row, p[:width][column] * x, minlength=len(bags)) if len(column) else np.zeros(len(bags))
        cuts = cuts_of(p)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        below, above = edges[grades] - eta, edges[grades + 1] - eta
        cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        low, high = cdf(below), cdf(above)
        chance = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low) / chance, high * (1 - high) / chance
        slope_eta = d_high - d_low
        at_cut = np.zeros(len(cuts))
        np.add.at(at_cut, grades[grades > 0] - 1, d_low[grades > 0])
        np.add.at(at_cut, grades[grades < top], -d_high[grades < top])
        slope = np.zeros_like(p)
        slope[:width] = np.bincount(column, slope_eta[row] * x, minlength=width)[:width] if len(column) else 0
        slope[width] = at_cut.sum()
        slope[width + 1:] = np.cumsum(at_cut[::-1])[::-1][1:] * np.exp(p[width + 1:])
        return -np.log(chance).mean() + _L2 * p[:width] @ p[:width], \
            slope / len(bags) + np.concatenate([2 * _L2 * p[:width], np.zeros(top)])

    p = _minimise(loss, np.zeros(width + top), 200)
    weights = np.zeros(size, np.float32)
    weights[chosen] = p[:width]
    return Model(weights, cuts_of(p))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on labelled documents outside the held-out part; ``labels`` has (doc_id, ``column``)."""
    rows = labelled(docs, labels, column, sample, "label >= 0").mapInArrow(_bags, "label int, bag binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["bag"])))
    return fit([np.frombuffer(r["bag"], np.int32).astype(np.int64).reshape(2, -1) for r in rows], np.array([r["label"] for r in rows], np.int64)) if rows else None


SCORES = "doc_id long, severity double, grade int, toxic boolean, p_toxic double"


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, severity, grade, toxic, p_toxic) for every row of ``docs`` (doc_id, text).

    ``severity`` is the expected grade, ``grade`` the most likely one, ``p_toxic`` the
    probability of a grade above 0, ``toxic`` whether that is at least one half.

    A null or empty text holds no words and gets the lowest severity there is. A null doc_id
    stays null; repeated rows get equal grades; without a model (no labels, or
    one grade only) severity is 0. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in words.slices(batch.column("text")):
                if model is None:
                    at_least = np.zeros((len(texts), 1))
                else:
                    eta = np.array([float(model.weights[b] @ np.log2(1 + t)) for b, t in buckets(texts)])
                    at_least = 1 / (1 + np.exp(-np.clip(eta[:, None] - model.cuts[None, :], -500, 500)))
                each = np.column_stack([np.ones(len(texts)), at_least]) - np.column_stack([at_least, np.zeros(len(texts))])
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(at_least.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)),
                     pa.array(at_least[:, 0] >= 0.5), pa.array(np.ascontiguousarray(at_least[:, 0]))],
                    ["doc_id", "severity", "grade", "toxic", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCORES)


def grade_by_labels(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``grade`` with a model fitted on the labelled rows of ``docs``."""
    return grade(docs, train(docs, labels, column, sample))
