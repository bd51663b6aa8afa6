"""Document quality from a linear-chain conditional random field over lines.

Every line gets the mix of its characters, its length and its repeated words, next to
those of the line before and the line after. The chain has two labels, bad and good.
Its weights are fitted by maximum likelihood on labelled documents, whose lines
carry the document's label. Forward-backward marginals of "good", weighted
by line length, give a document's share of good text, and a logistic
curve fitted on the same documents turns the share into a score.

Only the fit leaves the tasks: the features of at most ``SAMPLE`` labelled documents of at most
``MAX_LINES`` lines, picked by a hash of their ids, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

SAMPLE, MAX_LINES = 3000, 1000
ROUNDS = 80
THRESHOLD = 0.3
_L2 = 1e-3

_CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)  # other symbols
_CLASS[128:] = 0
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b" \t\r\v\f\n"]] = 3
_CLASS[[*b".,;:?'\"()-"]] = 4
_CLASS[[*b"!"]] = 5
_CLASS[[*b"|<>{}[]/\\=_+~^"]] = 6
N_FEATURES = _CLASSES + 4


class Lines(NamedTuple):
    """Features and byte lengths of all lines; text ``t`` has lines ``first[t]:first[t + 1]``."""

    features: np.ndarray
    length: np.ndarray
    first: np.ndarray


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


def lines(texts: pa.Array) -> Lines:
    """Lines of a slice of texts; an empty text is one empty line, a closing line feed opens none."""
    data, offsets = words.text_bytes(texts)
    feeds = np.flatnonzero(data == 10) + 1
    ends = np.union1d(feeds, offsets[1:])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    empty = np.flatnonzero(offsets[1:] == offsets[:-1])
    # Empty texts own no byte, so their line is put in by hand.
    starts, ends = np.concatenate([starts, offsets[empty]]), np.concatenate([ends, offsets[empty]])
    real = ends > starts
    real[len(ends) - len(empty):] = True
    starts, ends = starts[real], ends[real]
    text = np.concatenate([np.searchsorted(offsets, starts[:len(starts) - len(empty)], "right") - 1, empty])
    order = np.lexsort((starts, text))
    starts, ends, text = starts[order], ends[order], text[order]
    n = len(starts)
    length = (ends - starts).astype(np.int64)
    by_byte = np.repeat(np.arange(n), length)
    counts = np.bincount(by_byte * _CLASSES + _CLASS[data], minlength=n * _CLASSES)[:n * _CLASSES].reshape(n, _CLASSES)
    w = words.words(texts)
    full = length > 0
    line_of = np.flatnonzero(full)[np.searchsorted(starts[full], w.start, "right") - 1] if len(w.start) else np.zeros(0, np.int64)
    n_words = np.bincount(line_of, minlength=n)[:n]
    same = (w.hash[1:] == w.hash[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[1:][same], minlength=n)[:n]
    marked = np.isin(_CLASS[data[w.end - 1]], (5, 6, 7)) if len(w.end) else np.zeros(0, bool)
    share = lambda x: x / np.maximum(n_words, 1)
    features = np.column_stack([counts / np.maximum(length, 1)[:, None], np.log1p(length), share(length - counts[:, 3]) / 10,
                                share(repeats), share(np.bincount(line_of[marked], minlength=n)[:n])])
    return Lines(features.astype(np.float32), np.maximum(length, 1), np.searchsorted(text, np.arange(len(texts) + 1)))


def design(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Standardised features of a line, of its neighbours (zero beyond the text), and flags of the text's borders."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    starts, ends = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    full = first[1:] > first[:-1]
    starts[first[:-1][full]] = True
    ends[first[1:][full] - 1] = True
    before[starts] = 0
    after[ends] = 0
    return np.column_stack([rows, before, after, starts, ends, np.ones(len(rows))])


def chain(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginals of "good" per line, log partition per text, and, if asked, expected moves per text.

    All texts advance together, the longest first, so a step handles every text
    that still has a line. Messages are scaled at each step.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at = first[:-1][order]
    n = n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t lines
    s = np.clip(scores, -30, 30)
    good = 1 / (1 + np.exp(-s))
    emit = np.stack([1 - good, good], axis=1)
    step = np.exp(moves)
    alpha, scale = np.zeros_like(emit), np.ones(len(s))
    for t in range(longest):
        k = at[:live[t]] + t
        a = emit[k] * (alpha[k - 1] @ step if t else 1.0)
        scale[k] = a.sum(axis=1)
        alpha[k] = a / scale[k][:, None]
    beta = np.ones_like(emit)
    for t in range(longest - 2, -1, -1):
        k = at[:live[t + 1]] + t
        beta[k] = (emit[k + 1] * beta[k + 1] / scale[k + 1][:, None]) @ step.T
    both = alpha * beta
    marginal = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    logs = np.log(scale) + np.logaddexp(0, s)
    partition = np.add.reduceat(np.append(logs, 0), np.minimum(first[:-1], len(logs))) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0)
    if not pairs:
        return marginal, partition
    later = np.ones(len(s), bool)
    later[first[:-1][np.diff(first) > 0]] = False
    k = np.flatnonzero(later)
    moved = alpha[k - 1][:, :, None] * step[None] * (emit[k] * beta[k] / scale[k][:, None])[:, None, :]
    return marginal, partition, moved.sum(axis=0)


def _minimise(value_and_slope, x: np.ndarray, rounds: int) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = slope.copy(), []
        for ds, dg in reversed(past):
            a = (ds @ q) / (ds @ dg)
            q -= a * dg
            used.append(a)
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (ds, dg), a in zip(past, reversed(used)):
            q += ds * (a - (dg @ q) / (ds @ dg))
        size = 1.0 if past else 1.0 / max(1.0, float(np.abs(slope).max()))
        for _ in range(30):
            new, new_slope = value_and_slope(x - size * q)
            if new <= value - 1e-4 * size * (q @ slope):
                break
            size /= 2
        else:
            return x
        ds, dg = -size * q, new_slope - slope
        if ds @ dg > 1e-12:
            past = [*past[-7:], (ds, dg)]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, slope = x - size * q, new, new_slope
        if done:
            break
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logit(x):
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x))


def document_share(marginal: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean marginal per text, weighted by line length."""
    run = lambda x: np.add.reduceat(x, first[:-1])
    return run(marginal * length) / run(length.astype(float))


def fit(found: Lines, labels: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """A model from texts and their labels (0 or 1); ``None`` unless both labels occur."""
    if len(set(labels.tolist())) < 2:
        return None
    mean, scale = found.features.mean(axis=0), found.features.std(axis=0) + 1e-3
    x = design((found.features - mean) / scale, found.first).astype(np.float64)
    each = np.diff(found.first)
    y = np.repeat(labels, each)
    width = x.shape[1]
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = np.maximum(each[labels == label] - 1, 0).sum()

    def loss(p):
        w, moves = p[:width], p[width:].reshape(2, 2)
        marginal, partition, moved = chain(x @ w, found.first, moves, pairs=True)
        value = partition.sum() - (x @ w) @ y - (moves * seen).sum()
        slope = np.concatenate([x.T @ (marginal - y), (moved - seen).ravel()])
        return value / len(y) + _L2 * p @ p, slope / len(y) + 2 * _L2 * p

    p = _minimise(loss, np.zeros(width + 4), rounds)
    w, moves = p[:width], p[width:].reshape(2, 2)
    share = _logit(document_share(chain(x @ w, found.first, moves)[0], found.length, found.first))

    def curve(c):
        z = c[0] * share + c[1]
        return (np.logaddexp(0, z) - labels * z).mean() + 1e-3 * c @ c, \
            np.array([((_sigmoid(z) - labels) * share).mean(), (_sigmoid(z) - labels).mean()]) + 2e-3 * c

    a, b = _minimise(curve, np.array([1.0, 0.0]), 50)
    return Model(mean, scale, w, moves, (float(a), float(b)))


def score_lines(found: Lines, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of "good" per line, score per text)."""
    x = design((found.features - model.mean) / model.scale, found.first)
    marginal, _ = chain(x @ model.weights, found.first, model.moves)
    a, b = model.curve
    return marginal, _sigmoid(a * _logit(document_share(marginal, found.length, found.first)) + b)


def held_out(doc_id) -> F.Column:
    """True where the CRC of the id's text is a multiple of five; false without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            found = lines(texts)
            bounds = found.first.tolist()
            yield pa.record_batch(
                [batch.column("label").slice(at, len(texts)),
                 pa.array([found.features[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                 pa.array([found.length[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                ["label", "features", "length"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int, wanted: str = "label IS NOT NULL") -> DataFrame:
    """(text, label) of at most ``sample`` labelled documents outside the held-out part, by a hash of their ids.

    Labels of ids that are not among ``docs`` and documents of more than ``MAX_LINES`` lines are passed over before the
    sample is taken. An id with two different labels teaches nothing; one with several texts teaches its smallest.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("label")) \
        .filter("id IS NOT NULL AND label IS NOT NULL").filter(wanted).filter(~held_out(F.col("id"))) \
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")) \
        .filter(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) < MAX_LINES)
    picked = ids.join(texts.select("id").distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(sample)
    return texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the labelled documents; ``labels`` has (doc_id, quality)."""
    rows = labelled(docs, labels, "quality", sample, "label IN (0, 1)").mapInArrow(
        _features, "label int, features binary, length binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))  # sums do not depend on the order of tasks
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows])
    length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in rows])
    first = np.cumsum([0, *(len(r["length"]) // 8 for r in rows)])
    return fit(Lines(features, length, first), np.array([r["label"] for r in rows]))


SCORES = "doc_id long, score double, n_lines long, n_good long"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, score, n_lines, n_good): score in [0, 1], lines, and lines more likely good than bad.

    A null text counts as empty; an empty text is one empty line. A null doc_id
    stays null; repeated rows get equal scores. Without a model every score is
    0.5. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in words.slices(batch.column("text")):
                found = lines(texts)
                n = np.diff(found.first)
                if model is None:
                    scores, good = np.full(len(texts), 0.5), n
                else:
                    marginal, scores = score_lines(found, model)
                    good = np.add.reduceat((marginal >= 0.5).astype(np.int64), found.first[:-1])
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(scores), pa.array(n.astype(np.int64)), pa.array(good.astype(np.int64))],
                                      ["doc_id", "score", "n_lines", "n_good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCORES)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, n_lines, n_good) for every row of ``docs``."""
    return score(docs, train(docs, labels, sample)).withColumns({
        "held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept, in one pass over the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None:
                yield batch
                continue
            good = np.concatenate([np.zeros(0, bool), *(score_lines(lines(texts), model)[1] >= threshold for _, texts in words.slices(batch.column("text")))])
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(task, docs.schema)
