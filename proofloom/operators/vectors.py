"""Vectors: unit length, text embedding, nearest rows by cosine.

Scores are matrix products on Arrow batches. The smaller side travels to the
tasks only while it stays under a row bound; beyond it both sides are cut into
blocks and joined block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.tables import BLANK
from ..functions.text import col, has_text, let, with_instruction
from ..session import collect_if_small, top_n
from .lexical import Tokenizer, words
from .model import call_model

TINY = 1e-9
MAX_SHIPPED = 4096          # rows of the smaller side sent to every task
BLOCK = 4096                # rows per block on each side beyond that
DIGITS = 6                  # scores are compared after rounding
ROWS_AT_ONCE = 1024         # rows scored by one matrix product
TOP = "array<struct<code:string,score:double>>"


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v) -> Column:
    """Vector of length one; a near-zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n < TINY, F.transform(col(v), lambda x: x.cast("double"))).otherwise(
        F.transform(col(v), lambda x: x.cast("double") / n)))


def is_empty(v) -> Column:
    return col(v).isNull() | (F.size(col(v)) == 0) | (norm(v) < TINY)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def hashing_vector(c, dim: int = 64, tokenizer: Tokenizer = words) -> Column:
    """Signed feature hashing of a text's tokens, unit length; NULL stays NULL.

    A token's code is the first 16 bits of its MD5: modulo ``dim`` it names the
    place, its bit 8 the sign. Codes are made in the JVM and counted in
    Arrow batches. Tokens that cancel each other everywhere give zeros.
    """
    def vector(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda v: None if v is None else _counted(np.asarray(v, np.int64), dim))

    return F.pandas_udf(vector, "array<double>")(token_codes(c, tokenizer))


def token_codes(c, tokenizer: Tokenizer = words) -> Column:
    """The code of every token of a text."""
    return F.transform(tokenizer(c), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int"))


def _counted(numbers: np.ndarray, dim: int) -> np.ndarray:
    x = np.bincount(numbers % dim, weights=1.0 - 2.0 * ((numbers >> 8) & 1), minlength=dim)
    length = np.linalg.norm(x)
    return x if length < TINY else x / length


def embed(rows: DataFrame, text: str = "text", out: str = "embedding", dim: int = 64,
          count: str | None = "char_count") -> DataFrame:
    """Built-in embedding; rows without text get NULL. Rows and order are kept."""
    usable = has_text(F.coalesce(F.col(text), F.lit("")))
    if count:
        usable = usable & (F.col(count) > 0)
    return rows.withColumn(out, F.when(usable, hashing_vector(text, dim)))


def embed_with(rows: DataFrame, fn, text: str = "text", out: str = "embedding", dim: int | None = None, batch: int = 20, tries: int = 3,
               wait: float = 1.0, parallel: int | None = None) -> DataFrame:
    """The caller's embedder: adds ``out`` and ``<out>_error``; rows are kept.

    ``fn`` gets up to ``batch`` texts and returns as many vectors in order. Rows without text are not sent and get
    NULL without an error. A batch that fails ``tries`` times, or returns too few vectors or vectors
    of another length than ``dim``, gives NULL and the reason; other batches go on.
    """
    def asked(items: list[tuple]) -> list:
        sent = [i for i, (t,) in enumerate(items) if t is not None and t.strip(BLANK)]
        found = list(fn([items[i][0] for i in sent])) if sent else []
        if len(found) != len(sent):
            raise ValueError(f"{len(found)} vectors for {len(sent)} texts")
        if dim is not None and any(len(v) != dim for v in found):
            raise ValueError(f"a vector has not {dim} values")
        vectors = dict(zip(sent, found))
        return [[float(x) for x in vectors[i]] if i in vectors else None for i in range(len(items))]

    return call_model(rows, [text], asked, out, "array<double>", batch, tries, wait, parallel)


def sample_answer() -> Column:
    """A leaf's sample answer, else its query."""
    return F.coalesce(F.nullif(F.trim(F.col("hypothetical_doc")), F.lit("")), F.col("retrieval_query"))


def embed_queries(leaves: DataFrame, instruction: str = "", dim: int = 64) -> DataFrame:
    """Two vectors per leaf: its query, and its sample answer (else the query)."""
    return leaves.withColumn(
        "rq", hashing_vector(with_instruction(instruction, "retrieval_query"), dim)
    ).withColumn("hyde", hashing_vector(sample_answer(), dim))


def split_ready(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with a query text, and those set aside for lack of one."""
    ready = has_text(F.coalesce(F.col("retrieval_query"), F.lit("")))
    return leaves.filter(ready), leaves.filter(~ready).withColumn("reason", F.lit("no retrieval_query"))


def indicator_vectors(vectors: DataFrame) -> DataFrame:
    """Usable indicator vectors (failed ones dropped)."""
    return vectors.filter(~is_empty("embedding"))


def matrix(vectors) -> np.ndarray:
    """Rows of unit length from a column of arrays, in double precision."""
    rows = list(vectors)
    if not rows:
        return np.zeros((0, 0))
    m = np.stack(rows).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length < TINY, 1.0, length)


def has_vector(v) -> Column:
    """Cheap test in the scan; near-zero vectors are dropped where lengths are known."""
    return col(v).isNotNull() & (F.size(col(v)) > 0)


def usable_rows(batch: pd.DataFrame, column: str = "v") -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of a batch whose vector is not near zero, and their unit vectors."""
    if batch.empty:
        return batch, np.zeros((0, 0))
    x = np.stack(batch[column].tolist()).astype(np.float64)
    length = np.linalg.norm(x, axis=1)
    good = length >= TINY
    if not good.all():
        batch, x, length = batch[good], x[good], length[good]
    return batch, x / length[:, None]


def nearest(rows: DataFrame, row_id: str, targets: DataFrame, target_id: str, k: int = fixed.TOP_K,
            vector: str = "embedding", shipped: int = MAX_SHIPPED) -> DataFrame:
    """The ``k`` targets closest to every row: (row_id, code, score, rank).

    ``targets`` up to ``shipped`` rows go to every task and the rows are
    scored where they lie, without a shuffle. More targets are scored block by
    block and merged per row.
    """
    rows = rows.filter(has_vector(vector)).select(F.col(row_id), F.col(vector).alias("v"))
    targets = targets.filter(~is_empty(vector)).select(
        F.col(target_id).cast("string").alias("code"), F.col(vector).alias("v"))
    schema = T.StructType([rows.schema[row_id], T.StructField("code", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def best(ids, x: np.ndarray, codes: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        scores = np.round(x @ y.T, DIGITS)
        # codes are sorted, so a stable sort breaks ties by code
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        n, width = top.shape
        return pd.DataFrame({
            row_id: np.repeat(np.asarray(ids), width), "code": codes[top].ravel(),
            "score": np.take_along_axis(scores, top, 1).ravel(),
            "rank": np.tile(np.arange(1, width + 1), n).astype("int32")})

    small = collect_if_small(targets, shipped)
    if small is not None:
        small = sorted(small, key=lambda r: r["code"])
        codes = np.array([r["code"] for r in small], dtype=object)
        table = rows.sparkSession.sparkContext.broadcast(matrix([r["v"] for r in small]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch, x = usable_rows(batch)
                if len(batch) and len(codes):
                    yield best(batch[row_id], x, codes, table.value)

        return rows.mapInPandas(scan, schema)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        right = right.sort_values("code")
        left, x = usable_rows(left)
        return best(left[row_id], x, right["code"].to_numpy(dtype=object), matrix(right["v"]))

    left, right = blocks(rows, row_id, targets, "code")
    scored = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(pair, schema)
    return top_n(scored.drop("rank"), [row_id], [F.desc("score"), F.col("code")], k)


def with_nearest(rows: DataFrame, row_id: str, targets: DataFrame, target_id: str, k: int = fixed.TOP_K, out: str = "top",
                 vector: str = "embedding", shipped: int = MAX_SHIPPED) -> DataFrame:
    """All rows with their ``k`` closest targets as one array of (code, score), best first; empty without a usable vector.

    Targets up to ``shipped`` rows are scored as a column of the vector alone: no row moves, and columns that nobody
    reads later are not read here. More targets go through :func:`nearest` and a join of the ids.
    """
    usable = targets.filter(~is_empty(vector)).select(F.col(target_id).cast("string").alias("code"), F.col(vector).alias("v"))
    small = collect_if_small(usable, shipped)
    if small is None:
        ranked = nearest(rows, row_id, targets, target_id, k, vector, shipped)
        lists = ranked.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))).alias("__l"))
        joined = rows.join(lists, row_id, "left")
        shown = F.transform("__l", lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score")))
        return joined.withColumn(out, F.coalesce(shown, F.array().cast(TOP))).drop("__l")
    small = sorted(small, key=lambda r: r["code"])
    codes = pa.array([r["code"] for r in small], pa.string())
    table = rows.sparkSession.sparkContext.broadcast(matrix([r["v"] for r in small]))

    @F.arrow_udf(TOP)
    def lists(v: pa.Array) -> pa.Array:
        y = table.value
        found = [_lists(v.slice(low, ROWS_AT_ONCE), y, codes, k) for low in range(0, len(v), ROWS_AT_ONCE)]
        return pa.concat_arrays(found) if found else pa.array([], LISTS)

    return rows.withColumn(out, lists(col(vector)))


LISTS = pa.list_(pa.struct([("code", pa.string()), ("score", pa.float64())]))


def _lists(v: pa.Array, y: np.ndarray, codes: pa.Array, k: int) -> pa.Array:
    """Best ``k`` codes per vector, ties by code (``codes`` are sorted); vectors that are missing, near zero or of another length get none."""
    dim = y.shape[1]
    right = pc.fill_null(pc.equal(pc.list_value_length(v), dim), False) if len(codes) else pa.array([False] * len(v), pa.bool_())
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    x = pc.list_flatten(v.filter(right)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim) if len(at) else np.zeros((0, dim))
    length = np.linalg.norm(x, axis=1)
    good = length >= TINY
    at, x = at[good], x[good] / length[good, None]
    scores = np.round(x @ y.T, DIGITS) if len(at) else np.zeros((0, len(codes)))
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    sizes = np.zeros(len(v) + 1, np.int32)
    sizes[at + 1] = best.shape[1]
    entries = pa.StructArray.from_arrays([codes.take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel())], ["code", "score"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), entries)


def blocks(rows: DataFrame, row_id: str, targets: DataFrame, target_id: str,
           size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides cut into hash blocks of about ``size`` and paired block by block."""
    m = max(1, -(-rows.count() // size))
    n = max(1, -(-targets.count() // size))
    own = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("bi", own(row_id, m)).withColumn("bj", every(n))
    right = targets.withColumn("bj", own(target_id, n)).withColumn("bi", every(m))
    return left, right


def dual_scores(pool: DataFrame, leaves: DataFrame, vector: str = "embedding",
                shipped: int = MAX_SHIPPED) -> DataFrame:
    """Both route scores and their maximum for every (leaf, chunk).

    The result has one row per pair by definition; top-k fusion does not use
    it but scores and cuts in one pass.
    """
    rows = pool.filter(has_vector(vector)).select("chunk_id", F.col(vector).alias("v"))
    asked = leaves.select(F.col("leaf_id").cast("string").alias("leaf_id"), "rq", "hyde")
    schema = ("leaf_id string, chunk_id string, score_rq double, score_hyde double, score double")

    def score(ids, x, names, rq, hyde) -> pd.DataFrame:
        a, b = np.round(x @ rq.T, DIGITS), np.round(x @ hyde.T, DIGITS)
        return pd.DataFrame({
            "leaf_id": np.tile(names, len(x)), "chunk_id": np.repeat(np.asarray(ids), len(names)),
            "score_rq": a.ravel(), "score_hyde": b.ravel(), "score": np.maximum(a, b).ravel()})

    rows = rows.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    small = collect_if_small(asked, shipped)
    if small is not None:
        names = np.array([r["leaf_id"] for r in small], dtype=object)
        shipped_pair = rows.sparkSession.sparkContext.broadcast(
            (matrix([r["rq"] for r in small]), matrix([r["hyde"] for r in small])))

        def scan(batches):
            for batch in batches:
                batch, x = usable_rows(batch)
                if len(batch) and len(names):
                    yield score(batch["chunk_id"], x, names, *shipped_pair.value)

        return rows.mapInPandas(scan, schema)

    def pair(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"leaf_id": [], "chunk_id": [], "score_rq": [], "score_hyde": [], "score": []})
        left, x = usable_rows(left)
        return score(left["chunk_id"], x, right["leaf_id"].to_numpy(dtype=object),
                     matrix(right["rq"]), matrix(right["hyde"]))

    left, right = blocks(rows, "chunk_id", asked, "leaf_id")
    return left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(pair, schema)
