"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``HASHES`` Gaussian projections, each cut into cells of a
common width with a random shift; the cells together are its bucket. A query visits its own
bucket and ``PROBES`` perturbed ones per table. A perturbation moves some projections to
the next cell below or above; its score is the sum of squared distances to the borders
crossed, and the lowest scores, which are the likeliest to succeed, are visited first.
The candidates of all tables are merged and ranked by their exact distance.

Index fit: the cell width comes from the distances of a sample of at most ``SAMPLE``
vectors, picked by a hash of their ids. Every vector is indexed: each batch of rows is hashed once and looked up
in the probes of all queries, which are sent in blocks of bounded size. A task keeps the
best ``k`` ids per query, so what is shuffled is queries times tasks times ``k`` rows.
A query that found fewer than ``k`` rows in its buckets is answered by a full scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, work_folder

TABLES, HASHES, PROBES = 16, 8, 120
WIDTH = 1.6
SAMPLE = 1000
BLOCK_BYTES = 16 << 20
SEED = 7

FOUND = "query_id long, vec_id long, score double"


class Probes(NamedTuple):
    """Queries of one block, and per table the bucket codes they visit, in order, with the query's place."""

    ids: np.ndarray
    vectors: np.ndarray
    codes: list[np.ndarray]
    owners: list[np.ndarray]


class Family(NamedTuple):
    """Projections (tables x hashes x dimensions), shifts in cells, and the cell width."""

    directions: np.ndarray
    shifts: np.ndarray
    width: float


def family(dimensions: int, width: float, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> Family:
    random = np.random.Generator(np.random.PCG64(seed))
    return Family(random.standard_normal((tables, hashes, dimensions)), random.random((tables, hashes)), width)


def places(f: Family, vectors: np.ndarray) -> np.ndarray:
    """Position of every vector on every projection, in cells: tables x vectors x hashes."""
    return np.einsum("thd,nd->tnh", f.directions, vectors, optimize=True) / f.width + f.shifts[:, None, :]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_MIX = np.concatenate([_MIX, _MIX * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)])


def codes(cells: np.ndarray) -> np.ndarray:
    """One 64-bit code per bucket, from its cells (last axis)."""
    hashed = (cells.astype(np.int64).view(np.uint64) * _MIX[:cells.shape[-1]]).sum(axis=-1)
    hashed ^= hashed >> np.uint64(29)
    return hashed * np.uint64(0xBF58476D1CE4E5B9)


def perturbations(rest: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """The ``n`` best sets of moves (hash, -1 or +1) for fractional positions ``rest``, best first.

    Single moves are sorted by squared distance to their border. A heap grows sets of
    places in that order by shifting the last place or adding the next one; sets that
    move one projection both ways are skipped.
    """
    moves = sorted([(float(x) ** 2, j, -1) for j, x in enumerate(rest)] + [(float(1 - x) ** 2, j, 1) for j, x in enumerate(rest)])
    heap, out = [(moves[0][0], (0,))], []
    while heap and len(out) < n:
        total, picked = heapq.heappop(heap)
        last = picked[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (total - moves[last][0] + moves[last + 1][0], (*picked[:-1], last + 1)))
            heapq.heappush(heap, (total + moves[last + 1][0], (*picked, last + 1)))
        if len({moves[i][1] for i in picked}) == len(picked):
            out.append([moves[i][1:] for i in picked])
    return out


def visited_codes(f: Family, vectors: np.ndarray, n: int) -> np.ndarray:
    """Bucket codes that every vector visits, its own first: vectors x tables x (n + 1)."""
    at = places(f, vectors)
    base = np.floor(at).astype(np.int64)
    out = np.empty((len(vectors), len(at), n + 1), np.uint64)
    for t, table in enumerate(at):
        for q in range(len(vectors)):
            cells = np.repeat(base[t, q][None], n + 1, axis=0)
            for i, moves in enumerate(perturbations(table[q] - base[t, q], n), 1):
                for j, step in moves:
                    cells[i, j] += step
            out[q, t] = codes(cells)
    return out


def probes(ids: np.ndarray, vectors: np.ndarray, visited: np.ndarray) -> Probes:
    """A block of queries with their codes in order, per table."""
    found, owners = [], []
    for table in visited.transpose(1, 0, 2):
        flat = table.ravel()
        order = np.argsort(flat, kind="stable")
        found.append(flat[order])
        owners.append(order // table.shape[1])
    return Probes(ids, vectors, found, owners)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` (id, score) by score and id, each id once with its smallest score."""
    order = np.lexsort((ids, scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def _nearest(ids: np.ndarray, vectors: np.ndarray, block: Probes, reached: np.ndarray | None, k: int) -> Iterator[tuple]:
    """(query, ids, scores) of the best ``k`` rows per query, exact distances, ties to smaller ids.

    ``reached`` marks candidate rows per query; without it every row is one.
    A matrix product finds who can be among the best, with room for its rounding. Rows
    that share an id count once, before the cut: without repeats the k-th row is the edge,
    with them the k-th of the smallest distances per id.
    """
    square = (vectors**2).sum(axis=1)
    names, name = np.unique(ids, return_inverse=True)
    for low in range(0, len(block.ids), 256):
        part = block.vectors[low:low + 256]
        rough = square[None] + (part**2).sum(axis=1)[:, None] - 2 * part @ vectors.T
        for i in range(len(part)):
            row = np.flatnonzero(reached[low + i] & (ids != block.ids[low + i])) if reached is not None else np.flatnonzero(ids != block.ids[low + i])
            if not len(row):
                continue
            if len(row) > k:
                r = rough[i][row]
                if len(names) < len(ids):
                    least = np.full(len(names), np.inf)
                    np.minimum.at(least, name[row], r)
                    edge = np.partition(least, k - 1)[k - 1] if k <= len(names) else np.inf
                else:
                    edge = np.partition(r, k - 1)[k - 1]
                row = row[r <= edge + 1e-9 * (1 + abs(edge) + float((part[i]**2).sum()))]
            exact = np.sqrt(((vectors[row] - part[i])**2).sum(axis=1))
            yield low + i, *_best(ids[row], exact, k)


def _usable(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors in double precision) of the rows that take part: right length, finite, not all zero."""
    column = batch.column("embedding")
    ids = batch.column("vec_id")
    good = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False), pc.is_valid(ids))
    column, ids = column.filter(good), ids.filter(good)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros((0, dimensions))
    vectors = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(invalid="ignore"):
        sound = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)[sound], vectors[sound]


def _searcher(shared, dimensions: int, k: int, full: bool):
    """A task that keeps the best ``k`` rows per query over all its batches and writes them at its end."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, block = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                ids, vectors = _usable(batch.slice(low, 4096), dimensions)
                if not len(ids):
                    continue
                reached = None
                if not full:
                    reached = np.zeros((len(block.ids), len(ids)), bool)
                    for table, code, owner in zip(places(f, vectors), block.codes, block.owners):
                        bucket, inverse = np.unique(codes(np.floor(table)), return_inverse=True)
                        visited = np.zeros((len(block.ids), len(bucket)), bool)
                        spot = np.minimum(np.searchsorted(bucket, code), len(bucket) - 1)
                        there = bucket[spot] == code
                        visited[owner[there], spot[there]] = True
                        reached |= visited[:, inverse]
                for q, near, score in _nearest(ids, vectors, block, reached, k):
                    if q in kept:
                        near, score = _best(np.concatenate([kept[q][0], near]), np.concatenate([kept[q][1], score]), k)
                    kept[q] = (near, score)
        if kept:
            yield pa.record_batch([pa.array(np.concatenate([np.full(len(n), block.ids[q]) for q, (n, _) in kept.items()])),
                                   pa.array(np.concatenate([n for n, _ in kept.values()])), pa.array(np.concatenate([s for _, s in kept.values()]))],
                                  ["query_id", "vec_id", "score"])
    return task


def _prober(f: Family, n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, vectors = _usable(part, f.directions.shape[2])
                yield pa.record_batch([pa.array(ids), pa.array([v.tobytes() for v in vectors], pa.binary()),
                                       pa.array([c.tobytes() for c in visited_codes(f, vectors, n)], pa.binary())], ["vec_id", "vector", "codes"])
    return task


def _blocks(probed: DataFrame, f: Family, rows: int) -> Iterator[Probes]:
    """Queries with their codes, ``rows`` of them at a time."""
    held: list = []

    def block() -> Probes:
        vectors = np.array([np.frombuffer(r[1], np.float64) for r in held])
        visited = np.array([np.frombuffer(r[2], np.uint64) for r in held]).reshape(len(held), len(f.directions), -1)
        return probes(np.array([r[0] for r in held]), vectors, visited)

    for row in probed.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield block()
            held = []
    if held:
        yield block()


def sound(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector has the right length, no null or non-finite component, and is not all zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size(x) == dimensions) & finite & F.exists(x, lambda v: v != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, hashes: int = HASHES, n_probes: int = PROBES,
           width: float = WIDTH, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest rows found for every query.

    ``vectors`` and ``queries`` have (vec_id, embedding). ``score`` is the Euclidean
    distance in double precision; ties go to the smaller vec_id; a row is no
    neighbour of its own id. The length of most vectors of the sample counts as right.

    Vectors that are null, all zero, of another length, or hold a null or non-finite
    component take no part, nor do rows without id. A repeated row counts once. Fewer
    than ``k`` other rows: all of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    seen = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    out = spark.createDataFrame([], FOUND)
    if seen:
        sizes, times = np.unique([len(r["embedding"]) for r in seen], return_counts=True)
        dimensions = int(sizes[times.argmax()])
        some = np.array([r["embedding"] for r in seen if len(r["embedding"]) == dimensions and None not in r["embedding"]], float).reshape(-1, dimensions)
        some = some[np.isfinite(some).all(axis=1)]
        f = family(dimensions, width * _near_distance(some), tables, hashes)
        asked = sound(queries.select("vec_id", "embedding").dropDuplicates(["vec_id"]), dimensions)
        probed = cut_lineage(asked.mapInArrow(_prober(f, n_probes), "vec_id long, vector binary, codes binary"))
        rows = max(1, block_bytes // (8 * dimensions + 16 * tables * (n_probes + 1)))
        folder = f"{work_folder(spark)}/found"
        out.write.parquet(folder)  # so that the folder exists without queries

        def scan(block: Probes, full: bool) -> None:
            """One pass over the vectors for one block; its rows join those of the others, and no plan grows with the blocks."""
            task = _searcher(spark.sparkContext.broadcast((f, block)), dimensions, k, full)
            vectors.mapInArrow(task, FOUND).write.mode("append").parquet(folder)

        for block in _blocks(probed, f, rows):
            scan(block, False)
        found = spark.read.schema(FOUND).parquet(folder)
        enough = found.groupBy(F.col("query_id").alias("__q")).agg(F.countDistinct("vec_id").alias("__n")).filter(F.col("__n") >= k)
        short = cut_lineage(probed.join(enough, F.col("vec_id") == F.col("__q"), "left_anti"))
        for block in _blocks(short, f, rows):
            scan(block, True)
        found = spark.read.schema(FOUND).parquet(folder)
        out = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near_distance(some: np.ndarray) -> float:
    """Median distance to the nearest other vector of the sample; 1 where there is none above zero."""
    if len(some) < 2:
        return 1.0
    square = (some**2).sum(axis=1)
    all_pairs = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * some @ some.T, 0))
    np.fill_diagonal(all_pairs, np.inf)
    nearest = all_pairs.min(axis=1)
    positive = nearest[nearest > 1e-9]
    return float(np.median(positive)) if len(positive) else 1.0
