"""Candidate pool, reciprocal rank fusion and rerank.

``fuse`` finds the exact best chunks per leaf without listing all pairs. One
scan keeps, per leaf, route and class, the best ``depth`` chunks. A second scan
counts how many chunks stand before each kept one, which gives true ranks. A
chunk that was not kept ranks behind the last kept one of its class in both
routes, so its fused score has an upper bound; a leaf whose k-th result does
not beat that bound is searched again deeper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import is_photo, rank_source, score_source
from ..session import broadcast_if_small, cut_lineage, top_n
from .ranking import global_rank
from .vectors import DIGITS, dual_scores, has_vector, is_empty, matrix, usable_rows

LEAF_BLOCK = 512            # leaves searched in one round
DEPTH = 256                 # chunks kept per leaf, route and class at first
DEPTH_LIMIT = 16384         # deeper leaves get a full ranking
KEPT_ROWS = 1_000_000       # kept chunks (3 classes, 2 routes) of the leaves searched together
MATCH, PLAIN, PENALTY = 0, 1, 2
RESULT = ("leaf_id string, rank int, chunk_id string, parent_id string, score double, score_rq double, "
          "score_hyde double, score_bm25 double, rank_rq long, rank_hyde long, rank_bm25 long, "
          "source string, fusion_mode string, score_raw double")


def candidate_reasons(chunks: DataFrame, vectors: DataFrame, alignment: DataFrame,
                      min_score: float = fixed.MIN_SCORE) -> DataFrame:
    """Chunks with the reason each is left out of the pool (NULL: it is in).

    ``alignment`` holds (chunk_id, top1). Reasons are tried in this order:
    no vector, not aligned, low score, photo.
    """
    # phrase and vector are tested where they are read: texts that nobody reads later are not shuffled
    joined = chunks.withColumn("__photo", is_photo("text")).join(
        vectors.select("chunk_id", "embedding", is_empty("embedding").alias("__empty")), "chunk_id", "left").join(
        alignment.select("chunk_id", "top1"), "chunk_id", "left")
    reason = (
        F.when(F.coalesce("__empty", F.lit(True)), "invalid_embedding")
        .when(F.col("top1").isNull(), "not_in_table")
        .when(F.col("top1") < min_score, "low_score")
        .when(F.col("__photo"), "photo"))
    return joined.withColumn("reason", reason).drop("__photo", "__empty")


def candidate_pool(reasons: DataFrame) -> DataFrame:
    return reasons.filter(F.col("reason").isNull()).drop("reason")


def exclusion_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count("*").alias("chunks"))


def route_ranks(pool: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rank of every chunk for every leaf in both vector routes.

    Each leaf holds the whole pool, so ranks come from range partitions
    instead of one window task per leaf.
    """
    pairs = dual_scores(pool, leaves)
    rq = global_rank(pairs, ["leaf_id"], [F.desc("score_rq"), F.col("chunk_id")], "rank_rq")
    return global_rank(rq, ["leaf_id"], [F.desc("score_hyde"), F.col("chunk_id")], "rank_hyde")


def adjustment(match: Column, status: Column, boost: float = fixed.FOLDER_BOOST) -> Column:
    """Boost for a chunk filed under the leaf's code, penalty if it is misplaced."""
    bad = F.coalesce(status == "misplaced", F.lit(False))
    return F.when(match & ~bad, boost).when(match & bad, -boost * 0.5).otherwise(0.0)


def rrf_score(ranks: list[Column], k: int = fixed.RRF_K) -> Column:
    """Sum of 1 / (k + rank) over the routes that rank the row."""
    total = F.lit(0.0)
    for rank in ranks:
        total = total + F.coalesce(1.0 / (F.lit(k) + rank), F.lit(0.0))
    return total


def top_per_parent(fused: DataFrame, k: int, bounded: bool = False) -> DataFrame:
    """Best chunk of every parent, then the best ``k`` of every leaf.

    A missing parent counts as a parent of its own. Leaves with a bounded
    number of rows are placed once, which serves both steps.
    """
    pieces = 1 if bounded else 64
    if bounded:
        fused = fused.repartition("leaf_id")
    parent = F.coalesce(F.nullif("parent_id", F.lit("")), F.concat(F.lit("\u0000"), F.col("chunk_id")))
    order = [F.desc("score"), F.col("chunk_id")]
    first = top_n(fused.withColumn("__parent", parent), ["leaf_id", "__parent"], order, 1, "__one", pieces)
    return top_n(first.drop("__one", "__parent"), ["leaf_id"], order, k, pieces=pieces)


# --- scan 1: keep the best chunks per leaf, route and class ---------------------------

def _classes(codes: np.ndarray, statuses: np.ndarray, code) -> np.ndarray:
    """Class of each chunk for one leaf: boosted, plain or penalised."""
    match = (codes == code) & (code is not None) & (code != "")
    bad = statuses == "misplaced"
    return np.where(match & ~bad, MATCH, np.where(match & bad, PENALTY, PLAIN)).astype("int8")


def _cut(frame: pd.DataFrame, depth: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """Rows among the best ``depth`` of their leaf and class in either route.

    ``floors[route, leaf, class]`` takes the last kept score of full lists.
    """
    frame = frame.sort_values("chunk_id", kind="stable")
    group = [frame["leaf"], frame["cls"]]
    keep = np.zeros(len(frame), dtype=bool)
    for i, route in enumerate(("score_rq", "score_hyde")):
        place = (-frame[route]).groupby(group).rank(method="first")
        keep |= (place <= depth).to_numpy()
        if floors is not None:
            edge = frame[(place == depth).to_numpy()]
            floors[i, edge["leaf"], edge["cls"]] = edge[route]
    return frame[keep]


def _keep_best(pool: DataFrame, leaves: list, shared, depth: int) -> DataFrame:
    schema = ("leaf int, cls byte, chunk_id string, parent_id string, "
              "score_rq double, score_hyde double")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rq, hyde, codes = shared.value
        floors = np.full((2, len(codes), 3), -np.inf)
        kept, limit = None, 0
        for batch in batches:
            batch, x = usable_rows(batch)
            if batch.empty:
                continue
            a, b = np.round(x @ rq.T, DIGITS), np.round(x @ hyde.T, DIGITS)
            ids, parents = batch["chunk_id"].to_numpy(), batch["parent_id"].to_numpy()
            folders, statuses = batch["folder_code"].to_numpy(), batch["status"].to_numpy()
            parts = [] if kept is None else [kept]
            for i, code in enumerate(codes):
                cls = _classes(folders, statuses, code)
                # rows below the last place of both full lists cannot enter them
                at = np.flatnonzero((a[:, i] >= floors[0, i, cls]) | (b[:, i] >= floors[1, i, cls]))
                if len(at):
                    parts.append(pd.DataFrame({
                        "leaf": np.int32(i), "cls": cls[at], "chunk_id": ids[at], "parent_id": parents[at],
                        "score_rq": a[at, i], "score_hyde": b[at, i]}))
            kept = pd.concat(parts, ignore_index=True)
            if len(kept) > limit:
                kept = _cut(kept, depth, floors)
                limit = max(100_000, 2 * len(kept))
        if kept is not None:
            yield _cut(kept, depth)

    # both routes are placed in one pass: the pool is scored once, and what its tasks kept moves once for both
    local = pool.mapInPandas(scan, schema).withColumn("__piece", F.pmod(F.spark_partition_id(), F.lit(64)))
    return _best_places(_best_places(local, ["leaf", "cls", "__piece"], depth).drop("__piece"), ["leaf", "cls"], depth)


def _best_places(rows: DataFrame, group: list[str], depth: int) -> DataFrame:
    """Rows among the best ``depth`` of their group in either route, with their places; a place beyond ``depth`` is NULL."""
    for route, place in (("score_rq", "place_rq"), ("score_hyde", "place_hyde")):
        at = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(route), F.col("chunk_id")))
        rows = rows.withColumn(place, at)
    kept = rows.filter((F.col("place_rq") <= depth) | (F.col("place_hyde") <= depth))
    return kept.withColumns({p: F.when(F.col(p) <= depth, F.col(p)) for p in ("place_rq", "place_hyde")})


# --- scan 2: count the chunks in front of every kept one ----------------------------------

def _insertion(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, key_ids: np.ndarray) -> np.ndarray:
    """How many keys sort at or before each row, by (score desc, id)."""
    left = np.searchsorted(keys, -scores, side="left")
    right = np.searchsorted(keys, -scores, side="right")
    place = left.copy()
    ties = np.nonzero(left != right)[0]
    if len(ties):
        for start in np.unique(left[ties]):
            rows = ties[left[ties] == start]
            run = key_ids[start:right[rows[0]]]
            place[rows] = start + np.searchsorted(run, ids[rows], side="right")
    return place


def _count_before(pool: DataFrame, kept: list, n_leaves: int, shared) -> DataFrame:
    """(leaf, route, chunk_id, rank) of the kept chunks, counted over the pool."""
    frame = pd.DataFrame([(r["leaf"], r["chunk_id"], r["score_rq"], r["score_hyde"]) for r in kept],
                         columns=["leaf", "chunk_id", "score_rq", "score_hyde"])
    tables = {}
    for leaf, part in frame.groupby("leaf"):
        for route, name in enumerate(("score_rq", "score_hyde")):
            part_sorted = part.sort_values(["chunk_id"]).sort_values(name, ascending=False, kind="stable")
            tables[(int(leaf), route)] = (
                -part_sorted[name].to_numpy(), part_sorted["chunk_id"].to_numpy().astype(str))
    context = pool.sparkSession.sparkContext
    sent = context.broadcast(tables)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rq, hyde, _ = shared.value
        hist = {key: np.zeros(len(keys) + 1, dtype=np.int64) for key, (keys, _) in sent.value.items()}
        seen = False
        for batch in batches:
            batch, x = usable_rows(batch)
            if batch.empty:
                continue
            seen = True
            ids = batch["chunk_id"].to_numpy().astype(str)
            scores = (np.round(x @ rq.T, DIGITS), np.round(x @ hyde.T, DIGITS))
            for (leaf, route), (keys, key_ids) in sent.value.items():
                place = _insertion(scores[route][:, leaf], ids, keys, key_ids)
                hist[(leaf, route)] += np.bincount(place, minlength=len(keys) + 1)
        if seen:
            for (leaf, route), counts in hist.items():
                at = np.nonzero(counts)[0]
                yield pd.DataFrame({"leaf": np.int32(leaf), "route": np.int32(route),
                                    "place": at.astype("int32"), "n": counts[at]})

    counts = pool.mapInPandas(scan, "leaf int, route int, place int, n long").groupBy(
        "leaf", "route", "place").agg(F.sum("n").alias("n"))
    rows = [(leaf, route, i, str(c)) for (leaf, route), (_, ids) in tables.items() for i, c in enumerate(ids)]
    places = pool.sparkSession.createDataFrame(
        pd.DataFrame(rows, columns=["leaf", "route", "place", "chunk_id"]),
        "leaf int, route int, place int, chunk_id string")
    upto = Window.partitionBy("leaf", "route").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # a group has one row per kept chunk: at most 3 * 2 * depth
    ranked = places.join(counts, ["leaf", "route", "place"], "left").withColumn(
        "rank", F.sum(F.coalesce("n", F.lit(0))).over(upto) + 1)
    return ranked.groupBy("leaf", "chunk_id").agg(
        F.max(F.when(F.col("route") == 0, F.col("rank"))).alias("rank_rq"),
        F.max(F.when(F.col("route") == 1, F.col("rank"))).alias("rank_hyde"))


# --- fusion --------------------------------------------------------------------------------

def _fused(rows: DataFrame, k_rrf: int, boost: float) -> DataFrame:
    """Score of rows that know their ranks, scores, class and route set."""
    extra = F.when(F.col("cls") == MATCH, boost).when(F.col("cls") == PENALTY, -boost * 0.5).otherwise(0.0)
    rrf = rrf_score([F.col("rank_rq"), F.col("rank_hyde"), F.col("rank_bm25")], k_rrf)
    base = F.when(F.col("by_rrf"), rrf).otherwise(F.greatest("score_rq", "score_hyde"))
    return rows.withColumn("score", base + extra)


def fuse(pool: DataFrame, leaves: DataFrame, bm25: DataFrame | None = None, k: int = fixed.COARSE_TOP,
         k_rrf: int = fixed.RRF_K, boost: float = fixed.FOLDER_BOOST, depth: int = DEPTH,
         depth_limit: int = DEPTH_LIMIT, leaf_block: int = LEAF_BLOCK) -> DataFrame:
    """Best ``k`` chunks of every leaf over two vector routes and BM25.

    ``pool`` holds (chunk_id, parent_id, folder_code, alignment_status,
    embedding), ``leaves`` (leaf_id, code, rq, hyde), ``bm25`` (leaf_id,
    chunk_id, rank, score). Leaves without a BM25 row are ranked by the larger
    cosine. One chunk per parent, order (score desc, chunk_id).
    """
    spark = pool.sparkSession
    # read several times in every round, so what the pool asks (here a join with its vectors) is done once
    rows = cut_lineage(pool.filter(has_vector("embedding")).select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("parent_id").cast("string").alias("parent_id"),
        F.col("folder_code").cast("string").alias("folder_code"),
        F.col("alignment_status").alias("status"), F.col("embedding").alias("v")))
    asked = leaves.select(F.col("leaf_id").cast("string").alias("leaf_id"),
                          F.col("code").cast("string").alias("code"), "rq", "hyde")
    lexical = None
    if bm25 is not None:
        lexical = cut_lineage(bm25.select(
            F.col("leaf_id").cast("string").alias("leaf_id"), F.col("chunk_id").cast("string").alias("chunk_id"),
            F.col("rank").cast("long").alias("rank_bm25"), F.col("score").alias("score_bm25")))
    n_blocks = max(1, -(-asked.count() // leaf_block))
    found = []
    for block in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("leaf_id"), F.lit(n_blocks)) == block)
        found.extend(_fuse_block(spark, rows, part, lexical, k, k_rrf, boost, depth, depth_limit))
    out = spark.createDataFrame([], RESULT)
    for frame in found:
        out = out.unionByName(frame)
    return out


def _fuse_block(spark, rows, asked, lexical, k, k_rrf, boost, depth, depth_limit) -> list[DataFrame]:
    waiting = asked.collect()  # at most about LEAF_BLOCK leaves
    done = []
    while waiting and depth <= depth_limit:
        again = []
        # deeper lists are searched for fewer leaves at a time
        size = max(1, KEPT_ROWS // (6 * depth))
        for start in range(0, len(waiting), size):
            part = waiting[start:start + size]
            result, open_ids = _search(spark, rows, part, lexical, k, k_rrf, boost, depth)
            done.append(result.filter(~F.col("leaf_id").isin(open_ids)) if open_ids else result)
            again += [w for w in part if w["leaf_id"] in set(open_ids)]
        waiting = again
        depth *= 8
    if waiting:
        done.append(_full(spark, rows, waiting, lexical, k, k_rrf, boost))
    return done


def _leaf_frame(spark, leaves: list) -> DataFrame:
    return spark.createDataFrame(
        [(i, r["leaf_id"], r["code"]) for i, r in enumerate(leaves)], "leaf int, leaf_id string, code string")


def _search(spark, rows, leaves, lexical, k, k_rrf, boost, depth):
    names = _leaf_frame(spark, leaves)
    shared = spark.sparkContext.broadcast((
        matrix([r["rq"] for r in leaves]), matrix([r["hyde"] for r in leaves]), [r["code"] for r in leaves]))
    kept = cut_lineage(_keep_best(rows, leaves, shared, depth))
    lexical_rows = None
    wanted = kept.select("leaf", "cls", "chunk_id", "parent_id", "score_rq", "score_hyde")
    if lexical is not None:
        lexical_rows = lexical.join(names, "leaf_id").select("leaf", "chunk_id", "rank_bm25", "score_bm25")
        new = lexical_rows.join(wanted.select("leaf", "chunk_id"), ["leaf", "chunk_id"], "left_anti")
        wanted = cut_lineage(wanted.unionByName(_score_rows(rows, new.join(names, "leaf"), shared)))
    # at most KEPT_ROWS and the BM25 rows of these leaves
    listed = wanted.collect()
    ranks = _count_before(rows, listed, len(leaves), shared)
    joined = wanted.join(ranks, ["leaf", "chunk_id"])
    if lexical_rows is not None:
        hits = lexical_rows.select("leaf").distinct().withColumn("by_rrf", F.lit(True))
        joined = joined.join(lexical_rows, ["leaf", "chunk_id"], "left").join(hits, "leaf", "left").withColumn(
            "by_rrf", F.coalesce("by_rrf", F.lit(False)))
    else:
        joined = joined.withColumns({"rank_bm25": F.lit(None).cast("long"),
                                     "score_bm25": F.lit(None).cast("double"), "by_rrf": F.lit(False)})
    fused = cut_lineage(_fused(joined, k_rrf, boost))
    top = _report(top_per_parent(fused.join(names, "leaf"), k, bounded=True))
    return top, _open_leaves(kept, fused, top, names, k, k_rrf, boost, depth)


def _score_rows(rows: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """Scores and class of given (leaf, chunk_id) pairs."""
    schema = ("leaf int, cls byte, chunk_id string, parent_id string, score_rq double, score_hyde double")

    def score(batches):
        rq, hyde, codes = shared.value
        for batch in batches:
            batch, x = usable_rows(batch)
            if batch.empty:
                continue
            at = batch["leaf"].to_numpy()
            cls = np.empty(len(batch), dtype="int8")
            for leaf in np.unique(at):
                here = at == leaf
                cls[here] = _classes(batch["folder_code"].to_numpy()[here],
                                     batch["status"].to_numpy()[here], codes[leaf])
            yield pd.DataFrame({
                "leaf": at.astype("int32"), "cls": cls, "chunk_id": batch["chunk_id"],
                "parent_id": batch["parent_id"],
                "score_rq": np.round(np.einsum("ij,ij->i", x, rq[at]), DIGITS),
                "score_hyde": np.round(np.einsum("ij,ij->i", x, hyde[at]), DIGITS)})

    # a few pairs a leaf as a rule: vectors then stay where they are
    return rows.join(broadcast_if_small(pairs.select("leaf", "chunk_id")), "chunk_id").mapInPandas(score, schema)


def _open_leaves(kept, fused, top, names, k, k_rrf, boost, depth) -> list[str]:
    """Leaves where a chunk that was not kept could still enter the result."""
    extra = F.when(F.col("cls") == MATCH, boost).when(F.col("cls") == PENALTY, -boost * 0.5).otherwise(0.0)
    last = kept.groupBy("leaf", "cls").agg(
        F.max_by("chunk_id", "place_rq").alias("last_rq"), F.max("place_rq").alias("n_rq"),
        F.max_by("chunk_id", "place_hyde").alias("last_hyde"), F.max("place_hyde").alias("n_hyde"),
    ).filter((F.col("n_rq") >= depth) | (F.col("n_hyde") >= depth))
    facts = fused.select("leaf", "chunk_id", "rank_rq", "rank_hyde", "score_rq", "score_hyde", "by_rrf")
    rq = facts.select("leaf", F.col("chunk_id").alias("last_rq"), F.col("rank_rq").alias("r1"),
                      F.col("score_rq").alias("s1"), "by_rrf")
    hyde = facts.select("leaf", F.col("chunk_id").alias("last_hyde"), F.col("rank_hyde").alias("r2"),
                        F.col("score_hyde").alias("s2"))
    bound = F.when(F.col("by_rrf"), rrf_score([F.col("r1") + 1, F.col("r2") + 1], k_rrf)).otherwise(
        F.greatest("s1", "s2")) + extra
    bounds = last.join(rq, ["leaf", "last_rq"]).join(hyde, ["leaf", "last_hyde"]).groupBy("leaf").agg(
        F.max(bound).alias("bound"))
    kth = top.groupBy("leaf_id").agg(F.count("*").alias("n"), F.min("score_raw").alias("kth"))
    unsure = bounds.join(names, "leaf").join(kth, "leaf_id", "left").filter(
        F.col("n").isNull() | (F.col("n") < k) | (F.col("kth") <= F.col("bound")))
    return [r["leaf_id"] for r in unsure.select("leaf_id").collect()]


def _full(spark, rows, leaves, lexical, k, k_rrf, boost) -> DataFrame:
    """Ranks of every chunk for a few leaves, spread over range partitions."""
    names = _leaf_frame(spark, leaves)
    frame = spark.createDataFrame([(r["leaf_id"], list(map(float, r["rq"])), list(map(float, r["hyde"])))
                                   for r in leaves], "leaf_id string, rq array<double>, hyde array<double>")
    ranked = route_ranks(rows.select("chunk_id", F.col("v").alias("embedding")), frame)
    joined = ranked.drop("score").join(
        rows.select("chunk_id", "parent_id", "folder_code", "status"), "chunk_id").join(names, "leaf_id")
    match = F.coalesce((F.col("folder_code") == F.col("code")) & (F.col("code") != ""), F.lit(False))
    bad = F.coalesce(F.col("status") == "misplaced", F.lit(False))
    joined = joined.withColumn("cls", F.when(match & ~bad, MATCH).when(match & bad, PENALTY).otherwise(PLAIN))
    if lexical is not None:
        hits = lexical.select("leaf_id").distinct().withColumn("by_rrf", F.lit(True))
        joined = joined.join(lexical, ["leaf_id", "chunk_id"], "left").join(hits, "leaf_id", "left").withColumn(
            "by_rrf", F.coalesce("by_rrf", F.lit(False)))
    else:
        joined = joined.withColumns({"rank_bm25": F.lit(None).cast("long"),
                                     "score_bm25": F.lit(None).cast("double"), "by_rrf": F.lit(False)})
    return _report(top_per_parent(_fused(joined, k_rrf, boost), k))


def _report(top: DataFrame) -> DataFrame:
    source = F.when(F.col("by_rrf"), rank_source("rank_rq", "rank_hyde", "rank_bm25")).otherwise(
        score_source("score_rq", "score_hyde"))
    return top.select(
        "leaf_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "parent_id",
        F.round("score", DIGITS).alias("score"), "score_rq", "score_hyde",
        F.coalesce("score_bm25", F.lit(0.0)).alias("score_bm25"),
        F.col("rank_rq").cast("long").alias("rank_rq"), F.col("rank_hyde").cast("long").alias("rank_hyde"),
        F.coalesce("rank_bm25", F.lit(fixed.MISSING_RANK)).cast("long").alias("rank_bm25"),
        source.alias("source"), F.when(F.col("by_rrf"), "rrf").otherwise("max").alias("fusion_mode"),
        F.col("score").alias("score_raw"))


# --- rerank ------------------------------------------------------------------------------------

def rerank_text(full_path, gloss, query) -> Column:
    text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit("章节："), text(full_path), F.lit("\n说明："), text(gloss),
                    F.lit("\n检索描述："), text(query))


def rerank(results: DataFrame, new_score: str = "new_score", k: int = fixed.FINAL_TOP) -> DataFrame:
    """Order by a second score, keep the first order and score beside it.

    A leaf with a missing new score keeps its first order, cut at ``k``.
    """
    failed = Window.partitionBy("leaf_id")
    marked = results.withColumn("skipped", F.max(F.col(new_score).isNull()).over(failed))
    scored = marked.withColumn("__score", F.when(F.col("skipped"), F.lit(None).cast("double")).otherwise(
        F.round(F.col(new_score), 6)))
    order = Window.partitionBy("leaf_id").orderBy(F.desc_nulls_last("__score"), "rank")
    ranked = scored.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k)
    return ranked.withColumns({
        "biencoder_rank": F.col("rank"), "score_biencoder": F.col("score"),
        "rank": F.col("__rank"), "score": F.coalesce("__score", F.col("score")),
    }).drop("__rank", "__score", new_score)
