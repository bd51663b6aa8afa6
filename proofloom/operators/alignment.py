"""Does a chunk say what its folder claims? Status, review table, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, format_top, one_line_preview, without_control_chars
from ..session import broadcast_if_small, cut_lineage
from .fusion import rrf_score
from .lexical import Tokenizer, search, words
from .vectors import TOP, with_nearest


def classify(folder, top, topn: int = fixed.TOP_N, extra: float = fixed.EXTRA_SCORE,
             low: float | Column = fixed.MIN_SCORE, extra_top=None) -> Column:
    """Status, description and suggested code of one chunk.

    ``extra_top`` is the list searched for further strong codes (default: the
    same list).
    """
    folder, top = F.nullif(col(folder), F.lit("")), F.coalesce(col(top), F.array().cast(TOP))
    wide = top if extra_top is None else F.coalesce(col(extra_top), F.array().cast(TOP))
    first = F.get(top, F.lit(0))
    inside = F.exists(F.slice(top, 1, topn), lambda x: x["code"] == folder)
    more = F.exists(wide, lambda x: (x["code"] != folder) & (x["score"] > extra))
    label = {mark: text for mark, text, _, _ in fixed.STATUSES}
    out = lambda mark, text, code: F.struct(
        F.lit(mark).alias("consistency"), F.lit(text).alias("consistency_desc"), code.alias("suggested_code"))
    return (
        F.when((F.size(top) == 0) & folder.isNotNull(), out("❓", fixed.NO_CHECK, folder))
        .when(F.size(top) == 0, out("❓", fixed.NO_EVIDENCE, F.lit(None).cast("string")))
        .when(first["score"] < low, out("➖", label["➖"], F.coalesce(folder, first["code"])))
        .when(folder.isNull(), out("🔍", label["🔍"], first["code"]))
        .when(inside & more, out("➕", label["➕"], folder))
        .when(inside, out("✅", label["✅"], folder))
        .otherwise(out("⚠️", label["⚠️"], first["code"])))


def align(chunks: DataFrame, indicators: DataFrame, k: int = fixed.TOP_K, **limits) -> DataFrame:
    """Status of every chunk from its ``k`` nearest indicators."""
    joined = with_nearest(chunks, "chunk_id", indicators, "code", k, "semantic_topk")
    return joined.withColumn("__c", classify("folder_code", "semantic_topk", **limits)).select(
        *joined.columns, "__c.*")


def _fused(near: Column, lexical: Column, k: int, k_rrf: int) -> Column:
    """Best ``k`` codes of a cosine list and a list of (code, rank), by reciprocal ranks, ties by code."""
    lexical = F.coalesce(lexical, F.array().cast("array<struct<code:string,rank:int>>"))
    code_of = lambda entries: F.transform(entries, lambda e: e["code"])

    def score(code):
        by_vector = F.nullif(F.array_position(code_of(near), code), F.lit(0))
        by_words = F.get(F.filter(lexical, lambda e: e["code"] == code), F.lit(0))["rank"]
        return F.struct((-rrf_score([by_vector, by_words], k_rrf)).alias("below"), code.alias("code"))

    ordered = F.array_sort(F.transform(F.array_union(code_of(near), code_of(lexical)), score))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["code"].alias("code"), (-x["below"]).alias("score")))


def align_two_routes(chunks: DataFrame, indicators: DataFrame, k: int = fixed.TOP_K,
                     topn: int = fixed.TOP_N, extra: float = fixed.EXTRA_SCORE,
                     low: float = fixed.MIN_SCORE, k_rrf: int = fixed.RRF_K,
                     fused_low: float = 0.01, extra_on_cosine: bool = True,
                     tokenizer: Tokenizer = words, texts: DataFrame | None = None) -> DataFrame:
    """Status from cosine and BM25 ranks fused per chunk.

    ``indicators`` holds (code, embedding, query_text). BM25 ranks chunks
    within an indicator (best ``2 k``); the rank is then read per chunk. A
    chunk whose best cosine is below ``low`` keeps its cosine list. ``texts`` holds
    the (chunk_id, text) rows of the chunks where they can be read more cheaply than from ``chunks``.
    """
    near = with_nearest(chunks, "chunk_id", indicators, "code", k, "emb_topk")
    lexical = search((chunks if texts is None else texts).select("chunk_id", "text"), "chunk_id",
                     indicators.select("code", "query_text"), "code", 2 * k,
                     query_text="query_text", tokenizer=tokenizer)
    # at most 2 k rows an indicator: as a rule few beside the chunks, which then stay where they are
    words_of = broadcast_if_small(cut_lineage(lexical.groupBy("chunk_id").agg(
        F.collect_list(F.struct(F.col("code").cast("string").alias("code"), F.col("rank").alias("rank"))).alias("__words"))))
    first = F.get("emb_topk", F.lit(0))
    joined = near.join(words_of, "chunk_id", "left").withColumn(
        "__fused", F.when(first["score"] >= low, _fused(F.col("emb_topk"), F.col("__words"), k, k_rrf))).withColumns({
            "semantic_topk": F.coalesce("__fused", "emb_topk"),
            "__low": F.when(F.col("__fused").isNotNull(), fused_low).otherwise(low)}).drop("__fused", "__words")
    status = classify("folder_code", "semantic_topk", topn, extra, F.col("__low"),
                      F.col("emb_topk") if extra_on_cosine else None)
    return joined.withColumn("__c", status).select(
        *[c for c in joined.columns if c != "__low"], "__c.*")


def _fixed_map(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def stored_status(mark) -> Column:
    known = _fixed_map([(m, s) for m, _, _, s in fixed.STATUSES], col(mark))
    return F.coalesce(known, F.lit(fixed.DEFAULT_STATUS))


def review_order(mark) -> Column:
    return F.coalesce(_fixed_map([(m, o) for m, _, o, _ in fixed.STATUSES], col(mark)), F.lit(999))


def write_back(chunks: DataFrame, aligned: DataFrame) -> DataFrame:
    """Chunks with their stored alignment status; unaligned ones count as low."""
    status = aligned.select("chunk_id", stored_status("consistency").alias("alignment_status"))
    return chunks.drop("alignment_status").join(status, "chunk_id", "left").withColumn(
        "alignment_status", F.coalesce("alignment_status", F.lit(fixed.DEFAULT_STATUS)))


def with_indicator(chunks: DataFrame, indicators: DataFrame) -> DataFrame:
    """Topic and indicator of the folder a chunk lies in."""
    named = indicators.select(F.col("code").alias("folder_code"), F.col("topic").alias("folder_topic"),
                              F.col("indicator").alias("folder_indicator"))
    return chunks.join(named, "folder_code", "left")


def review_table(aligned: DataFrame, indicators: DataFrame, pos: str = "pos") -> DataFrame:
    """The 13 review columns, ordered by status and then by position."""
    shown = F.coalesce("emb_topk", "semantic_topk") if "emb_topk" in aligned.columns else F.col("semantic_topk")
    clean = lambda c: without_control_chars(F.coalesce(col(c), F.lit("")))
    text = lambda c: F.coalesce(col(c), F.lit(""))
    return with_indicator(aligned, indicators).orderBy(review_order("consistency"), pos).select(
        clean("chunk_id").alias("chunk_id"), clean("file_name").alias("file_name"),
        clean("file_path").alias("file_path"), clean("folder_code").alias("folder_code"),
        clean("folder_topic").alias("folder_topic"), clean("folder_indicator").alias("folder_indicator"),
        clean(format_top(shown)).alias("semantic_top5"), text("consistency").alias("consistency"),
        clean(one_line_preview("text")).alias("text_preview"), clean("page_or_sheet").alias("page_or_sheet"),
        F.col(pos).alias("chunk_index"), clean("suggested_code").alias("human_code"),
        F.lit("").alias("human_note"))


def uncovered_files(files: DataFrame, aligned: DataFrame, low: float = fixed.MIN_SCORE) -> DataFrame:
    """Files without a relevant chunk, and why."""
    per_file = aligned.groupBy("file_path").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("consistency").isin(*fixed.RELEVANT)).alias("relevant"))
    joined = files.join(per_file, "file_path", "left").filter(F.coalesce("relevant", F.lit(0)) == 0)
    n = F.coalesce("chunks", F.lit(0))
    return joined.select(
        "file_path", "file_name", F.coalesce("folder_code", F.lit("")).alias("folder_code"), n.alias("chunks"),
        F.when(n > 0, F.lit(fixed.ALL_LOW % low)).otherwise(fixed.NO_CHUNKS).alias("reason"))


def status_counts(aligned: DataFrame) -> DataFrame:
    """Chunks and share per status in fixed order, zeros kept."""
    spark = aligned.sparkSession
    known = spark.createDataFrame([(i, m, t) for i, (m, t, _, _) in enumerate(fixed.STATUSES)],
                                  "place int, status string, label string")
    counts = aligned.groupBy(F.coalesce("consistency", F.lit("❓")).alias("status")).agg(
        F.count("*").alias("n"))
    joined = known.join(counts, "status", "left").withColumn("chunks", F.coalesce("n", F.lit(0)))
    total = aligned.agg(F.count("*")).scalar()
    return joined.select(
        "place", "status", "label", "chunks",
        F.when(total > 0, F.round(F.col("chunks") / total * 100, 1)).otherwise(0.0)
        .alias("percent"))


def coverage(files: DataFrame, aligned: DataFrame) -> DataFrame:
    """Files with a relevant chunk, all files, percentage, rows to review."""
    good = aligned.filter(F.col("consistency").isin(*fixed.RELEVANT)).select("file_path").distinct()
    covered = files.select("file_path").distinct().join(
        good.withColumn("hit", F.lit(1)), "file_path", "left").agg(
        F.count("*").alias("files"), F.count("hit").alias("covered"))
    rows = aligned.agg(F.count_if(F.col("consistency").isin(*fixed.REVIEW))).scalar()
    share = F.when(F.col("files") > 0, F.round(F.col("covered") / F.col("files") * 100, 1)).otherwise(0.0)
    return covered.select("files", "covered", share.alias("percent"), rows.alias("review_rows"))
