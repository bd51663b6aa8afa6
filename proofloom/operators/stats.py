"""Counts and distributions over results, sections, drafts and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import has_text, project_parts


def leaf_stats(results: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Mean and best score, number of chunks and files per leaf.

    With ``leaves`` those without results appear with zeros.
    """
    stats = results.groupBy("leaf_id").agg(
        F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.max("score"), 4).alias("max_score"),
        F.count("*").alias("chunk_count"),
        F.sort_array(F.collect_set(F.coalesce("file_name", F.lit("")))).alias("source_files"))
    if leaves is None:
        return stats
    joined = leaves.select("leaf_id").join(stats, "leaf_id", "left")
    return joined.select(
        "leaf_id", F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("source_files", F.array().cast("array<string>")).alias("source_files"))


def source_distribution(results: DataFrame) -> DataFrame:
    """Chunks per (leaf, source), and per source overall (leaf NULL)."""
    return results.groupingSets([[F.col("leaf_id"), F.col("source")], [F.col("source")]], "leaf_id", "source").agg(
        F.count("*").alias("chunks")).select("leaf_id", "source", "chunks")


def source_map(results: DataFrame) -> DataFrame:
    """The same per leaf as one map, for nested output."""
    counts = results.groupBy("leaf_id", "source").agg(F.count("*").alias("n"))
    return counts.groupBy("leaf_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("source", "n")))).alias("source_distribution"))


def rank_changes(reranked: DataFrame, per_leaf: bool = False) -> DataFrame:
    """How many chunks moved up, down or stayed after the second ranking."""
    rows = reranked.filter(~F.col("skipped")) if "skipped" in reranked.columns else reranked
    change = (
        F.when(F.col("rank") < F.col("biencoder_rank"), "improved")
        .when(F.col("rank") > F.col("biencoder_rank"), "declined").otherwise("unchanged"))
    keys = (["leaf_id"] if per_leaf else []) + [change.alias("change")]
    return rows.groupBy(*keys).agg(F.count("*").alias("chunks"))


def score_brackets(stats: DataFrame, score: str = "avg_score") -> DataFrame:
    """Leaves per score bracket with percentage, empty brackets kept."""
    spark = stats.sparkSession
    names = [name for name, _ in fixed.BRACKETS] + [fixed.BRACKET_REST]
    known = spark.createDataFrame(list(enumerate(names)), "place int, bracket string")
    bucket = F.lit(len(names) - 1)
    for place, (_, low) in reversed(list(enumerate(fixed.BRACKETS))):
        bucket = F.when(F.col(score) >= low, place).otherwise(bucket)
    counts = stats.groupBy(bucket.alias("place")).agg(F.count("*").alias("n"))
    total = stats.agg(F.count("*")).scalar()
    return known.join(counts, "place", "left").select(
        "place", "bracket", F.coalesce("n", F.lit(0)).alias("leaves"),
        F.when(total > 0, F.round(F.coalesce("n", F.lit(0)) / total * 100, 1))
        .otherwise(0.0).alias("percent"))


def parent_lengths(results: DataFrame, limit: int = fixed.PARENT_LIMIT) -> DataFrame:
    """Length figures of parent texts and share of uncut chunks.

    The exact median runs on counts per length, which Spark merges map-side.
    """
    n = F.length(F.coalesce("parent_text", F.lit("")))
    same = F.coalesce(F.col("text") == F.col("parent_text"), F.lit(False))
    sized = results.select(n.alias("n"), same.alias("same"))
    return sized.agg(
        F.count("*").alias("chunks"), F.min("n").alias("min_length"), F.median("n").alias("median_length"),
        F.round(F.avg("n"), 2).alias("mean_length"), F.max("n").alias("max_length"),
        F.count_if(F.col("n") > limit).alias("over_limit"), F.count_if("same").alias("uncut"))


def mean_by_source(results: DataFrame, score: str = "score") -> DataFrame:
    return results.groupBy("source").agg(
        F.count("*").alias("chunks"), F.round(F.avg(score), 4).alias("avg_score"))


def rerank_uplift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean of the leaf means before and after the second ranking."""
    coarse = before.agg(F.avg("avg_score")).scalar()
    both = after.agg(F.avg("avg_score").alias("reranked")).withColumn("coarse", coarse)
    return both.select(
        F.round("coarse", 4).alias("coarse"), F.round("reranked", 4).alias("reranked"),
        F.round(F.col("reranked") - F.col("coarse"), 4).alias("uplift"))


def weakest(stats: DataFrame, n: int = 5) -> DataFrame:
    return stats.orderBy("avg_score", "leaf_id").limit(n)


def sections_per_file(sections: DataFrame, file: str = "file_path") -> DataFrame:
    """Sections per file, and the total (file NULL)."""
    return sections.rollup(file).agg(F.count("*").alias("sections"))


def table_counts(chunks: DataFrame) -> DataFrame:
    summary = F.col("table_summary") if "table_summary" in chunks.columns else F.lit(None)
    table = F.coalesce(F.col("is_table"), F.lit(False))
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(table).alias("tables"),
        F.count_if(table & (F.coalesce(summary, F.lit("")) != "")).alias("summarised"))


def draft_summary(drafts: DataFrame) -> DataFrame:
    """Drafts per status; tokens and words over generated ones."""
    made = F.col("status") == "generated"
    return drafts.agg(
        F.count("*").alias("total"), F.count_if(made).alias("generated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.coalesce(F.sum(F.when(made, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(made, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.when(made, F.col("word_count"))), F.lit(0)).alias("words"))


def status_overview(drafts: DataFrame) -> DataFrame:
    """Drafts per status and the percentage that is generated."""
    names = ["generated", "skipped", "reviewed", "approved"]
    counted = drafts.agg(F.count("*").alias("total"),
                         *[F.count_if(F.col("status") == n).alias(n) for n in names])
    share = F.when(F.col("total") > 0, F.round(F.col("generated") / F.col("total") * 100)).otherwise(0.0)
    return counted.withColumn("percent", share.cast("int"))


def substep_counts(states: DataFrame) -> DataFrame:
    """Chapters per sub-step state of a run: (run_id, key, status)."""
    names = ["done", "running", "error", "pending"]
    return states.groupBy("run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == n).alias(n) for n in names])


def query_completeness(leaves: DataFrame) -> DataFrame:
    """Leaves with a query, with a sample answer, with both, and the rest."""
    rq = has_text(F.coalesce("retrieval_query", F.lit("")))
    hyde = has_text(F.coalesce("hypothetical_doc", F.lit("")))
    return leaves.agg(
        F.count("*").alias("total"), F.count_if(rq).alias("rq_ok"), F.count_if(hyde).alias("hyde_ok"),
        F.count_if(rq & hyde).alias("both_ok"), F.count_if(~(rq & hyde)).alias("needs_review"))


def project_rollup(files: DataFrame, drafts: DataFrame) -> DataFrame:
    """Files, drafts and stage of every project.

    ``files`` and ``drafts`` carry project_id; drafts also (status).
    """
    n_files = files.groupBy("project_id").agg(F.count("file_path").alias("files"))
    made = drafts.groupBy("project_id").agg(
        F.count("*").alias("chapters"), F.count_if(F.col("status") == "generated").alias("generated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("error"))
    joined = n_files.join(made, "project_id", "full")
    company, year = project_parts("project_id")
    stage = (F.when(F.coalesce("chapters", F.lit(0)) > 0, "draft_generated")
             .when(F.coalesce("files", F.lit(0)) > 0, "data_uploaded").otherwise("no_data"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("project_id", company.alias("company"), year.alias("year"), stage.alias("status"),
                         zero("files"), zero("chapters"), zero("generated"), zero("skipped"), zero("error"))
