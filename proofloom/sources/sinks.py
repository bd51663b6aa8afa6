"""Result tables written as nested JSON, CSV or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats


def nested_results(leaves: DataFrame, results: DataFrame) -> DataFrame:
    """One row per leaf with its ranked chunks and figures; at most k chunks each."""
    inner = [c for c in results.columns if c not in ("leaf_id", "rank")]
    chunks = results.groupBy("leaf_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", *inner)), lambda a, b: a["rank"] - b["rank"]).alias("top_chunks"))
    figures = stats.leaf_stats(results, leaves).join(stats.source_map(results), "leaf_id", "left")
    nested = figures.select("leaf_id", F.struct(*[c for c in figures.columns if c != "leaf_id"]).alias("stats"))
    return leaves.join(chunks, "leaf_id", "left").join(nested, "leaf_id", "left")


def save_results(leaves: DataFrame, results: DataFrame, path: str) -> None:
    nested_results(leaves, results).write.mode("overwrite").json(path)


def save_drafts(drafts: DataFrame, path: str, config: dict | None = None) -> None:
    """Draft rows, and one summary row beside them."""
    drafts.write.mode("overwrite").json(f"{path}/results")
    summary = stats.draft_summary(drafts).withColumn("generated_at", F.current_timestamp())
    for name, value in (config or {}).items():
        summary = summary.withColumn(f"config_{name}", F.lit(value))
    summary.write.mode("overwrite").json(f"{path}/summary")


def save_review(table: DataFrame, path: str) -> None:
    """Review rows as CSV; the given order is kept across files."""
    table.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def save_reports(reports: DataFrame, path: str, report: str = "report_id") -> None:
    reports.select(report, "report").write.mode("overwrite").partitionBy(report).text(path)
