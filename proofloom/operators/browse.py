"""Filtered pages, searches and trees over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_parts, shorten


def chunk_filter(code: str = "", is_table: bool | None = None, search: str = "") -> Column:
    keep = F.lit(True)
    if code:
        keep = keep & (F.col("folder_code") == code)
    if is_table is not None:
        keep = keep & (F.coalesce("is_table", F.lit(False)) == F.lit(is_table))
    if search:
        term = search.lower()
        keep = keep & (F.lower("text").contains(term) | F.lower("file_name").contains(term)
                       | F.lower("chunk_id").contains(term))
    return keep


def chunk_page(chunks: DataFrame, page: int = 1, size: int = 50, **wanted) -> DataFrame:
    """One page of the filtered chunks in id order, private columns dropped."""
    page, size = max(1, page), min(100, max(10, size))
    rows = chunks.filter(chunk_filter(**wanted)).drop("file_path")
    return rows.orderBy("chunk_id").offset((page - 1) * size).limit(size)


def page_totals(chunks: DataFrame, size: int = 50, **wanted) -> DataFrame:
    size = min(100, max(10, size))
    return chunks.filter(chunk_filter(**wanted)).agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size))


def code_facet(chunks: DataFrame) -> DataFrame:
    return chunks.select("folder_code").distinct().orderBy("folder_code")


def search_sections(sections: DataFrame, term: str, file: str = "file_path") -> DataFrame:
    """All sections of every file whose path, a text or a title holds the term."""
    term = term.lower()
    hit = (F.lower(F.col(file)).contains(term) | F.lower("text").contains(term)
           | F.lower(F.coalesce("section_title", F.lit(""))).contains(term))
    files = sections.filter(hit).select(file).distinct()
    return sections.join(files, file, "left_semi")


def result_list(results: DataFrame, chars: int = 300) -> DataFrame:
    return results.withColumn("text", shorten("text", chars)).drop("file_path", "parent_text")


def chapter_tree(results: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    """Nodes of the chapter tree: matching leaves and all folders above them."""
    parts = path_parts("full_path")
    rows = results.withColumn("__parts", parts).withColumn("label", F.element_at("__parts", -1))
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if search:
        rows = rows.filter(F.lower("label").contains(search.lower()))
    n = F.size("__parts")
    nodes = rows.select(
        "leaf_id", "row", "status", n.alias("__n"), "__parts", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    path = F.array_join(F.slice("__parts", 1, F.col("depth")), " > ")
    leaf = F.col("depth") == F.col("__n")
    named = nodes.select(path.alias("path"), "depth", F.col("__parts")[F.col("depth") - 1].alias("label"),
                         "leaf_id", "row", "status", leaf.alias("is_leaf"))
    return named.groupBy("path").agg(
        F.min("depth").alias("depth"), F.min("label").alias("label"), F.min("row").alias("first_row"),
        F.min(F.when(F.col("is_leaf"), F.col("leaf_id"))).alias("leaf_id"),
        F.min(F.when(F.col("is_leaf"), F.col("status"))).alias("status"),
        F.count_if("is_leaf").alias("leaves_here"))


def newest_first(rows: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
