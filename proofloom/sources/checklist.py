"""Checklist and framework tables read from spreadsheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, fixed
from ..functions.text import strip
from .grid import checklist_header, filled_rows, framework_header


def checklist_rows(grid: DataFrame) -> DataFrame:
    """Data rows of every checklist sheet with the code each stands for."""
    rows = filled_rows(
        grid, checklist_header(grid),
        {"topic": fixed.TOPIC_WORDS, "indicator": fixed.INDICATOR_WORDS,
         "serial": fixed.SERIAL_WORDS, "category": fixed.CATEGORY_WORDS,
         "code_cell": fixed.CODE_WORDS, "requirement": fixed.REQUIREMENT_WORDS,
         "department": fixed.DEPARTMENT_WORDS, "remark": fixed.REMARK_WORDS},
        ["topic", "indicator", "category"],
    )
    return rows.withColumn("code", codes.row_code("code_cell", "serial", "category"))


def indicator_map(rows: DataFrame) -> DataFrame:
    """One row per code: the first row wins, later rows fill what it lacks."""
    order = F.struct("sheet", "row")
    return rows.filter(F.col("code").isNotNull()).groupBy("code").agg(
        F.min_by("topic", F.when(F.col("topic").isNotNull(), order)).alias("topic"),
        F.min_by("indicator", F.when(F.col("indicator").isNotNull(), order)).alias("indicator"),
    )


def load_stats(rows: DataFrame, sample: int = 20) -> DataFrame:
    """Rows scanned and used, distinct codes, duplicated codes with a sample."""
    twice = rows.filter(F.col("code").isNotNull()).groupBy("code").agg(
        F.count("*").alias("n")).filter(F.col("n") > 1)
    listed = twice.orderBy("code").limit(sample).agg(F.array_sort(F.collect_list("code")))
    return rows.agg(
        F.count("*").alias("rows_scanned"),
        F.count("code").alias("rows_used"),
        F.count_distinct("code").alias("mapping_size"),
    ).withColumns({"duplicate_codes": twice.agg(F.count("*")).scalar(),
                   "duplicates_sample": listed.scalar()})


def indicators(rows: DataFrame) -> DataFrame:
    """Full indicator rows that name a code themselves, in natural code order."""
    own = F.coalesce(codes.first_code("code_cell"), codes.first_code("serial"))
    one_line = lambda c: strip(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    named = rows.withColumn("code", own).filter(F.col("code").isNotNull())
    return named.select(
        "code", codes.dimension_letter("code").alias("dim_prefix"),
        codes.code_letters("code").alias("sub_prefix"),
        one_line("topic").alias("topic"), one_line("indicator").alias("indicator"),
        text("requirement").alias("requirement"), text("department").alias("department"),
        text("remark").alias("remark"), "sheet", "row",
    ).orderBy(*codes.natural_order("code"), "sheet", "row")


def indicator_details(rows: DataFrame, order: list[str] = ["sheet", "row"]) -> DataFrame:
    """Topic, indicator and requirement per code; the last row wins."""
    key = F.struct(*order)
    return rows.groupBy("code").agg(
        *[F.max_by(c, key).alias(c) for c in ("topic", "indicator", "requirement")])


def framework(grid: DataFrame) -> DataFrame:
    """Report framework rows: four levels, code and gloss."""
    rows = filled_rows(
        grid, framework_header(grid),
        {"l1": fixed.LEVEL1_WORDS, "l2": fixed.LEVEL2_WORDS, "l3": fixed.LEVEL3_WORDS,
         "l4": fixed.LEVEL4_WORDS, "code": fixed.FRAMEWORK_CODE_WORDS,
         "gloss": fixed.FRAMEWORK_GLOSS_WORDS},
        ["l1", "l2", "l3"],
    )
    some = F.coalesce("l1", "l2", "l3", "l4", "code", "gloss").isNotNull()
    # cell rows count from zero, sheet rows from one
    return rows.filter(some).withColumn("row", F.col("row") + 1)


def leaves(framework_rows: DataFrame,
           excluded: list[str] = fixed.EXCLUDED_FIRST_LEVELS) -> DataFrame:
    """Chapter leaves: a gloss, a usable level, and a first level that is a chapter."""
    level = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "/"), F.col(c))
    l1, l2, l3, l4 = (level(c) for c in ("l1", "l2", "l3", "l4"))
    title = F.coalesce(l4, l3, l2)
    first = F.coalesce("l1", F.lit(""))
    return framework_rows.filter(
        ~first.isin(*excluded) & level("gloss").isNotNull() & title.isNotNull()
    ).select(
        F.format_string("r%03d", "row").alias("leaf_id"), "row",
        F.concat_ws(" > ", first, l2, l3, l4).alias("full_path"),
        title.alias("leaf_title"), "l1", "l2", "l3", "l4", "code", "gloss",
    )


def leaves_per_first_level(leaf_rows: DataFrame) -> DataFrame:
    return leaf_rows.groupBy("l1").agg(
        F.count("*").alias("leaves"), F.min("row").alias("first_row")).orderBy("first_row")


def reconcile_codes(framework_codes: DataFrame, checklist_codes: DataFrame) -> DataFrame:
    """Codes that only one of the two tables has."""
    a = framework_codes.filter(F.col("code").isNotNull()).select("code").distinct()
    b = checklist_codes.filter(F.col("code").isNotNull()).select("code").distinct()
    only_a = a.join(b, "code", "left_anti").withColumn("only_in", F.lit("framework"))
    only_b = b.join(a, "code", "left_anti").withColumn("only_in", F.lit("checklist"))
    return only_a.unionByName(only_b)


def non_empty_requirements(details: DataFrame) -> DataFrame:
    return details.agg(F.count("*").alias("indicators"),
                       F.count_if(strip(F.coalesce("requirement", F.lit(""))) != "").alias("with_requirement"))
