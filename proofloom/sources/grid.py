"""Operators on spreadsheet cells in long form: (sheet, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import cell_text, col, meaningful_chars, squeeze, strip
from ..session import broadcast_if_small, cut_lineage

TASKS_PER_CORE = 16         # rows of cells are put together in this many tasks, however well the cells compress


def any_word(c, words: list[str], ignore_case: bool = False) -> Column:
    c = F.lower(col(c)) if ignore_case else col(c)
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def checklist_header(grid: DataFrame, rows: int = fixed.CHECKLIST_HEADER_ROWS) -> DataFrame:
    """Header row of every sheet: topic + indicator + key, else serial + material."""
    cells = grid.filter(F.col("row") < rows).withColumn("word", squeeze("value"))
    serial = any_word("word", [fixed.SERIAL_WORD])
    material = any_word("word", [fixed.MATERIAL_WORD])
    per_row = cells.groupBy("sheet", "row").agg(
        (F.bool_or(any_word("word", fixed.TOPIC_WORDS))
         & F.bool_or(any_word("word", fixed.INDICATOR_WORDS))
         & F.bool_or(any_word("word", fixed.KEY_WORDS))).alias("full"),
        F.min(F.when(serial, F.col("col"))).alias("serial_col"),
        F.min(F.when(material, F.col("col"))).alias("material_col"),
    )
    plain = F.col("serial_col") != F.col("material_col")
    found = per_row.groupBy("sheet").agg(
        F.min(F.when(F.col("full"), F.col("row"))).alias("rule1"),
        F.min(F.when(plain, F.col("row"))).alias("rule2"),
    )
    return found.select("sheet", F.coalesce("rule1", "rule2").alias("header")).filter(
        F.col("header").isNotNull())


def framework_header(grid: DataFrame, rows: int = fixed.FRAMEWORK_HEADER_ROWS) -> DataFrame:
    """First row that names both a gloss and a code column."""
    cells = grid.filter(F.col("row") < rows).withColumn("word", squeeze("value"))
    per_row = cells.groupBy("sheet", "row").agg(
        (F.bool_or(any_word("word", fixed.FRAMEWORK_GLOSS_WORDS, True))
         & F.bool_or(any_word("word", fixed.FRAMEWORK_CODE_WORDS, True))).alias("full"))
    return per_row.filter("full").groupBy("sheet").agg(F.min("row").alias("header"))


def find_columns(grid: DataFrame, header: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """First header column that holds a word of each field; one row per sheet."""
    head = grid.join(header, "sheet").filter(F.col("row") == F.col("header"))
    head = head.withColumn("word", squeeze("value"))
    picks = [F.min(F.when(any_word("word", words), F.col("col"))).alias(field)
             for field, words in fields.items()]
    return head.groupBy("sheet", "header").agg(*picks)


def fill_down(rows: DataFrame, keys: list[str], order: str, fields: list[str],
              block: int = 10_000) -> DataFrame:
    """Fill NULLs of some fields from the nearest earlier row of the same keys.

    ``order`` is an integer row number. Rows are filled inside blocks of it;
    only the last value of every block is carried on, so a very long sheet is
    spread over many tasks.
    """
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "__block").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"__{f}") for f in fields])
    carried = ends.select(*keys, "__block", *[
        F.last(f"__{f}", ignorenulls=True).over(before).alias(f"__{f}") for f in fields])
    filled = rows.withColumns({f: F.last(f, ignorenulls=True).over(inside) for f in fields})
    joined = filled.join(carried, [*keys, "__block"])
    return joined.withColumns({f: F.coalesce(f, f"__{f}") for f in fields}).drop(
        "__block", *[f"__{f}" for f in fields])


def forward_fill(grid: DataFrame, start_row: int = 0, columns: list[int] | None = None) -> DataFrame:
    """Fill blank cells below ``start_row`` from the cell above, for some columns."""
    fits = F.col("row") >= start_row
    if columns is not None:
        fits = fits & F.col("col").isin(columns)
    todo = grid.filter(fits).withColumn("value", cell_text("value"))
    return fill_down(todo, ["sheet", "col"], "row", ["value"]).unionByName(grid.filter(~fits))


def flatten_merged(grid: DataFrame, merged: DataFrame) -> DataFrame:
    """Give every cell of a merged range the value of its top-left cell.

    ``merged`` holds (sheet, row1, col1, row2, col2). Ranges are spelled out
    to cells first, so the join is on equal keys.
    """
    corner = grid.select("sheet", F.col("row").alias("row1"), F.col("col").alias("col1"),
                         F.col("value").alias("corner_value"))
    cells = (
        merged.join(corner, ["sheet", "row1", "col1"], "left")
        .withColumn("row", F.explode(F.sequence("row1", "row2")))
        .withColumn("col", F.explode(F.sequence("col1", "col2")))
        .select("sheet", "row", "col", "corner_value", F.lit(True).alias("covered"))
    )
    joined = grid.join(cells, ["sheet", "row", "col"], "full")
    value = F.when(F.col("covered"), F.col("corner_value")).otherwise(F.col("value"))
    return joined.select("sheet", "row", "col", value.alias("value"))


def pick_columns(grid: DataFrame, columns: DataFrame, fields: list[str]) -> DataFrame:
    """Rows below the header with one named column per field (NULL when blank).

    One row of ``columns`` stands for a whole sheet, so it is sent to the cells: a join would
    bring all cells of a sheet into one task, and keep them there for all that follows.
    """
    body = grid.join(broadcast_if_small(columns), "sheet").filter(F.col("row") > F.col("header"))
    body = body.repartition(TASKS_PER_CORE * grid.sparkSession.sparkContext.defaultParallelism, "sheet", "row")
    picks = [F.max(F.when(F.col("col") == F.col(f"{f}_col"), cell_text("value"))).alias(f) for f in fields]
    return body.groupBy("sheet", "row").agg(*picks)


def filled_rows(grid: DataFrame, header: DataFrame, fields: dict[str, list[str]],
                filled: list[str]) -> DataFrame:
    """Named rows of every sheet, with some fields filled downwards."""
    header = broadcast_if_small(cut_lineage(header))
    columns = cut_lineage(find_columns(grid, header, {f"{f}_col": words for f, words in fields.items()}))
    rows = pick_columns(grid, columns, list(fields))
    return fill_down(rows, ["sheet"], "row", filled)


def sheets_to_text(grid: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """One section per non-empty sheet: cells by tab, rows by line break."""
    cells = grid.withColumn("value", cell_text("value")).filter(F.col("value").isNotNull())
    lines = cells.groupBy(*keys, "sheet", "row").agg(
        _join_sorted("col", "value", "\t").alias("line"))
    text = lines.groupBy(*keys, "sheet").agg(_join_sorted("row", "line", "\n").alias("text"))
    return text.filter(meaningful_chars("text") > 0)


def _join_sorted(order: str, value: str, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.array_join(F.transform(rows, lambda r: r[value]), sep)


def tables_to_text(cells: DataFrame) -> DataFrame:
    """Text of tables given as (table_id, row, col, cell_id, text).

    A merged cell appears once per row: later columns with the same cell_id in
    that row are dropped.
    """
    first = cells.groupBy("table_id", "row", "cell_id").agg(
        F.min("col").alias("col"), F.min_by("text", "col").alias("text"))
    kept = first.withColumn("text", strip("text")).filter(F.col("text") != "")
    lines = kept.groupBy("table_id", "row").agg(_join_sorted("col", "text", "\t").alias("line"))
    return lines.groupBy("table_id").agg(_join_sorted("row", "line", "\n").alias("text"))
