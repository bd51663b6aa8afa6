"""Cut sections into chunks: tables by rows, text by separators.

Everything here works inside one row (array functions, or one walk over a text in
Arrow batches), so the step from documents to chunks adds no shuffle.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, tables
from ..functions.splitting import chunk_batches
from ..functions.text import col, has_text, let, meaningful_chars, strip
from .sections import SECTION

TABLE = r"(?is)<table[^>]*>.*?</table>"


# --- text ----------------------------------------------------------------------

def recursive_split(text, max_size: int = fixed.CHUNK_MAX, min_size: int = fixed.CHUNK_MIN,
                    separators: list[str] = fixed.SEPARATORS) -> Column:
    """Pieces of at most ``max_size`` characters, cut at the strongest separator.

    Fragments keep their separator, blank fragments are dropped, neighbours are
    packed up to ``max_size``; a last piece below ``min_size`` joins the one
    before it.
    """
    parts = F.when(F.length(col(text)) > 0, F.array(col(text))).otherwise(
        F.array().cast("array<string>"))

    def cut(p, sep):
        def rejoin(found):
            kept = let(F.size(found), lambda n: F.transform(
                found, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit(sep))).otherwise(x)))
            return F.when(F.size(found) == 1, F.array(p)).otherwise(F.filter(kept, has_text))

        return let(F.split(p, rf"\Q{sep}\E", -1), rejoin)

    def refine(parts, cutter):
        return F.flatten(F.transform(parts, lambda p: F.when(
            F.length(p) <= max_size, F.array(p)).otherwise(cutter(p))))

    for sep in separators:
        parts = refine(parts, functools.partial(cut, sep=sep))
    windows = lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p), F.lit(max_size)),
        lambda i: F.substring(p, i, F.lit(max_size)))
    return _pack(refine(parts, windows), max_size, min_size)


def _pack(parts: Column, max_size: int, min_size: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("out"),
                     F.lit(None).cast("string").alias("cur"))

    def step(state, p):
        def place(fits):
            return F.struct(
                F.when(state["cur"].isNull() | fits, state["out"]).otherwise(
                    F.concat(state["out"], F.array(state["cur"]))).alias("out"),
                F.when(fits, F.concat(state["cur"], p)).otherwise(p).alias("cur"))

        return let(F.length(state["cur"]) + F.length(p) <= max_size, place)

    def finish(state):
        out, cur = state["out"], state["cur"]
        n = F.size(out)
        joined = F.concat(F.slice(out, 1, n - 1), F.array(F.concat(F.element_at(out, -1), cur)))
        return (
            F.when(cur.isNull(), out)
            .when((n >= 1) & (F.length(cur) < min_size), joined)
            .otherwise(F.concat(out, F.array(cur))))

    return F.aggregate(parts, start, step, finish)


def merge_short_sections(sections, min_size: int = fixed.CHUNK_MIN,
                         max_size: int = fixed.CHUNK_MAX) -> Column:
    """Join short sections of an array to the next one, else to the one before.

    A section is short below ``min_size`` meaningful characters; no join may
    exceed ``max_size``. The earlier section gives id and page, the first
    non-empty title stays.
    """
    start = F.struct(F.array().cast(f"array<{SECTION}>").alias("out"),
                     F.lit(None).cast(SECTION).alias("held"))

    def join(a, b):
        return F.struct(
            a["section_id"].alias("section_id"), a["page_or_sheet"].alias("page_or_sheet"),
            F.concat(a["text"], F.lit("\n"), b["text"]).alias("text"),
            F.coalesce(F.nullif(a["section_title"], F.lit("")), b["section_title"], F.lit(""))
            .alias("section_title")).cast(SECTION)

    fits = lambda a, b: F.length(a["text"]) + F.length(b["text"]) + 1 <= max_size

    def settle(out, held):
        """Put a section that cannot grow forward in its place."""
        def place(before):
            backward = (meaningful_chars(held["text"]) < min_size) & before.isNotNull() & fits(before, held)
            return F.when(F.coalesce(backward, F.lit(False)), F.concat(
                F.slice(out, 1, F.size(out) - 1), F.array(join(before, held)))
            ).otherwise(F.concat(out, F.array(held)))

        return let(F.try_element_at(out, F.lit(-1)), place)

    def step(state, s):
        held, out = state["held"], state["out"]
        forward = (meaningful_chars(held["text"]) < min_size) & fits(held, s)
        state_of = lambda o, h: F.struct(o.alias("out"), h.alias("held"))
        return (
            F.when(held.isNull(), state_of(out, s))
            .when(forward, state_of(out, join(held, s)))
            .otherwise(state_of(settle(out, held), s)))

    return F.aggregate(col(sections).cast(f"array<{SECTION}>"), start, step, lambda s: F.when(
        s["held"].isNull(), s["out"]).otherwise(settle(s["out"], s["held"])))


# --- tables ----------------------------------------------------------------------

PART = "array<struct<table_html:string,table_markdown:string,first_row:int,end_row:int,row_count:int>>"


def _each(function, returns: str):
    """A column of ``function`` of every non-null text, in Arrow batches: spans need a walk over the rows of a table."""
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))
    return run


def table_to_markdown(html) -> Column:
    """One HTML table as Markdown, first row as header; unreadable ones unchanged.

    A cell that spans rows or columns is repeated in every place it covers.
    """
    return _each(tables.as_markdown, "string")(col(html))


def split_table(html, max_rows: int = fixed.TABLE_ROWS) -> Column:
    """A table in parts of ``max_rows`` data rows, the header on each; spanning cells are repeated."""
    return _each(functools.partial(tables.parts, max_rows=max_rows), PART)(col(html))


def table_html_list(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TABLE), F.lit(0))


def tables_as_markdown(text) -> Column:
    """Text with every HTML table replaced by its Markdown form."""
    some = F.lower(col(text)).contains("<table")
    return F.when(some, _each(tables.text_as_markdown, "string")(F.when(some, col(text)))).otherwise(col(text))


def segments(text) -> Column:
    """Ordered content and table segments of a section text."""
    outside = F.split(col(text), TABLE, -1)
    segment = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    weave = lambda tables: F.flatten(F.transform(outside, lambda t, i: F.array(
        segment("content", strip(t)), segment("table", F.coalesce(F.get(tables, i), F.lit(""))))))
    return F.filter(let(table_html_list(text), weave), lambda s: s["body"] != "")


# --- chunks -------------------------------------------------------------------------

def make_chunks(sections: DataFrame, path: str = "relative_path", max_size: int = fixed.CHUNK_MAX,
                min_size: int = fixed.CHUNK_MIN, max_rows: int = fixed.TABLE_ROWS, keep_blank: bool = False) -> DataFrame:
    """Chunk rows of section rows; other columns are kept.

    Tables are cut by rows, texts by separators; a text piece below ``min_size`` joins the nearest text
    piece before it, else the next one, over tables in between. A piece of white space alone is left out
    or, with ``keep_blank``, treated like any short piece, so that no character is lost. A section is cut by
    positions in one walk, so the work grows with its length; its chunks leave the task in bounded batches.
    """
    others = [c for c in sections.columns if c not in ("text", "section_id", "pos")]
    rows = sections.select(
        F.struct(*[F.col(c) for c in others] or [F.lit(None).cast("string").alias("none")]).alias("row"),
        F.concat_ws("#", F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.col("section_id")).alias("parent_id"), F.col("text").cast("string").alias("text"))
    made = T.StructType([rows.schema["row"], *T.StructType.fromDDL(
        "parent_id string, chunk_id string, chunk_pos int, text string, char_count int, is_table boolean, table_html string, table_rows int").fields])
    chunks = rows.mapInArrow(chunk_batches(max_size, min_size, max_rows, keep_blank), made)
    return chunks.select(
        "chunk_id", "parent_id", *[F.col("row")[c].alias(c) for c in others], "chunk_pos", "text", "char_count", "is_table",
        F.when(F.col("is_table"), F.col("text")).alias("table_markdown"), "table_html", "table_rows")


def make_parents(sections: DataFrame, path: str = "relative_path") -> DataFrame:
    """Parent texts, stored once per section."""
    return sections.select(
        F.concat_ws("#", F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.col("section_id")).alias("parent_id"),
        tables_as_markdown("text").alias("parent_text")).filter(has_text("parent_text"))


def merge_section_rows(sections: DataFrame, doc: list[str], min_size: int = fixed.CHUNK_MIN,
                       max_size: int = fixed.CHUNK_MAX) -> DataFrame:
    """``merge_short_sections`` for a table with one row per section.

    Runs between two long neighbours never interact, so a document is cut
    there and only those runs are gathered.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*doc).orderBy("pos")
    long = meaningful_chars("text") >= min_size
    marked = sections.withColumn("__long", long).withColumn(
        "__cut", (F.col("__long") & F.lag("__long", 1, False).over(order)).cast("long"))
    runs = marked.withColumn("__run", F.sum("__cut").over(order))
    rows = runs.groupBy(*doc, "__run").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "section_id", "page_or_sheet", "text", "section_title"))).alias("s"))
    merged = merge_short_sections(F.transform("s", lambda s: F.struct(
        s["section_id"].alias("section_id"), s["page_or_sheet"].alias("page_or_sheet"),
        s["text"].alias("text"), s["section_title"].alias("section_title"))), min_size, max_size)
    first = F.col("s")[0]["pos"]
    return rows.select(*doc, first.alias("__first"), F.posexplode(merged).alias("__i", "m")).select(
        *doc, (F.col("__first") + F.col("__i")).alias("pos"), "m.*")


def chunk_params(ext, overrides: dict[str, tuple[int | None, int | None]] | None = None) -> Column:
    """Chunk limits of a file kind; missing values come from the global ones."""
    overrides = overrides or {}
    high, low = F.lit(None).cast("int"), F.lit(None).cast("int")
    for kind, (mx, mn) in overrides.items():
        high = F.when(col(ext) == kind, F.lit(mx).cast("int")).otherwise(high)
        low = F.when(col(ext) == kind, F.lit(mn).cast("int")).otherwise(low)
    return F.struct(F.coalesce(high, F.lit(fixed.CHUNK_MAX)).alias("max_size"),
                    F.coalesce(low, F.lit(fixed.CHUNK_MIN)).alias("min_size"))


# --- context around chunks ---------------------------------------------------------------

def _find(parent, text) -> Column:
    """Position of a text in its parent (0: none), by its first three lines if need be."""
    lines = F.array_join(F.slice(F.split(text, "\n"), 1, 3), "\n")
    whole = F.position(text, parent)
    return F.when(whole > 0, whole).when(lines != "", F.position(lines, parent)).otherwise(0)


def table_context(table_markdown, parent_text, chars: int = fixed.TABLE_CONTEXT_CHARS) -> Column:
    """Up to ``chars`` characters before and after a table in its parent."""
    table, parent = F.coalesce(col(table_markdown), F.lit("")), F.coalesce(col(parent_text), F.lit(""))
    at = F.when((table != "") & (parent != ""), _find(parent, table)).otherwise(0)
    before = strip(F.substring(parent, F.lit(1), at - 1))
    after = strip(F.substring(parent, at + F.length(table), F.length(parent)))
    return F.struct(
        F.when(at > 0, F.right(before, F.lit(chars))).otherwise("").alias("before"),
        F.when(at > 0, F.left(after, F.lit(chars))).otherwise("").alias("after"))


def chunk_context(text, table_markdown, parent_text, limit: int = fixed.PARENT_LIMIT,
                  chars: int = fixed.TABLE_CONTEXT_CHARS) -> Column:
    """Whole parent when short, else the chunk with ``chars`` around it."""
    parent = F.coalesce(col(parent_text), F.lit(""))
    body = F.coalesce(col(table_markdown), col(text))
    at = _find(parent, body)
    start = F.greatest(at - 1 - chars, F.lit(0))
    end = F.least(at - 1 + F.length(body) + chars, F.length(parent))
    return (
        F.when(parent == "", col(text))
        .when(F.length(parent) <= limit, parent)
        .when(at == 0, col(text))
        .otherwise(F.substring(parent, start + 1, end - start)))


def apply_table_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Put (chunk_id, summary) in front of the table text of table chunks."""
    joined = chunks.join(summaries.withColumnRenamed("summary", "__summary"), "chunk_id", "left")
    use = F.coalesce(F.col("is_table"), F.lit(False)) & (F.coalesce("__summary", F.lit("")) != "")
    text = F.concat(F.lit("[表格摘要]\n"), F.col("__summary"), F.lit("\n\n[表格数据]\n"),
                    F.coalesce("table_markdown", F.lit("")))
    return (
        joined.withColumn("table_summary", F.when(use, F.col("__summary")))
        .withColumn("text", F.when(use, text).otherwise(F.col("text")))
        .withColumn("char_count", F.when(use, F.length("text")).otherwise(F.col("char_count")))
        .drop("__summary"))
