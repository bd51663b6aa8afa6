"""Text measures, cleaning and small parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

BLANK_EDGES = r"(?U)^\s+|\s+$"
PATTERN_MARKS = r"([\\.^$|?*+()\[\]{}])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with ``value`` computed once.

    Array functions evaluate their lambdas as written, so an expression used
    twice inside one is computed twice; a one-element array binds it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Remove any Unicode white space at both ends."""
    return F.regexp_replace(col(c), BLANK_EDGES, "")


def has_text(c) -> Column:
    return col(c).rlike(r"(?U)\S")


def empty_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def meaningful_chars(c) -> Column:
    """Count Han characters, ASCII letters and digits."""
    # taking runs out is several times faster than replacing everything else
    runs = F.regexp_extract_all(col(c), F.lit(r"[一-鿿㐀-䶿a-zA-Z0-9]+"), F.lit(0))
    return F.aggregate(runs, F.lit(0), lambda n, run: n + F.length(run))


def squeeze(c) -> Column:
    """Drop every line break, tab and blank."""
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\n\r\t ]+", ""))


def is_blank(c) -> Column:
    return col(c).isNull() | F.lower(strip(c)).isin("", "nan", "none")


def cell_text(c) -> Column:
    """A spreadsheet cell as trimmed text, NULL when blank."""
    return F.when(~is_blank(c), strip(c))


def word_count(c) -> Column:
    """Characters left once blanks, punctuation and digits are gone."""
    marks = r"""(?U)[\s\[\]【】（）(),.，。、；;：:"'!！?？\-—\d]+"""
    return F.length(F.regexp_replace(col(c), marks, ""))


def heading_level(c) -> Column:
    """Depth of a numbered heading, 1 for Han or chapter numbering, else 0."""
    dotted = F.regexp_extract(col(c), fixed.DOTTED_NUMBER, 1)
    return (
        F.when(dotted != "", F.size(F.split(dotted, r"\.")))
        .when(col(c).rlike(fixed.HAN_NUMBER), 1)
        .otherwise(0)
    )


def is_heading(style, text, max_chars: int = fixed.HEADING_MAX_CHARS) -> Column:
    """True by style name, or for a short paragraph that starts with a number."""
    body = strip(text)
    numbered = body.rlike(fixed.DOTTED_NUMBER) | body.rlike(fixed.HAN_NUMBER)
    short = (F.length(body) > 0) & (F.length(body) <= max_chars)
    return F.coalesce(col(style).rlike(fixed.HEADING_STYLE), F.lit(False)) | (short & numbered)


def title_level(label, text) -> Column:
    """Level of a detected title: document title 1, numbered by depth, else 2."""
    level = heading_level(text)
    return F.when(col(label) == "doc_title", 1).when(level > 0, level).otherwise(2)


def without_control_chars(c) -> Column:
    return F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+", "")


def one_line_preview(c, chars: int = 200) -> Column:
    return F.regexp_replace(F.substring(col(c), 1, chars), r"[\n\r]", " ")


def shorten(c, limit: int, dots: str = "...") -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(dots))).otherwise(c)


def context_text(parent, text, limit: int = fixed.DRAFT_TEXT_LIMIT) -> Column:
    """Parent text if short enough, else own text, else own text cut."""
    parent = F.coalesce(col(parent), F.lit(""))
    text = F.coalesce(col(text), F.lit(""))
    cut = lambda c: F.concat(F.substring(c, 1, limit), F.lit("..."))
    return (
        F.when((parent != "") & (F.length(parent) <= limit), parent)
        .when((text != "") & (F.length(text) <= limit), text)
        .when(text != "", cut(text))
        .when(parent != "", cut(parent))
        .otherwise(F.lit(""))
    )


def format_top(top) -> Column:
    """``[(code, score), ...]`` as ``code:0.91, code:0.85``."""
    parts = F.transform(col(top), lambda x: F.format_string("%s:%.2f", x["code"], x["score"]))
    return F.array_join(parts, ", ")


def top_score(shown) -> Column:
    """First score of a formatted list; 0.0 when there is none."""
    first = F.split(F.split(F.coalesce(col(shown), F.lit("")), ",")[0], ":")
    return F.coalesce(F.get(first, F.lit(1)).try_cast("double"), F.lit(0.0))


def path_parts(c) -> Column:
    return F.transform(F.split(col(c), " > "), lambda p: strip(p))


def project_parts(c) -> tuple[Column, Column]:
    """Company and year of a project id, split at its last underscore."""
    c = col(c)
    company = F.when(c.contains("_"), F.regexp_extract(c, r"(?s)^(.*)_([^_]*)$", 1)).otherwise(c)
    year = F.when(c.contains("_"), F.regexp_extract(c, r"(?s)^(.*)_([^_]*)$", 2)).otherwise("")
    return company, year


def json_items(c, key: str, value: str) -> Column:
    """Rows of a JSON array answer; a Markdown code fence around it is dropped.

    Anything that is not a JSON array gives NULL.
    """
    body = strip(c)
    body = F.regexp_replace(body, r"(?s)^```[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)(^|\n)\s*```\s*$", "")
    schema = f"array<struct<`{key}`:string,`{value}`:string>>"
    return F.when(strip(body).startswith("["), F.from_json(body, schema))


def image_answer(c) -> Column:
    """Kind and description of an image from a two-line answer."""
    c = col(c)
    kind = strip(F.regexp_extract(c, r"类型[：:]\s*(.+?)(?:\n|$)", 1))
    told = strip(F.regexp_extract(c, r"描述[：:]\s*(.+?)(?:\n|$)", 1))
    known = F.array(*[F.lit(k) for k in fixed.IMAGE_KINDS])
    near = F.filter(known, lambda k: (kind != "") & (F.contains(kind, k) | F.contains(k, kind)))
    picked = F.coalesce(
        F.when(F.array_contains(known, kind), kind), F.get(near, F.lit(0)),
        F.lit(fixed.IMAGE_KIND_DEFAULT),
    )
    description = F.when(told != "", F.substring(told, 1, 200)).otherwise(
        F.substring(strip(c), 1, 100)
    )
    return F.struct(picked.alias("type"), description.alias("description"))


def with_instruction(instruction: str, c) -> Column:
    if not instruction:
        return col(c)
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), col(c))


def split_instruction(c) -> Column:
    """Instruction and query of a prefixed text; NULL instruction for plain text."""
    pattern = r"(?s)^Instruct:\s*(.+?)\nQuery:\s*(.+)"
    head = empty_to_null(F.regexp_extract(col(c), pattern, 1))
    body = F.when(head.isNotNull(), F.regexp_extract(col(c), pattern, 2)).otherwise(col(c))
    return F.struct(head.alias("instruction"), body.alias("query"))


def embedding_text(is_table, summary, text) -> Column:
    use = F.coalesce(col(is_table), F.lit(False)) & has_text(F.coalesce(col(summary), F.lit("")))
    return F.when(use, col(summary)).otherwise(col(text))


def content_key(*parts) -> Column:
    """First 16 hex digits of the SHA-256 over all parts."""
    joined = F.concat(*[F.coalesce(col(p), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def query_text(code, topic, indicator, requirement, enhanced=None, limit: int = 500) -> Column:
    """Search text of an indicator: enhanced wording first, else its own fields."""
    piece = lambda c: empty_to_null(strip(F.coalesce(col(c), F.lit(""))))
    base = F.concat_ws(" ", piece(code), piece(topic), piece(indicator))
    need = F.substring(strip(F.coalesce(col(requirement), F.lit(""))), 1, limit)
    own = F.when(need != "", F.concat(base, F.lit("："), need)).otherwise(base)
    if enhanced is None:
        return own
    better = piece(enhanced)
    return F.when(better.isNotNull(), F.concat_ws(" ", col(code), better)).otherwise(own)


def is_photo(c) -> Column:
    return col(c).contains(fixed.PHOTO_MARK)


def image_passes(n_bytes, width, height) -> Column:
    return (
        (col(n_bytes) >= fixed.IMAGE_MIN_BYTES)
        & (col(width) >= fixed.IMAGE_MIN_WIDTH)
        & (col(height) >= fixed.IMAGE_MIN_HEIGHT)
    )


def score_source(rq, hyde, near: float = fixed.SAME_SCORE) -> Column:
    """Which of two routes scored a row higher; ``both`` when they are close."""
    rq, hyde = col(rq), col(hyde)
    return (
        F.when(F.abs(rq - hyde) < near, "both")
        .when(rq > hyde, "retrieval_query")
        .otherwise("hypothetical_doc")
    )


def rank_source(rq, hyde, bm25, near: int = fixed.SAME_RANK) -> Column:
    """Which of three routes ranked a row best; ``multi`` when two are close."""
    entry = lambda c, order, name: F.struct(
        F.coalesce(col(c), F.lit(fixed.MISSING_RANK)).cast("long").alias("rank"),
        F.lit(order).alias("order"), F.lit(name).alias("name"),
    )
    ranks = F.array_sort(F.array(
        entry(rq, 0, "retrieval_query"), entry(hyde, 1, "hypothetical_doc"), entry(bm25, 2, "bm25"),
    ))
    return F.when(ranks[1]["rank"] - ranks[0]["rank"] <= near, "multi").otherwise(ranks[0]["name"])
