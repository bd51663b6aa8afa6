"""Source tags, pending marks and no-content answers in drafted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, strip


def source_ids(inner) -> Column:
    """Numbers named by the inside of one source tag, ranges spelled out."""
    parts = F.transform(F.split(col(inner), r"[,，、]"), lambda p: strip(p))

    def spell(part):
        low = F.regexp_extract(part, r"^(\d+)\s*[-–]\s*(\d+)$", 1).try_cast("int")
        high = F.regexp_extract(part, r"^(\d+)\s*[-–]\s*(\d+)$", 2).try_cast("int")
        single = F.when(part.rlike(r"^\d+$"), part.try_cast("int"))
        nothing = F.array().cast("array<int>")
        return (
            F.when(low.isNotNull() & high.isNotNull(),
                   F.when(low <= high, F.sequence(low, high)).otherwise(nothing))
            .when(single.isNotNull(), F.array(single))
            .otherwise(nothing)
        )

    return F.flatten(F.transform(parts, spell))


def cited_sources(c) -> Column:
    """Distinct source numbers of a text in numeric order."""
    tags = F.regexp_extract_all(col(c), F.lit(fixed.SOURCE_TAG), F.lit(1))
    ids = F.flatten(F.transform(tags, source_ids))
    return F.array_sort(F.array_distinct(ids))


def is_no_content(c) -> Column:
    return strip(c).startswith(fixed.NO_CONTENT)


def no_content_analysis(c) -> Column:
    """Text behind the no-content marker, NULL when there is none."""
    rest = strip(F.substring(strip(c), len(fixed.NO_CONTENT) + 1, 1 << 30))
    return F.when(is_no_content(c), F.nullif(rest, F.lit("")))


def citation_warning(cited, words) -> Column:
    """Note for a text with fewer than one source per 200 words."""
    need = F.greatest(F.lit(1), F.floor(col(words) / fixed.WORDS_PER_CITATION)).cast("int")
    note = F.format_string("引用密度偏低：%d 字仅引用 %d 个来源（建议至少 %d 个）",
                           col(words), F.size(col(cited)), need)
    return F.when((col(words) > 0) & (F.size(col(cited)) < need), note)


def clean_for_report(c, keep_pending: bool = True) -> Column:
    """Text without source tags; pending marks set in bold or reduced."""
    plain = F.regexp_replace(col(c), fixed.SOURCE_TAG, "")
    target = "**[待补充：$1]**" if keep_pending else "[待补充]"
    return F.regexp_replace(plain, fixed.PENDING_TAG, target)


def pending_blocks(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(fixed.PENDING_TAG), F.lit(0))


def empty_source_tags(c) -> Column:
    """Number of source tags that lost their numbers; a save needs zero."""
    c = col(c)
    gone = F.length(c) - F.length(F.replace(c, F.lit(fixed.EMPTY_SOURCE_TAG), F.lit("")))
    return (gone / len(fixed.EMPTY_SOURCE_TAG)).cast("int")
