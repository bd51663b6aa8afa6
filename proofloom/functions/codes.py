"""Code extraction from names, serial fields and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, empty_to_null, is_blank, strip


def first_code(c, pattern: str = fixed.CODE_PATTERN) -> Column:
    return empty_to_null(F.regexp_extract(F.upper(col(c)), pattern, 1))


def all_codes(c, pattern: str = fixed.CODE_PATTERN) -> Column:
    """Every code in order of appearance."""
    found = F.regexp_extract_all(F.upper(col(c)), F.lit(pattern), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def distinct_codes(c, pattern: str = fixed.CODE_PATTERN) -> Column:
    return F.array_distinct(all_codes(c, pattern))


def code_prefix(c, prefix: str = fixed.CODE_PREFIX) -> Column:
    """Letters of a code: in brackets first, else as a word of their own."""
    text = F.upper(col(c))
    bracketed = F.regexp_extract(text, rf"[\(（]\s*({prefix})\s*[\)）]", 1)
    word = F.regexp_extract(text, rf"(?U)\b({prefix})\b", 1)
    return F.coalesce(empty_to_null(bracketed), empty_to_null(word))


def serial_number(c) -> Column:
    digits = empty_to_null(F.regexp_extract(col(c), r"(\d+)", 1))
    return F.when(~is_blank(c), digits.try_cast("int"))


def row_code(code, serial, category) -> Column:
    """Code of a checklist row: code cell, else serial cell, else prefix + number."""
    built = F.concat(code_prefix(category), serial_number(serial).cast("string"))
    return F.coalesce(first_code(code), first_code(serial), built)


def code_letters(c) -> Column:
    return F.regexp_extract(F.upper(col(c)), r"^([A-Z]+)", 1)


def code_number(c) -> Column:
    return F.coalesce(F.regexp_extract(col(c), r"(\d+)$", 1).try_cast("int"), F.lit(0))


def natural_order(c) -> list[Column]:
    """Sort keys that put ``EB2`` before ``EB10``."""
    return [code_letters(c), code_number(c), col(c)]


def is_pure_code(c) -> Column:
    return F.upper(strip(c)).rlike(r"^[AGEDS][A-Z]{0,3}\d{1,3}$")


def _lookup(pairs, key: Column) -> Column:
    """Value for ``key`` in a short fixed list."""
    flat = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def dimension_letter(c) -> Column:
    return F.substring(code_letters(c), 1, 1)


def dimension_folder(c) -> Column:
    letter = dimension_letter(c)
    known = _lookup(fixed.DIMENSIONS, letter)
    return F.coalesce(known, F.concat(letter, F.lit(fixed.OTHER_DIMENSION_SUFFIX)))


def topic_folder(c) -> Column:
    letters = code_letters(c)
    return F.coalesce(_lookup(fixed.TOPIC_FOLDERS, letters),
                      F.concat(letters, F.lit(fixed.OTHER_TOPIC_SUFFIX)))


def target_folder(c) -> Column:
    """Folder a file with this code belongs to."""
    return F.when(dimension_letter(c) == "A", F.concat_ws("/", dimension_folder(c), col(c))).otherwise(
        F.concat_ws("/", dimension_folder(c), topic_folder(c), col(c))
    )


def codes_in_file_name(c) -> Column:
    """Codes of a file name, with ``GA1、2,3`` spelled out first."""
    upper = F.upper(col(c))
    runs = F.regexp_extract_all(
        upper, F.lit(r"([AGEDS][A-Z]{0,3}\d{1,2}(?:[、,，]\d{1,2}(?!\d))+)"), F.lit(1)
    )
    spelled = F.flatten(F.transform(runs, lambda run: F.transform(
        F.regexp_extract_all(run, F.lit(r"(\d{1,2})"), F.lit(1)),
        lambda n: F.concat(F.regexp_extract(run, r"^([A-Z]+)", 1), n),
    )))
    return F.array_distinct(F.concat(spelled, all_codes(c)))


def display_folder(parts, best) -> Column:
    """Folder shown for a file, given its path array and best code."""
    parts, best = col(parts), col(best)
    n = F.size(parts)
    top = F.when(n > 1, parts[0]).otherwise(F.lit(fixed.ROOT_FOLDER))
    same = F.filter(parts, lambda p: F.upper(p) == code_letters(best["code"]))
    above = F.when(best["depth"] >= 1, F.get(parts, best["depth"] - 1)).otherwise(
        F.lit(fixed.ROOT_FOLDER))
    return (
        F.when(best.isNull(), top)
        .when(F.size(same) > 0, F.element_at(same, -1))
        .when(best["depth"] == n - 1, above)
        .otherwise(best["part"])
    )
