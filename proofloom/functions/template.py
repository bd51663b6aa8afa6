"""Prompt templates compiled once on the driver into one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, has_text, strip


def _value(variables: dict, name: str, missing: str) -> Column:
    if name not in variables:
        return F.lit(missing)
    return F.coalesce(col(variables[name]).cast("string"), F.lit(""))


def _pieces(template: str, pattern: str, render) -> Column:
    out, at = [], 0
    for hit in re.finditer(pattern, template):
        out.append(F.lit(template[at:hit.start()]))
        out.append(render(hit))
        at = hit.end()
    out.append(F.lit(template[at:]))
    return F.concat(*out)


def fill(template: str, variables: dict) -> Column:
    """Replace ``{name}``; unknown names stay as written."""
    return _pieces(template, r"\{(\w+)\}", lambda m: _value(variables, m[1], m[0]))


def render(template: str, variables: dict) -> Column:
    """Replace ``{{name}}`` and choose ``{{#if name}}…{{else}}…{{/if}}`` blocks.

    Unknown names become empty; three or more line breaks shrink to two.
    """
    plain = lambda text: _pieces(text, r"\{\{(\w+)\}\}", lambda m: _value(variables, m[1], ""))

    def block(m):
        yes, _, no = m[2].partition("{{else}}")
        filled = has_text(_value(variables, m[1], ""))
        return F.when(filled, plain(yes)).otherwise(plain(no))

    out, at = [], 0
    for hit in re.finditer(r"(?s)\{\{#if\s+(\w+)\}\}(.*?)\{\{/if\}\}", template):
        out.append(plain(template[at:hit.start()]))
        out.append(block(hit))
        at = hit.end()
    out.append(plain(template[at:]))
    return strip(F.regexp_replace(F.concat(*out), r"\n{3,}", "\n\n"))
