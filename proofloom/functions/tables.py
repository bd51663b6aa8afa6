"""HTML tables as rows of cell texts, as Markdown, and cut by rows.

A cell that spans rows or columns stands in every place it covers. Open spans are
carried from row to row as (column, rows left, text); they end with the table.
"""

from __future__ import annotations

import re

TABLE = re.compile(r"<table[^>]*>.*?</table>", re.I | re.S)
#: Unicode white space.
BLANK = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: The largest spans that HTML knows.
MAX_COLUMNS, MAX_ROWS = 1000, 65534

_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)</t[dh]>", re.I | re.S)
_SPANS = {kind: re.compile(rf"\b{kind}span\s*=\s*[\"']?\s*(\d+)", re.I) for kind in ("row", "col")}
_TAG = re.compile(r"<[^>]*>", re.S)
_RUN = re.compile(f"[{BLANK}]+")
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain(fragment: str) -> str:
    """Text of an HTML fragment: tags dropped, common entities decoded, white space squeezed."""
    out = _TAG.sub("", fragment)
    for entity, char in _ENTITIES:
        out = out.replace(entity, char)
    return _RUN.sub(" ", out).strip(BLANK)


def _span(attributes: str, kind: str, most: int) -> int:
    """Rows or columns that a cell covers; 0 rows mean all that follow."""
    found = _SPANS[kind].search(attributes)
    n = min(int(found.group(1)), most) if found else 1
    return (most if kind == "row" else 1) if n == 0 else n


def grid(html: str) -> list[list[str]]:
    """Rows of a table, all as wide as the widest."""
    rows: list[list[str]] = []
    above: dict[int, tuple[int, str]] = {}  # column: rows left, text
    for line in _ROW.finditer(html):
        cells = [(m.group(1), m.group(2)) for m in _CELL.finditer(line.group(1))]
        if not cells and not above:
            continue
        row: list[str] = []
        below: dict[int, tuple[int, str]] = {}

        def put(rows_left: int, text: str) -> None:
            if rows_left:
                below[len(row)] = (rows_left, text)
            row.append(text)

        def covered() -> None:
            while len(row) in above:
                left, text = above.pop(len(row))
                put(left - 1, text)

        for attributes, body in cells:
            covered()
            text, down = plain(body), _span(attributes, "row", MAX_ROWS) - 1
            for _ in range(_span(attributes, "col", MAX_COLUMNS)):
                above.pop(len(row), None)  # a wide cell that runs into an open span hides it
                put(down, text)
        while above:
            covered()
            if above:
                row.append("")
        rows.append(row)
        above = below
    width = max(map(len, rows), default=0)
    return [row + [""] * (width - len(row)) for row in rows]


def markdown(rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def table_html(rows: list[list[str]]) -> str:
    def line(cells: list[str], tag: str) -> str:
        return "<tr>" + "".join(f"<{tag}>{c.replace('&', '&amp;').replace('<', '&lt;')}</{tag}>" for c in cells) + "</tr>"

    return "<table>" + line(rows[0], "th") + "".join(line(r, "td") for r in rows[1:]) + "</table>"


def as_markdown(html: str) -> str:
    """One table, first row as header; an unreadable one unchanged."""
    rows = grid(html)
    return markdown(rows) if rows else html


def parts(html: str, max_rows: int) -> list[tuple[str, str, int, int, int]]:
    """(table_html, table_markdown, first_row, end_row, row_count) per ``max_rows`` data rows, the header on each."""
    rows = grid(html)
    if not rows:
        return [(html, html, 0, 0, 0)]
    n = len(rows) - 1
    out = []
    for at in range(0, max(n, 1), max_rows):
        some = [rows[0], *rows[1 + at:1 + at + max_rows]]
        out.append((html if n <= max_rows else table_html(some), markdown(some), at, min(at + max_rows, n), len(some) - 1))
    return out


def text_as_markdown(text: str) -> str:
    """A text with every table in its place as Markdown."""
    return TABLE.sub(lambda m: f"\n{as_markdown(m.group(0))}\n", text)


def segments(text: str) -> list[tuple[str, str]]:
    """Ordered (``content`` or ``table``, body) parts of a text; blank ones are left out."""
    out, at = [], 0
    for found in [*TABLE.finditer(text), None]:
        body = text[at:found.start() if found else len(text)].strip(BLANK)
        if body:
            out.append(("content", body))
        if found:
            out.append(("table", found.group(0)))
            at = found.end()
    return out
