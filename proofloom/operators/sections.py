"""Cut documents into sections.

A document's lines, elements or blocks are handled as one array per row, so
sectioning a table of documents is a narrow map: no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, has_text, heading_level, is_heading, let, meaningful_chars, strip
from ..session import cut_lineage

PART_CHARS = 16_000_000     # characters of blocks sorted by one task
BLOCK_CHARS = 64            # a block's other columns, counted as characters

SECTION = "struct<section_id:string,page_or_sheet:string,text:string,section_title:string>"


def marked_line(text, level, page="1") -> Column:
    page = F.lit(page) if isinstance(page, str) else page
    return F.struct(
        text.alias("text"), level.cast("int").alias("level"), page.cast("string").alias("page"))


def cut_sections(marks, strip_whole: bool = True) -> Column:
    """Sections of an array of (text, level, page); level 0 is body text.

    Up to depth two every title starts a section. Deeper documents are cut at
    levels 1 and 2; a level-1 title then names the following sections and
    deeper titles stay in the body. Section numbers run over non-empty
    sections. Without titles the whole document is one section ``doc``.
    """
    def cut(marks, depth, n):
        by_two = depth >= 3
        lines = lambda a, b: F.array_join(
            F.transform(F.slice(marks, a + 1, b - a), lambda m: m["text"]), "\n")
        nothing = F.array().cast(f"array<{SECTION}>")

        def section(cuts, tops, start, i):
            end = F.coalesce(F.get(cuts, i + 1), n)
            head = F.get(marks, start)
            titled = (head["level"] > 0) & ~(by_two & (head["level"] == 1))
            below = F.when(end > start + 1, lines(start + 1, end)).otherwise(F.lit(""))
            body = F.when(titled, F.concat(head["text"], F.lit("\n"), strip(below))
                          ).otherwise(lines(start, end))
            above = F.try_element_at(F.filter(tops, lambda t: t <= start), F.lit(-1))
            title = F.when(by_two, F.coalesce(F.get(marks, above)["text"], F.lit(""))).otherwise(F.lit(""))
            return F.struct(head["page"].alias("page"), strip(body).alias("text"), title.alias("title"))

        places = F.sequence(F.lit(0), n - 1)
        level = lambda i: F.get(marks, i)["level"]
        cuts = F.filter(places, lambda i: (i == 0) | (
            (level(i) > 0) & (~by_two | (level(i) <= 2))))
        tops = F.when(by_two, F.filter(places, lambda i: level(i) == 1)).otherwise(
            F.array().cast("array<int>"))
        found = let(cuts, lambda cuts: let(tops, lambda tops: F.transform(
            cuts, lambda start, i: section(cuts, tops, start, i))))
        numbered = F.transform(F.filter(found, lambda s: s["text"] != ""), lambda s, i: F.struct(
            F.concat(F.lit("s"), i.cast("string")).alias("section_id"),
            s["page"].alias("page_or_sheet"), s["text"].alias("text"), s["title"].alias("section_title")))

        full = strip(lines(F.lit(0), n)) if strip_whole else lines(F.lit(0), n)
        whole = let(full, lambda t: F.when(has_text(t), F.array(F.struct(
            F.lit("doc").alias("section_id"), F.get(marks, F.lit(0))["page"].alias("page_or_sheet"),
            t.alias("text"), F.lit("").alias("section_title")))).otherwise(nothing))
        return (
            F.when(n <= 0, nothing)
            .when(F.coalesce(depth, F.lit(0)) == 0, whole)
            .otherwise(numbered)
        ).cast(f"array<{SECTION}>")

    deepest = lambda marks: F.array_max(F.transform(marks, lambda m: m["level"]))
    return let(col(marks), lambda marks: let(deepest(marks), lambda depth: let(
        F.size(marks), lambda n: cut(marks, depth, n))))


def markdown_marks(text, titles=None) -> Column:
    """Lines of a Markdown text with the level of each title line.

    ``titles`` is an array of (level, text) used up in order: a heading counts
    only if it equals, or starts with the first ten characters of, the next
    expected title. Without it every heading counts, with its number of ``#``
    as level.
    """
    rows = F.split(col(text), "\n")
    pattern = r"^(#{1,6})\s+(.+)$"
    line = lambda r: strip(r)
    caption = lambda r: strip(F.regexp_extract(line(r), pattern, 2))
    if titles is None:
        hashes = lambda r: F.length(F.regexp_extract(line(r), pattern, 1))
        return F.transform(rows, lambda r: marked_line(
            F.when(hashes(r) > 0, caption(r)).otherwise(r), hashes(r)))

    titles = col(titles)
    start = F.struct(
        F.lit(0).alias("used"),
        F.array().cast("array<struct<text:string,level:int,page:string>>").alias("out"))

    def step(state, r):
        want = F.get(titles, state["used"])
        wanted = strip(want["text"])
        hit = (caption(r) != "") & (
            (caption(r) == wanted) | F.startswith(caption(r), F.substring(wanted, 1, 10)))
        return let(F.coalesce(hit, F.lit(False)), lambda hit: F.struct(
            (state["used"] + F.when(hit, 1).otherwise(0)).alias("used"),
            F.concat(state["out"], F.array(marked_line(
                F.when(hit, caption(r)).otherwise(r), F.when(hit, want["level"]).otherwise(0),
            ))).alias("out")))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def explode_sections(docs: DataFrame, sections: Column) -> DataFrame:
    """One row per section, with its place in the document."""
    return docs.withColumn("__s", F.explode(F.transform(sections, lambda s, i: F.struct(
        i.alias("pos"), s["section_id"].alias("section_id"),
        s["page_or_sheet"].alias("page_or_sheet"), s["text"].alias("text"),
        s["section_title"].alias("section_title"))))).select(
        *[c for c in docs.columns], "__s.*")


def sections_from_markdown(docs: DataFrame, text: str = "text", titles: str | None = None) -> DataFrame:
    kept = [c for c in docs.columns if c not in (text, titles)]
    marked = docs.select(*kept, markdown_marks(text, titles).alias("__marks"))
    return explode_sections(marked, cut_sections("__marks")).drop("__marks")


def sections_from_elements(elements: DataFrame) -> DataFrame:
    """Sections of (doc_id, pos, kind, style, text) paragraph and table records."""
    para = F.col("kind") == "para"
    title = para & is_heading("style", "text")
    level = F.when(title, F.greatest(heading_level(strip("text")), F.lit(1))).otherwise(0)
    body = F.when(para, strip("text")).otherwise(F.col("text"))
    kept = elements.filter(has_text("text")).select(
        "doc_id", F.struct("pos", body.alias("text"), level.cast("int").alias("level"),
                           F.lit("1").alias("page")).alias("e"))
    docs = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("__e"))
    marks = F.transform("__e", lambda e: F.struct(e["text"].alias("text"), e["level"].alias("level"),
                                                  e["page"].alias("page")))
    docs = docs.select("doc_id", marks.alias("__marks"))
    return explode_sections(docs, cut_sections("__marks", False)).drop("__marks")


def title_thresholds(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Font size from which a block is a title, per document (0: none).

    Starts at the 75th percentile of span sizes; when that marks more than
    half of the blocks, the smallest larger size with more than two and at
    most half of the blocks is taken. Spans and blocks are first reduced to
    one row per distinct size, so a huge document does not gather its spans.
    """
    return _thresholds(_span_sizes(spans), _block_sizes(blocks))


def _span_sizes(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("size") > 0).groupBy("doc_id", "size").agg(F.count("*").alias("n"))


def _block_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks, short blocks and characters of every font size of a document."""
    return blocks.groupBy("doc_id", "max_size").agg(
        F.count("*").alias("n"), F.count_if(F.length("text") <= fixed.TITLE_MAX_CHARS).alias("titles"),
        F.sum(F.length("text")).alias("chars"))


def _thresholds(sizes: DataFrame, shape: DataFrame, deal=lambda rows: rows) -> DataFrame:
    upto = Window.partitionBy("doc_id").orderBy("size")
    all_of = Window.partitionBy("doc_id")
    ranked = sizes.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(all_of))
    place = F.least(F.floor(F.col("total") * fixed.TITLE_PERCENTILE), F.col("total") - 1)
    base = ranked.filter(F.col("upto") > place).groupBy("doc_id").agg(F.min("size").alias("base"))

    totals = shape.groupBy("doc_id").agg(F.sum("n").alias("blocks"))
    # hits at a size = short blocks at least that large: a running sum over sizes
    points = deal(sizes.select("doc_id", "size", F.lit(0).cast("long").alias("titles")).unionByName(
        shape.select("doc_id", F.col("max_size").alias("size"), "titles")))
    down = Window.partitionBy("doc_id").orderBy(F.desc("size"))
    hits = (
        points.groupBy("doc_id", "size").agg(F.sum("titles").alias("titles"))
        .withColumn("hits", F.sum("titles").over(down)).select("doc_id", "size", "hits")
    )
    levels = sizes.select("doc_id", "size").join(hits, ["doc_id", "size"]).join(totals, "doc_id")
    levels = levels.join(base, "doc_id").withColumn("ratio", F.col("hits") / F.col("blocks"))
    fits = (F.col("size") > F.col("base")) & (F.col("hits") > fixed.TITLE_MIN_COUNT) & (
        F.col("ratio") <= fixed.TITLE_RATIO_MAX)
    at_base = F.col("size") == F.col("base")
    picked = levels.groupBy("doc_id").agg(
        F.max(F.when(at_base, F.col("hits"))).alias("hits"),
        F.max(F.when(at_base, F.col("ratio"))).alias("ratio"),
        F.first("base").alias("base"),
        F.min(F.when(fits, F.col("size"))).alias("higher"))
    threshold = (
        F.when(F.col("ratio") <= fixed.TITLE_RATIO_MAX,
               F.when(F.col("hits") > 0, F.col("base")).otherwise(0.0))
        .otherwise(F.coalesce("higher", F.lit(0.0))))
    return totals.select("doc_id").join(picked, "doc_id", "left").select(
        "doc_id", F.coalesce(threshold, F.lit(0.0)).alias("threshold"))


def sections_from_blocks(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections of (doc_id, pos, page, max_size, text) blocks cut at title fonts.

    Blocks are dealt by document into a number of parts that follows their characters. Left to adaptive execution,
    which merges parts by their compressed size, a task could sort texts many times that size.
    Sizes and thresholds are dealt likewise, or a join would set the number.
    """
    blocks = blocks.withColumn("text", strip("text")).filter(F.col("text") != "")
    sizes, shape = cut_lineage(_span_sizes(spans)), cut_lineage(_block_sizes(blocks))
    size = shape.agg(F.sum("chars") + BLOCK_CHARS * F.sum("n")).first()[0] or 0
    # one part more than other shuffles have: a deal into as many as the rows come in would be left out as done
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, -(-size // PART_CHARS))
    deal = lambda rows: rows.repartition(parts, "doc_id")
    joined = deal(blocks).join(deal(_thresholds(deal(sizes), deal(shape), deal)), "doc_id")
    title = (F.col("threshold") > 0) & (F.col("max_size") >= F.col("threshold")) & (
        F.length("text") <= fixed.TITLE_MAX_CHARS)
    docs = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "text", F.when(title, 1).otherwise(0).alias("level"),
        F.col("page").cast("string").alias("page")))).alias("__e"))
    marks = F.transform("__e", lambda e: F.struct(e["text"].alias("text"), e["level"].alias("level"),
                                                  e["page"].alias("page")))
    docs = docs.select("doc_id", marks.alias("__marks"))
    return explode_sections(docs, cut_sections("__marks", False)).drop("__marks")


def sections_from_units(units: DataFrame) -> DataFrame:
    """One section per non-empty page, slide or sheet: (doc_id, unit, pos, text)."""
    lines = units.filter(has_text("text")).groupBy("doc_id", "unit").agg(
        F.array_sort(F.collect_list(F.struct("pos", strip("text").alias("text")))).alias("__e"))
    text = F.array_join(F.transform("__e", lambda e: e["text"]), "\n")
    return lines.select(
        "doc_id", F.concat(F.lit("p"), F.col("unit").cast("string")).alias("section_id"),
        F.col("unit").cast("string").alias("page_or_sheet"), text.alias("text"),
        F.lit("").alias("section_title"),
    ).filter(meaningful_chars("text") > 0)


def route_documents(pages: DataFrame) -> DataFrame:
    """``sdk`` for slide-like or scanned documents, else ``text``.

    ``pages`` holds (doc_id, page, chars, width, height, n_images, block_chars).
    """
    sample = F.col("page") <= fixed.SLIDE_PAGES
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(1.0)
    blocks = F.coalesce("block_chars", F.array().cast("array<int>"))
    total = F.aggregate(blocks, F.lit(0.0), lambda a, x: a + x)
    mean_block = F.when(F.size(blocks) > 0, total / F.size(blocks)).otherwise(0.0)
    stats = pages.groupBy("doc_id").agg(
        F.avg(F.when(sample, aspect)).alias("aspect"),
        F.avg(F.when(sample, mean_block)).alias("block"),
        F.avg(F.when(sample, F.col("n_images"))).alias("images"),
        F.min("chars").alias("fewest"))
    slides = (F.col("aspect") > fixed.SLIDE_ASPECT) & (
        (F.col("block") < fixed.SLIDE_BLOCK_CHARS) | (F.col("images") >= fixed.SLIDE_IMAGES))
    route = F.when(slides | (F.col("fewest") < fixed.PAGE_MIN_CHARS), "sdk").otherwise("text")
    return stats.select("doc_id", route.alias("route"))


def number_images(assets: DataFrame) -> DataFrame:
    """Distinct images of every document by content hash, numbered in page order."""
    first = assets.groupBy("doc_id", "sha256").agg(F.min_by(
        F.struct(*[c for c in assets.columns if c not in ("doc_id", "sha256")]),
        F.struct("page", "pos")).alias("a")).select("doc_id", "sha256", "a.*")
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return first.withColumn("number", F.row_number().over(order))


def image_sections(images: DataFrame) -> DataFrame:
    """Section text of described images; recognised text may replace a description."""
    ocr = F.col("type").isin(*fixed.OCR_KINDS) & (meaningful_chars("ocr_text") > fixed.OCR_MIN_CHARS)
    body = F.when(F.coalesce(ocr, F.lit(False)), F.col("ocr_text")).otherwise(
        F.coalesce("description", F.lit("")))
    head = F.concat(F.lit("[图片] 来源："), F.col("file_name"), F.lit(" 第"), F.col("page").cast("string"),
                    F.lit("页 | 类型："), F.coalesce("type", F.lit(fixed.IMAGE_KIND_DEFAULT)))
    return images.withColumn("text", F.concat(head, F.lit("\n"), body))


def union_sections(*frames: DataFrame) -> DataFrame:
    """Text sections followed by image sections."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


HTML_NOISE = r"(?is)<!--.*?-->|<(script|style|head|template)\b.*?</\1>"
HTML_BLOCKS = ("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form "
               "h[1-6] header hr html li main nav ol option p pre section summary td th tr ul").split()
BLOCK_TAG = rf"(?i)</?(?:{'|'.join(HTML_BLOCKS)})\b[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def plain_html(c) -> Column:
    """Text of an HTML fragment: tags dropped, common entities decoded."""
    out = F.regexp_replace(col(c), r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def html_marks(html) -> Column:
    """All visible text of a page in order, cut at block tags, headings with their level.

    A block ends where the next one begins, so unclosed tags lose nothing.
    Tables stay as HTML so that chunking can treat them as tables. Marks in the
    text: 0x01 parts blocks, 0x02 leads a heading's level, 0x03 leads a table.
    """
    cut, head, table = "\x01", "\x02", "\x03"
    clean = F.regexp_replace(F.translate(col(html), cut + head + table, ""), HTML_NOISE, "")
    tables = F.split(F.regexp_replace(clean, r"(?is)(<table\b[^>]*>.*?</table>)", f"{cut}{table}$1{cut}"), cut)
    texts = lambda part: F.split(F.regexp_replace(
        F.regexp_replace(part, r"(?i)<h([1-6])\b[^>]*>", f"{cut}{head}$1"), BLOCK_TAG, cut), cut)
    blocks = F.flatten(F.transform(tables, lambda part: F.when(part.startswith(table), F.array(part)).otherwise(texts(part))))
    level = lambda b: F.when(b.startswith(head), F.substring(b, 2, 1).cast("int")).otherwise(0)
    body = lambda b: F.when(b.startswith(table), F.substr(b, F.lit(2))).otherwise(
        plain_html(F.when(b.startswith(head), F.substr(b, F.lit(3))).otherwise(b)))
    marks = F.transform(blocks, lambda b: marked_line(body(b), level(b)))
    return F.filter(marks, lambda m: m["text"] != "")


def sections_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    kept = [c for c in pages.columns if c != html]
    marked = pages.select(*kept, html_marks(html).alias("__marks"))
    return explode_sections(marked, cut_sections("__marks")).drop("__marks")
