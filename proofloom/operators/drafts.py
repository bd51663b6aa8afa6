"""From ranked chunks to prompts, drafts and the assembled report."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations, fixed, template
from ..functions.text import col, context_text, has_text, json_items, strip, word_count
from ..session import broadcast_if_small


def _known(c, missing: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing))


def contexts(results: DataFrame, limit: int = fixed.DRAFT_TEXT_LIMIT, bracketed: bool = False) -> DataFrame:
    """Numbered sources of every leaf as text, and what each number stands for.

    A leaf has at most k results, so a group stays small whatever the corpus.
    """
    file, page = _known("file_name", fixed.UNKNOWN_FILE), _known("page_or_sheet", fixed.UNKNOWN_PAGE)
    number = F.col("rank").cast("string")
    about = F.format_string("%s | 第%s页 | 相关度: %.2f", file, page, F.col("score"))
    if bracketed:
        body = F.substring(F.coalesce(F.nullif("parent_text", F.lit("")), "text", F.lit("")), 1, limit)
        block = F.concat(F.lit("[来源"), number, F.lit(" 开始] "), about, F.lit("\n"), body,
                         F.lit("\n[来源"), number, F.lit(" 结束]\n"))
    else:
        block = F.concat(F.lit("【来源"), number, F.lit("】"), about, F.lit("\n"),
                         context_text("parent_text", "text", limit), F.lit("\n"))
    entry = F.struct(
        "rank", block.alias("block"), F.struct(
            F.col("chunk_id").alias("chunk_id"), file.alias("file_name"), page.alias("page"),
            F.round("score", 4).alias("score")).alias("source"))
    grouped = results.groupBy("leaf_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"]).alias("e"))
    return grouped.select(
        "leaf_id", F.array_join(F.transform("e", lambda e: e["block"]), "\n").alias("context_text"),
        F.map_from_entries(F.transform("e", lambda e: F.struct(
            e["rank"].cast("string"), e["source"]))).alias("sources_mapping"),
        F.array_join(F.transform("e", lambda e: F.concat(
            F.lit("[来源"), e["rank"].cast("string"), F.lit("]"))), ", ").alias("available_sources"))


def quality_gate(leaves: DataFrame, stats: DataFrame,
                 threshold: float = fixed.DRAFT_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Leaves worth drafting, and skipped ones with the reason."""
    joined = leaves.join(stats, "leaf_id", "left").withColumn(
        "max_score", F.coalesce("max_score", F.lit(0.0)))
    low = F.col("max_score") < threshold
    reason = F.format_string(f"low_relevance: 最高相关度 %.3f 低于阈值 {threshold}", F.col("max_score"))
    return joined.filter(~low), joined.filter(low).withColumns(
        {"status": F.lit("skipped"), "skip_reason": reason})


def prompts(leaves: DataFrame, context: DataFrame, system_template: str, user_template: str,
            company: str = "企业", year: str = "2025") -> DataFrame:
    """System and user prompt of every leaf."""
    joined = leaves.join(context, "leaf_id", "left")
    names = ["full_path", "leaf_title", "gloss", "retrieval_query", "context_text", "available_sources"]
    return joined.withColumns({
        "system_prompt": template.fill(system_template, {"company_name": F.lit(company),
                                                         "report_year": F.lit(year)}),
        "user_prompt": template.fill(user_template, {n: n for n in names if n in joined.columns}),
    })


def batches(leaves: DataFrame, size: int = fixed.BATCH_SIZE, group: str = "l1",
            order: str = "row") -> DataFrame:
    """Even batches of at most ``size`` leaves per first level: batch number and width.

    Group sizes come from a partial aggregation and positions from range
    partitions, so a hot group is not sorted in one task; a join on the group
    would bring it into one, so the sizes are sent to the leaves.
    """
    from .ranking import global_rank

    placed = global_rank(leaves, [group], [F.col(order)], "place")
    sized = placed.groupBy(group).agg(F.count("*").alias("group_size")).withColumn(
        "splits", F.ceil(F.col("group_size") / size)).withColumn(
        "width", F.ceil(F.col("group_size") / F.col("splits")))
    return placed.join(broadcast_if_small(sized), group).withColumn(
        "batch", (F.floor((F.col("place") - 1) / F.col("width")) + 1).cast("int")).drop("place")


BATCHES_AT_ONCE = 256       # batches of a group that one task handles at least
PARTS = 64                  # tasks of a group at most, each with a copy of its sibling list
TASKS_PER_CORE = 16         # parts of a group go to tasks in turn
TEXT_AT_ONCE = 1 << 20      # bytes of messages that leave a task at a time; a longer one leaves alone

LIST_HEAD = "## 完整章节列表（供参考，理解各节点间的区分）\n".encode()
OWN_HEAD = "## 待生成节点（只需为以下节点生成输出）\n".encode()
GAP = b"\n\n"


def batch_messages(batched: DataFrame, digest: bool = False) -> DataFrame:
    """Task text of every batch: its leaves, and all siblings if the group was split.

    A message lists its whole group by definition, so the texts of a group grow with its square. A large group
    is dealt to at most ``PARTS`` tasks. Each reads the group's list in order of the batches (which follow the
    order of rows), holds it once and makes one message at a time. With ``digest`` the column ``message`` holds
    the MD5 of the texts and no text is made; what stands in front of a batch is hashed once for all that follow.
    """
    line = F.concat(F.lit("["), F.col("leaf_id"), F.lit("] "), F.col("full_path"))
    own = F.concat(F.lit("["), F.col("leaf_id"), F.lit("] 路径："), F.col("full_path"),
                   F.lit("\n    标题："), F.col("leaf_title"), F.lit("\n    释义："), F.col("gloss"))
    joined = lambda lines: F.nullif(F.array_join(lines, "\n\n"), F.lit(""))
    listed = lambda mark: joined(F.transform("lines", lambda s: F.concat(F.lit(mark), s["line"])))
    step = F.greatest(F.lit(BATCHES_AT_ONCE), F.ceil(F.col("splits") / PARTS))
    part = lambda batch: F.floor((batch - 1) / step)
    last = part(F.ceil(F.col("group_size") / F.col("width")))
    rows = batched.filter(F.col("l1").isNotNull()).groupBy("l1", "batch").agg(
        F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("lines"),
        F.array_sort(F.collect_list(F.struct("row", own.alias("own")))).alias("own"),
        F.array_sort(F.collect_list("leaf_id")).alias("leaf_ids"),
        F.max("splits").alias("splits"), F.max(last).alias("last"), F.max(part(F.col("batch"))).alias("at"))
    mine = F.col("part") == F.col("at")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part")).select(
        "l1", "part", "batch", "splits", listed("  ").cast("binary").alias("plain"), mine.alias("mine"),
        F.when(mine, listed("→ ")).cast("binary").alias("marked"),
        F.when(mine, joined(F.transform("own", lambda o: o["own"]))).cast("binary").alias("own"),
        F.when(mine, F.col("leaf_ids")).alias("leaf_ids"))
    tasks = TASKS_PER_CORE * batched.sparkSession.sparkContext.defaultParallelism
    made = dealt.repartitionById(tasks, F.pmod(F.hash("l1") + F.col("part"), F.lit(tasks)).cast("int")).sortWithinPartitions("l1", "part", "batch").mapInArrow(
        _messages(digest), dealt.select("l1", "batch", "splits", "leaf_ids", F.lit("").alias("message")).schema)
    name = F.when(F.col("splits") > 1, F.concat_ws("_", "l1", F.col("batch").cast("string"))).otherwise(F.col("l1"))
    return made.select("l1", "batch", name.alias("batch_name"), "leaf_ids", "message")


def _messages(digest: bool):
    """Messages of batches from rows in order of (l1, part, batch), as Arrow batches."""
    def made(kind: pa.Schema, siblings: bytearray, own: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        before, at = hashlib.md5(LIST_HEAD, usedforsecurity=False), 0
        with memoryview(siblings) as listed:
            for l1, batch, splits, leaf_ids, start, end, marked, details in own:
                marked = b"" if marked is None else GAP + marked
                tail = GAP + GAP + OWN_HEAD + (b"" if details is None else GAP + details)
                whole = [details or b""] if splits <= 1 else [LIST_HEAD, listed[:start], marked, listed[end:], tail]
                if not digest:
                    text = str(b"".join(whole), "utf-8")
                elif splits <= 1:
                    text = hashlib.md5(whole[0], usedforsecurity=False).hexdigest()
                else:
                    before.update(listed[at:start])
                    at, this = start, before.copy()
                    for piece in whole[2:]:
                        this.update(piece)
                    text = this.hexdigest()
                rows.append((l1, batch, splits, leaf_ids, text))
                size += len(text)
                if size >= TEXT_AT_ONCE:
                    yield _record(rows, kind)
                    rows, size = [], 0
        if rows:
            yield _record(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, siblings, own, kind = None, bytearray(), [], None
        for rows in batches:
            kind = kind or pa.schema([*(rows.schema.field(c) for c in ("l1", "batch", "splits", "leaf_ids")), pa.field("message", pa.string())])
            for r in zip(*(rows.column(c).to_pylist() for c in ("l1", "part", "batch", "splits", "plain", "mine", "marked", "own", "leaf_ids"))):
                l1, part, batch, splits, plain, mine, marked, details, leaf_ids = r
                if (l1, part) != key:
                    yield from made(kind, siblings, own)
                    key, siblings, own = (l1, part), bytearray(), []
                start = len(siblings)
                if plain is not None and splits > 1:
                    siblings += GAP
                    siblings += plain
                if mine:
                    own.append((l1, batch, splits, leaf_ids, start, len(siblings), marked, details))
        yield from made(kind, siblings, own)

    return run


def _record(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def accept_answers(answers: DataFrame, expected: DataFrame, field: str,
                   keys: list[str] = ["batch_name"]) -> tuple[DataFrame, DataFrame]:
    """Expected ids with a non-empty value, and the ids that are missing.

    ``answers`` holds (batch_name, answer), ``expected`` (batch_name, leaf_id).
    The last value of a repeated id counts.
    """
    items = answers.select(*keys, F.posexplode(json_items("answer", "id", field)).alias("at", "item"))
    values = items.select(*keys, F.col("item.id").alias("leaf_id"), F.col(f"item.{field}").alias(field), "at")
    good = values.filter(F.coalesce(F.col(field), F.lit("")) != "").groupBy(*keys, "leaf_id").agg(
        F.max_by(field, "at").alias(field)).join(expected, [*keys, "leaf_id"], "left_semi")
    return good, expected.join(good, [*keys, "leaf_id"], "left_anti")


def final_leaves(leaves: DataFrame, queries: DataFrame, samples: DataFrame) -> DataFrame:
    """Leaves with both texts; a missing one asks for a manual review."""
    joined = leaves.join(queries.select("leaf_id", "retrieval_query"), "leaf_id", "left").join(
        samples.select("leaf_id", "hypothetical_doc"), "leaf_id", "left")
    lacks = F.col("retrieval_query").isNull() | F.col("hypothetical_doc").isNull()
    return joined.withColumn("status", F.when(lacks, "needs_manual_review"))


def route_answers(prepared: DataFrame, answers: DataFrame) -> DataFrame:
    """Status of every prepared leaf from its answer (leaf_id, content, error).

    A failed call is an error, a no-content answer is skipped, all else is a
    draft with counts, citations and a density note. A leaf without an answer
    row stays, as ``no_answer``.
    """
    joined = prepared.join(answers.withColumn("__answered", F.lit(True)), "leaf_id", "left")
    absent = F.col("__answered").isNull()
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    content = F.coalesce("content", F.lit(""))
    nothing = citations.is_no_content(content)
    nothing = nothing & ~absent
    made = ~failed & ~nothing & ~absent
    cited, words = citations.cited_sources(content), word_count(content)
    first = joined.withColumns({
        "status": F.when(absent, "no_answer").when(failed, "error").when(nothing, "skipped").otherwise("generated"),
        "skip_reason": F.when(~failed & nothing, "insufficient_evidence: LLM 判断资料不足以支撑本章节撰写"),
        "no_content_analysis": F.when(~failed & ~absent, citations.no_content_analysis(content)),
        "word_count": F.when(made, words).when(~failed & ~absent, 0),
        "cited_sources": F.when(made, cited).when(~failed & ~absent, F.array().cast("array<int>")),
        "content": F.when(made, content).when(~failed & ~absent, F.lit("")),
    }).drop("__answered")
    return first.withColumn("citation_warning", F.when(
        F.col("status") == "generated", citations.citation_warning("cited_sources", "word_count")))


def rewrite_context(sources: DataFrame, uploads: DataFrame, keys: list[str] = ["chapter_id"],
                    limit: int = fixed.UPLOAD_LIMIT) -> DataFrame:
    """Chosen sources (chapter_id, pos, source_id, text) and uploaded files
    (chapter_id, pos, file_name, text) of a rewrite as two text blocks."""
    def joined(frame, head, body, name):
        rows = F.array_sort(F.collect_list(F.struct("pos", F.concat(
            F.lit("【"), head, F.lit("】\n"), body).alias("block"))))
        return frame.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias(name))

    a = joined(sources, F.concat(F.lit("来源"), F.col("source_id").cast("string")),
               F.coalesce("text", F.lit("")), "source_context")
    b = joined(uploads, F.col("file_name"), F.substring(F.coalesce("text", F.lit("")), 1, limit),
               "uploaded_context")
    out = a.join(b, keys, "full")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_context", "uploaded_context")})


# --- overlays, resume, replacement ----------------------------------------------------------

def overlay_edits(drafts: DataFrame, edits: DataFrame, keys: list[str] = ["leaf_id"]) -> DataFrame:
    """Drafts with edited content, status and word count; empty edits do not count."""
    e = edits.filter(F.coalesce("content", F.lit("")) != "").select(
        *keys, F.col("content").alias("__content"), F.nullif("status", F.lit("")).alias("__status"),
        F.nullif("word_count", F.lit(0)).alias("__words"))
    return drafts.join(e, keys, "left").withColumns({
        "content": F.coalesce("__content", "content"), "status": F.coalesce("__status", "status"),
        "word_count": F.coalesce("__words", "word_count"),
    }).drop("__content", "__status", "__words")


def sources_with_text(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every mapped source of a draft with the text to show and a cited flag."""
    rows = drafts.select("leaf_id", "cited_sources", F.explode("sources_mapping").alias("source_id", "source"))
    flat = rows.select("leaf_id", F.col("source_id").cast("int").alias("source_id"), "source.*",
                       F.coalesce(F.array_contains("cited_sources", F.col("source_id").cast("int")),
                                  F.lit(False)).alias("is_cited"))
    summary = F.col("table_summary") if "table_summary" in chunks.columns else F.lit(None).cast("string")
    shown = chunks.select(
        "chunk_id", F.coalesce(F.nullif(summary, F.lit("")), F.nullif("text", F.lit(""))).alias("text"),
        F.col("is_table").alias("is_table"))
    return flat.join(shown, "chunk_id", "left").withColumns({
        "text": F.coalesce("text", F.lit(fixed.TEXT_MISSING)),
        "is_table": F.coalesce("is_table", F.lit(False))})


def resume(todo: DataFrame, done: DataFrame, key: str = "leaf_id",
           status: str = "generated") -> tuple[DataFrame, DataFrame]:
    """What is left to do, and finished rows of it to keep."""
    finished = done.filter(F.col("status") == status)
    return (todo.join(finished.select(key), key, "left_anti"),
            finished.join(todo.select(key), key, "left_semi"))


def retry_failed(leaves: DataFrame, status: str = "needs_manual_review") -> tuple[DataFrame, DataFrame]:
    """Leaves to run again and leaves to leave untouched."""
    bad = F.coalesce(F.col("status") == status, F.lit(False))
    return leaves.filter(bad), leaves.filter(~bad)


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "leaf_id") -> DataFrame:
    """Old rows with those of the same key replaced, new keys added."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def union_results(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# --- report -----------------------------------------------------------------------------------

def report_rows(drafts: DataFrame, edits: DataFrame | None = None, keep_pending: bool = True,
                order: str = "row", report: list[str] = ["report_id"]) -> DataFrame:
    """Chapters of a report in order, with a flag where a new part begins."""
    rows = drafts.filter(F.col("status").isin(*fixed.REPORT_STATUSES) & F.col("content").isNotNull())
    if edits is not None:
        e = edits.filter(F.coalesce("content", F.lit("")) != "").select(
            "leaf_id", F.col("content").alias("__edit"))
        rows = rows.join(e, "leaf_id", "left").withColumn("content", F.coalesce("__edit", "content")).drop("__edit")
    part = F.split("full_path", " > ")[0]
    before = Window.partitionBy(*report).orderBy(order)
    rows = rows.withColumn("part", part)
    return rows.withColumns({
        "new_part": F.coalesce(F.lag("part").over(before) != F.col("part"), F.lit(True)),
        "content": citations.clean_for_report("content", keep_pending)})


def assemble_report(rows: DataFrame, titles: DataFrame, order: str = "row",
                    report: list[str] = ["report_id"]) -> DataFrame:
    """One Markdown text per report; ``titles`` holds (report_id, title, subtitle).

    A report is one text, so its chapters meet in one row; reports are built in
    parallel.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    toc = F.concat(F.when(F.col("new_part"), F.concat(F.lit("\n### "), F.col("part"), F.lit("\n\n"))).otherwise(""),
                   F.lit("- "), F.col("leaf_title"), F.lit("\n"))
    body = F.concat(
        F.when(F.col("new_part"), F.concat(F.lit("# "), F.col("part"), F.lit("\n\n"))).otherwise(""),
        F.lit("## "), F.col("leaf_title"), F.lit("\n\n"),
        F.when(text("content") != "", F.concat(text("content"), F.lit("\n\n"))).otherwise(""),
        F.lit("---\n\n"))
    parts = rows.groupBy(*report).agg(F.array_sort(F.collect_list(F.struct(
        order, toc.alias("toc"), body.alias("body")))).alias("r"))
    glue = lambda f: F.array_join(F.transform("r", lambda r: r[f]), "")
    joined = parts.join(titles, report)
    return joined.select(*report, F.concat(
        F.lit("# "), text("title"), F.lit("\n\n## "), text("subtitle"), F.lit("\n\n---\n\n## 目录\n\n"),
        glue("toc"), F.lit("\n---\n\n"), glue("body")).alias("report"))
