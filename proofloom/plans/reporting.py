"""Queries over drafting, history, browsing, model reuse and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.splitting import split_batches
from ..functions.text import content_key, has_text
from ..operators import browse as B
from ..operators import drafts as D
from ..operators import history as H
from ..operators import lexical as L
from ..operators import model as M
from ..operators import stats
from ..operators import vectors as V
from ..session import cut_lineage, table, text_table, work_folder
from ..sources import sinks
from ..streaming import ingest as I
from ..streaming import progress as P
from ..streaming import run_states as R
from . import tables as t
from .chunking import split_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return keep


# --- contexts ------------------------------------------------------------------------

def passages(spark, sf):
    """Five best documents of every question, with file, page and parent text."""
    docs = text_table(spark, sf, "documents")
    hits = L.search(docs, "doc_id", table(spark, sf, "benchmark"), "item_id", 5)
    key = F.col("doc_id")
    facts = docs.select(
        "doc_id", F.when(key % 5 != 0, F.col("source")).alias("file_name"),
        F.when(key % 7 != 0, (key % 9).cast("string")).alias("page_or_sheet"),
        F.col("text"), F.when(key % 2 == 0, F.col("text")).alias("parent_text"))
    return hits.join(facts, "doc_id").select(
        F.col("item_id").alias("leaf_id"), "rank", "score", key.cast("string").alias("chunk_id"),
        "file_name", "page_or_sheet", "text", "parent_text")


_PASSAGES = f"""d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT item_id AS qid, text FROM benchmark), {t.BM25},
passages AS (SELECT qid AS leaf_id, rank, score, CAST(id AS VARCHAR) AS chunk_id, CASE WHEN id % 5 <> 0 THEN source ELSE '未知文件' END AS file_name,
  CASE WHEN id % 7 <> 0 THEN CAST(id % 9 AS VARCHAR) ELSE '?' END AS page, o.text AS text, CASE WHEN id % 2 = 0 THEN o.text END AS parent_text
  FROM bm25 JOIN documents o ON o.doc_id = id WHERE rank <= 5)"""


@query(f"""WITH {_PASSAGES} SELECT leaf_id, md5(string_agg('【来源' || rank || '】' || file_name || ' | 第' || page || '页 | 相关度: ' || printf('%.2f', score) || chr(10) ||
  CASE WHEN length(parent_text) <= 2000 THEN parent_text WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 2000) || '...' END || chr(10), chr(10) ORDER BY rank)) AS context_text,
  string_agg(chunk_id || '/' || file_name || '/' || page, ';' ORDER BY rank) AS sources, string_agg('[来源' || rank || ']', ', ' ORDER BY rank) AS available FROM passages GROUP BY leaf_id""")
def source_contexts(spark, sf):
    """D1"""
    rows = D.contexts(passages(spark, sf))
    listed = F.transform(F.array_sort(F.map_entries("sources_mapping")), lambda e: F.concat_ws(
        "/", e["value"]["chunk_id"], e["value"]["file_name"], e["value"]["page"]))
    return rows.select("leaf_id", F.md5("context_text").alias("context_text"), F.array_join(listed, ";").alias("sources"),
                       F.col("available_sources").alias("available"))


@query(f"""WITH {_PASSAGES} SELECT leaf_id, md5(string_agg('[来源' || rank || ' 开始] ' || file_name || ' | 第' || page || '页 | 相关度: ' || printf('%.2f', score) || chr(10) ||
  substr(coalesce(parent_text, text), 1, 2000) || chr(10) || '[来源' || rank || ' 结束]' || chr(10), chr(10) ORDER BY rank)) AS context_text FROM passages GROUP BY leaf_id""")
def bracketed_contexts(spark, sf):
    """D1, bracketed form"""
    return D.contexts(passages(spark, sf), bracketed=True).select("leaf_id", F.md5("context_text").alias("context_text"))


@query(f"""WITH {_PASSAGES} SELECT leaf_id, rank, chunk_id, coalesce(nullif(text, ''), '[原文未找到]') AS text, rank IN (1, 3) AS is_cited FROM passages WHERE rank > 0""".replace(
    "coalesce(nullif(text, ''), '[原文未找到]')", "CASE WHEN CAST(chunk_id AS BIGINT) % 3 = 0 THEN '[原文未找到]' ELSE text END"))
def cited_source_texts(spark, sf):
    """Sources of a draft with their text; every third chunk is gone"""
    rows = D.contexts(passages(spark, sf)).select("leaf_id", "sources_mapping", F.array(F.lit(1), F.lit(3)).alias("cited_sources"))
    chunks = table(spark, sf, "documents").filter("doc_id % 3 <> 0").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text"), F.lit(False).alias("is_table"))
    return D.sources_with_text(rows, chunks).select("leaf_id", F.col("source_id").alias("rank"), "chunk_id", "text", "is_cited")


@query(f"""WITH {_PASSAGES}, s AS (SELECT leaf_id, round(max(score), 4) AS max_score FROM passages GROUP BY 1)
SELECT item_id AS leaf_id, CASE WHEN coalesce(max_score, 0) < 60 THEN 'skipped' ELSE 'prepared' END AS status FROM benchmark LEFT JOIN s ON leaf_id = item_id""")
def draft_quality_gate(spark, sf):
    """D2"""
    leaves = table(spark, sf, "benchmark").select(F.col("item_id").alias("leaf_id"))
    figures = passages(spark, sf).groupBy("leaf_id").agg(F.round(F.max("score"), 4).alias("max_score"))
    good, low = D.quality_gate(leaves, figures, 60.0)
    return good.select("leaf_id", F.lit("prepared").alias("status")).unionByName(low.select("leaf_id", "status"))


@query(f"""WITH {_PASSAGES}, c AS (SELECT leaf_id, string_agg('[来源' || rank || ']', ', ' ORDER BY rank) AS a FROM passages GROUP BY 1)
SELECT item_id AS leaf_id, md5('Write for Acme 2026.') AS system_prompt, md5('Title: leaf ' || item_id || chr(10) || 'Need: ' || text || chr(10) || 'Sources: ' || coalesce(a, '')) AS user_prompt
FROM benchmark LEFT JOIN c ON leaf_id = item_id""")
def prompt_pairs(spark, sf):
    """D3 F24"""
    leaves = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("leaf_id"), F.concat(F.lit("leaf "), F.col("item_id").cast("string")).alias("leaf_title"),
        F.col("text").alias("retrieval_query"))
    rows = D.prompts(leaves, D.contexts(passages(spark, sf)), "Write for {company_name} {report_year}.",
                     "Title: {leaf_title}\nNeed: {retrieval_query}\nSources: {available_sources}", "Acme", "2026")
    return rows.select("leaf_id", F.md5("system_prompt").alias("system_prompt"), F.md5("user_prompt").alias("user_prompt"))


# --- leaf batches and answers ------------------------------------------------------------

_BATCHES = f"""{t.FRAMEWORK}, sized AS (SELECT *, count(*) OVER (PARTITION BY l1) AS group_size, row_number() OVER (PARTITION BY l1 ORDER BY "row") AS place FROM leaves),
cut AS (SELECT *, CAST(ceil(group_size / 15) AS BIGINT) AS splits, CAST(ceil(group_size / ceil(group_size / 15)) AS BIGINT) AS width FROM sized),
batched AS (SELECT *, CAST((place - 1) // width + 1 AS INTEGER) AS batch FROM cut)"""


@query(f"""WITH {_BATCHES} SELECT leaf_id, l1, group_size, splits, width, batch FROM batched""")
def leaf_batches(spark, sf):
    """W2"""
    return D.batches(t.leaf_rows(spark, sf)).select("leaf_id", "l1", "group_size", "splits", "width", "batch")


@query(f"""WITH {_BATCHES}, own AS (SELECT l1, batch, max(splits) AS splits, string_agg('[' || leaf_id || '] 路径：' || full_path || chr(10) || '    标题：' || leaf_title || chr(10) || '    释义：' || gloss,
    chr(10) || chr(10) ORDER BY "row") AS own, string_agg(leaf_id, ',' ORDER BY leaf_id) AS ids FROM batched GROUP BY ALL),
around AS (SELECT o.l1, o.batch, string_agg(CASE WHEN b.batch = o.batch THEN '→ ' ELSE '  ' END || '[' || leaf_id || '] ' || full_path, chr(10) || chr(10) ORDER BY "row") AS siblings
  FROM own o JOIN batched b ON b.l1 = o.l1 GROUP BY ALL)
SELECT l1, batch, CASE WHEN splits > 1 THEN l1 || '_' || batch ELSE l1 END AS batch_name, md5(ids) AS leaf_ids,
  md5(CASE WHEN splits > 1 THEN '## 完整章节列表（供参考，理解各节点间的区分）' || chr(10) || chr(10) || chr(10) || siblings || chr(10) || chr(10) || chr(10) || chr(10) ||
    '## 待生成节点（只需为以下节点生成输出）' || chr(10) || chr(10) || chr(10) || own ELSE own END) AS message FROM own JOIN around USING (l1, batch)""")
def batch_prompts(spark, sf):
    """D4"""
    rows = D.batch_messages(D.batches(t.leaf_rows(spark, sf)), digest=True)
    return rows.select("l1", "batch", "batch_name", F.md5(F.array_join("leaf_ids", ",")).alias("leaf_ids"), "message")


def _answers(spark, sf):
    """One JSON answer per conversation; some turns get no value, some answers are broken."""
    c = table(spark, sf, "conversations")
    item = F.to_json(F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("turn") % 4 != 3, F.col("role")).otherwise("").alias("value")))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))).alias("r"))
    body = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: r["x"]), ","), F.lit("]"))
    answer = F.when(F.col("conv_id") % 5 == 4, "no json").when(
        F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    name = F.col("conv_id").cast("string").alias("batch_name")
    expected = c.select(name, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("leaf_id"))
    return rows.select(name, answer.alias("answer")), expected


@query("""SELECT CAST(conv_id AS VARCHAR) AS batch_name, conv_id || '-' || turn AS leaf_id,
  CASE WHEN conv_id % 5 <> 4 AND turn % 4 <> 3 THEN role END AS value FROM conversations""")
def answer_validation(spark, sf):
    """D6 F25"""
    good, missing = D.accept_answers(*_answers(spark, sf), "value")
    return good.unionByName(missing.withColumn("value", F.lit(None).cast("string")))


def _final_leaves(spark, sf):
    leaves = t.leaf_rows(spark, sf)
    queries = leaves.filter("row % 5 <> 0").select("leaf_id", F.concat(F.lit("q "), "leaf_title").alias("retrieval_query"))
    samples = leaves.filter("row % 7 <> 0").select("leaf_id", F.concat(F.lit("h "), "leaf_title").alias("hypothetical_doc"))
    return D.final_leaves(leaves, queries, samples)


@query(f"""WITH {t.FRAMEWORK} SELECT leaf_id, CASE WHEN "row" % 5 <> 0 THEN 'q ' || leaf_title END AS retrieval_query,
  CASE WHEN "row" % 7 <> 0 THEN 'h ' || leaf_title END AS hypothetical_doc,
  CASE WHEN "row" % 5 = 0 OR "row" % 7 = 0 THEN 'needs_manual_review' END AS status FROM leaves""")
def final_leaf_table(spark, sf):
    """D7"""
    return _final_leaves(spark, sf).select("leaf_id", "retrieval_query", "hypothetical_doc", "status")


@query(f"""WITH {t.FRAMEWORK} SELECT count(*) AS total, count(*) FILTER (WHERE "row" % 5 <> 0) AS rq_ok, count(*) FILTER (WHERE "row" % 7 <> 0) AS hyde_ok,
  count(*) FILTER (WHERE "row" % 5 <> 0 AND "row" % 7 <> 0) AS both_ok, count(*) FILTER (WHERE "row" % 5 = 0 OR "row" % 7 = 0) AS needs_review FROM leaves""")
def query_completeness(spark, sf):
    """A18"""
    return stats.query_completeness(_final_leaves(spark, sf))


@query(f"""WITH {t.FRAMEWORK} SELECT leaf_id, "row" % 5 = 0 OR "row" % 7 = 0 AS again FROM leaves""")
def leaves_to_retry(spark, sf):
    """J10 A18"""
    again, kept = D.retry_failed(_final_leaves(spark, sf))
    return again.select("leaf_id", F.lit(True).alias("again")).unionByName(kept.select("leaf_id", F.lit(False).alias("again")))


# --- drafts --------------------------------------------------------------------------------

_DRAFT_TEXT = """text || CASE turn % 4 WHEN 0 THEN '[来源' || (turn + 3) || ',' || (turn + 1) || '-' || (turn + 2) || ']' WHEN 1 THEN '[来源' || turn || '、' || (turn + 5) || ']' ELSE '' END"""


def draft_rows(spark, sf):
    """Routed answers, one per conversation turn; some fail, some find nothing."""
    turn, s = F.col("turn"), lambda c: c.cast("string")
    tail = (F.when(turn % 4 == 0, F.concat(F.lit("[来源"), s(turn + 3), F.lit(","), s(turn + 1), F.lit("-"), s(turn + 2), F.lit("]")))
            .when(turn % 4 == 1, F.concat(F.lit("[来源"), s(turn), F.lit("、"), s(turn + 5), F.lit("]"))).otherwise(F.lit("")))
    c = table(spark, sf, "conversations").withColumn("leaf_id", F.concat_ws("-", s(F.col("conv_id")), s(turn)))
    prepared = c.select("leaf_id", "conv_id", "turn", (F.col("conv_id") * 100 + turn).alias("row"),
                        F.concat(F.lit("part "), s((turn / 2).cast("int")), F.lit(" > "), "role").alias("full_path"),
                        F.concat(F.col("role"), F.lit(" "), s(turn)).alias("leaf_title"),
                        (turn + 10).alias("prompt_tokens"), (turn * 2).alias("completion_tokens"))
    kind = F.col("conv_id") % 10
    answers = c.select(
        "leaf_id", F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.concat(F.lit("[NO_CONTENT]\n"), "text"))
        .otherwise(F.concat("text", tail)).alias("content"), F.when(kind == 0, "TimeoutError").alias("error"))
    return D.route_answers(prepared, answers)


_COUNT_WORDS = r"length(regexp_replace({0}, '[\s\p{{Z}}\[\]【】（）(),.，。、；;：:\"''!！?？\-—\d]', '', 'g'))".replace('\\"', '"')
_ROUTED = rf"""a AS (SELECT *, conv_id || '-' || turn AS leaf_id, conv_id % 10 AS kind, {_DRAFT_TEXT} AS full_text FROM conversations),
routed AS (SELECT leaf_id, conv_id, turn, role, conv_id * 100 + turn AS "row", 'part ' || (turn // 2) || ' > ' || role AS full_path, role || ' ' || turn AS leaf_title,
  turn + 10 AS prompt_tokens, turn * 2 AS completion_tokens, CASE kind WHEN 0 THEN 'error' WHEN 1 THEN 'skipped' ELSE 'generated' END AS status,
  CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN '' ELSE full_text END AS content,
  CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN 0 ELSE {_COUNT_WORDS.format('full_text')} END AS word_count,
  CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN '' WHEN turn % 4 = 0 THEN (turn + 1) || ',' || (turn + 2) || ',' || (turn + 3) WHEN turn % 4 = 1 THEN turn || ',' || (turn + 5) ELSE '' END AS cited FROM a)"""


@query(f"""WITH {_ROUTED} SELECT leaf_id, status, md5(content) AS content, word_count, cited,
  status = 'generated' AND word_count > 0 AND CASE WHEN cited = '' THEN 0 ELSE len(string_split(cited, ',')) END < greatest(1, word_count // 200) AS warned FROM routed""")
def answer_routing(spark, sf):
    """D5 F11 F12 F13 F14"""
    return draft_rows(spark, sf).select(
        "leaf_id", "status", F.md5("content").alias("content"), "word_count",
        F.array_join(F.transform("cited_sources", lambda x: x.cast("string")), ",").alias("cited"),
        F.col("citation_warning").isNotNull().alias("warned"))


@query(f"""WITH {_ROUTED} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'generated') AS generated, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'error') AS error, CAST(sum(prompt_tokens) FILTER (WHERE status = 'generated') AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) FILTER (WHERE status = 'generated') AS BIGINT) AS completion_tokens, CAST(sum(word_count) FILTER (WHERE status = 'generated') AS BIGINT) AS words FROM routed""")
def draft_summary(spark, sf):
    """A10 S14"""
    return stats.draft_summary(draft_rows(spark, sf))


@query(f"""WITH {_ROUTED} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'generated') AS generated, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  0 AS reviewed, 0 AS approved, CAST(round(count(*) FILTER (WHERE status = 'generated') / count(*) * 100) AS INTEGER) AS percent FROM routed""")
def draft_status_overview(spark, sf):
    """A16"""
    return stats.status_overview(draft_rows(spark, sf))


def _edits(spark, sf):
    """An edit for every third turn; some are empty."""
    return table(spark, sf, "conversations").filter("turn % 3 = 0").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("leaf_id"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("edited "), "role")).otherwise("").alias("content"),
        F.when(F.col("conv_id") % 2 == 0, "reviewed").otherwise("").alias("status"), F.col("turn").cast("int").alias("word_count"))


@query(f"""WITH {_ROUTED} SELECT leaf_id, CASE WHEN turn % 6 = 0 AND conv_id % 2 = 0 THEN 'reviewed' ELSE status END AS status,
  md5(CASE WHEN turn % 6 = 0 THEN 'edited ' || role ELSE content END) AS content, CASE WHEN turn % 6 = 0 AND turn > 0 THEN turn ELSE word_count END AS word_count FROM routed""")
def edit_overlay(spark, sf):
    """J7"""
    return D.overlay_edits(draft_rows(spark, sf), _edits(spark, sf)).select("leaf_id", "status", F.md5("content").alias("content"), "word_count")


@query(f"""WITH {_ROUTED} SELECT leaf_id, CASE WHEN status = 'generated' AND turn % 2 = 0 THEN 'kept' ELSE 'todo' END AS state FROM routed""")
def resume_drafting(spark, sf):
    """J9"""
    rows = draft_rows(spark, sf)
    todo, kept = D.resume(rows.select("leaf_id"), rows.filter("turn % 2 = 0").select("leaf_id", "status"))
    return todo.select("leaf_id", F.lit("todo").alias("state")).unionByName(kept.select("leaf_id", F.lit("kept").alias("state")))


@query(f"""WITH {_ROUTED} SELECT leaf_id, CASE WHEN status = 'error' THEN 'generated' ELSE status END AS status FROM routed
UNION ALL SELECT 'new-' || leaf_id, 'generated' FROM routed WHERE status = 'error'""")
def partial_replace(spark, sf):
    """Failed drafts are replaced, new ones added"""
    rows = draft_rows(spark, sf).select("leaf_id", "status", "content")
    failed = rows.filter("status = 'error'").select("leaf_id", F.lit("generated").alias("status"))
    new = D.union_results(failed, failed.withColumn("leaf_id", F.concat(F.lit("new-"), "leaf_id")))
    return D.replace_by_key(rows, new).select("leaf_id", "status")


@query(rf"""WITH {_ROUTED}, kept AS (SELECT conv_id AS report_id, "row", full_path, leaf_title, string_split(full_path, ' > ')[1] AS part,
  regexp_replace(CASE WHEN turn % 6 = 0 THEN 'edited ' || role ELSE content END, '\[来源([\d,，、\s\-–]+)\]', '', 'g') AS content FROM routed WHERE status = 'generated'),
flagged AS (SELECT *, coalesce(lag(part) OVER (PARTITION BY report_id ORDER BY "row") <> part, true) AS new_part FROM kept)
SELECT report_id, md5('# report ' || report_id || chr(10) || chr(10) || '## yearly' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 目录' || chr(10) || chr(10) ||
  string_agg(CASE WHEN new_part THEN chr(10) || '### ' || part || chr(10) || chr(10) ELSE '' END || '- ' || leaf_title || chr(10), '' ORDER BY "row") || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg(CASE WHEN new_part THEN '# ' || part || chr(10) || chr(10) ELSE '' END || '## ' || leaf_title || chr(10) || chr(10) ||
    CASE WHEN content <> '' THEN content || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10), '' ORDER BY "row")) AS report FROM flagged GROUP BY report_id""")
def report_assembly(spark, sf):
    """S16 J7"""
    rows = draft_rows(spark, sf).withColumn("report_id", F.col("conv_id"))
    titles = table(spark, sf, "conversations").select(F.col("conv_id").alias("report_id")).distinct().select(
        "report_id", F.concat(F.lit("report "), F.col("report_id").cast("string")).alias("title"), F.lit("yearly").alias("subtitle"))
    return D.assemble_report(D.report_rows(rows, _edits(spark, sf)), titles).withColumn("report", F.md5("report"))


@query("""WITH s AS (SELECT conv_id AS chapter_id, string_agg('【来源' || turn || '】' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS a FROM conversations WHERE role = 'user' GROUP BY 1),
u AS (SELECT conv_id AS chapter_id, string_agg('【' || role || turn || '】' || chr(10) || substr(text, 1, 4000), chr(10) || chr(10) ORDER BY turn) AS b FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT chapter_id, md5(coalesce(a, '')) AS source_context, md5(coalesce(b, '')) AS uploaded_context FROM s FULL JOIN u USING (chapter_id)""")
def rewrite_contexts(spark, sf):
    """D8"""
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "chapter_id")
    sources = c.filter("role = 'user'").select("chapter_id", F.col("turn").alias("pos"), F.col("turn").alias("source_id"), "text")
    uploads = c.filter("role = 'assistant'").select("chapter_id", F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("file_name"), "text")
    rows = D.rewrite_context(sources, uploads)
    return rows.select("chapter_id", F.md5("source_context").alias("source_context"), F.md5("uploaded_context").alias("uploaded_context"))


@query(f"""WITH {_PASSAGES} SELECT leaf_id, count(*) AS chunks, string_agg(chunk_id, ',' ORDER BY rank) AS ids, round(max(score), 4) AS max_score FROM passages GROUP BY leaf_id""")
def nested_results(spark, sf):
    """S13"""
    leaves = table(spark, sf, "benchmark").select(F.col("item_id").alias("leaf_id"))
    rows = passages(spark, sf).withColumn("source", F.lit("bm25"))
    nested = sinks.nested_results(leaves, rows).filter(F.col("top_chunks").isNotNull())
    return nested.select("leaf_id", F.size("top_chunks").cast("long").alias("chunks"), F.array_join(
        F.transform("top_chunks", lambda c: c["chunk_id"]), ",").alias("ids"), F.col("stats.max_score").alias("max_score"))


# --- model reuse --------------------------------------------------------------------------------

@query("""WITH k AS (SELECT doc_id, substr(sha256(text), 1, 16) AS content_key, length(text) AS n FROM documents),
c AS (SELECT DISTINCT content_key FROM k WHERE doc_id % 3 = 0)
SELECT doc_id, content_key, 'n' || n AS summary, content_key IN (SELECT content_key FROM c) AS cached FROM k""")
def model_result_reuse(spark, sf):
    """Only new content is sent to the model, once per hash"""
    rows = table(spark, sf, "documents").select("doc_id", "text", content_key("text").alias("content_key"))
    cache = rows.filter("doc_id % 3 = 0").select(
        "content_key", F.concat(F.lit("n"), F.length("text").cast("string")).alias("summary")).distinct()
    hits, misses = M.reuse_results(rows, cache, "content_key", "summary")
    fresh = M.call_model(misses.select("content_key", "text"), ["text"], lambda items: [f"n{len(x)}" for (x,) in items], "summary")
    done = M.apply_results(rows.drop("text"), cache, fresh, "content_key", "summary")
    return done.join(hits.select("doc_id", F.lit(True).alias("cached")), "doc_id", "left").withColumn(
        "cached", F.coalesce("cached", F.lit(False)))


# --- history -------------------------------------------------------------------------------------

def edit_log(spark, sf):
    """Content and status events of chapters; a chapter is a conversation."""
    turn = F.col("turn")
    status = turn % 3 == 2
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project_id"), F.col("conv_id").alias("chapter_id"),
        turn.alias("event_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(turn AS INT))").alias("ts"),
        F.when(~status, F.col("text")).alias("content"), F.when(~status, F.length("text")).alias("word_count"),
        F.when(status, F.concat(F.lit("s"), turn.cast("string"))).alias("status"))


_LOG = """log AS (SELECT 'p' || (conv_id % 3) AS project_id, conv_id AS chapter_id, turn AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(turn) AS ts,
  CASE WHEN turn % 3 <> 2 THEN text END AS content, CASE WHEN turn % 3 <> 2 THEN length(text) END AS word_count, CASE WHEN turn % 3 = 2 THEN 's' || turn END AS status FROM conversations)"""


@query(f"""WITH {_LOG} SELECT project_id, chapter_id, md5(arg_max(content, event_id) FILTER (WHERE content IS NOT NULL)) AS content,
  arg_max(word_count, event_id) FILTER (WHERE content IS NOT NULL) AS word_count, coalesce(arg_max(status, event_id) FILTER (WHERE status IS NOT NULL), 'generated') AS status,
  min(ts) AS created_at, max(ts) AS updated_at FROM log GROUP BY ALL""")
def current_edits(spark, sf):
    """H1 H2"""
    return H.current_edits(edit_log(spark, sf)).withColumn("content", F.md5("content"))


@query(f"""WITH {_LOG} SELECT project_id, chapter_id, event_id AS version_id, word_count FROM log WHERE content IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY project_id, chapter_id ORDER BY event_id DESC) = 2""")
def second_newest_version(spark, sf):
    """W5"""
    return H.nth_version(edit_log(spark, sf), 2).select("project_id", "chapter_id", F.col("event_id").alias("version_id"), "word_count")


@query(f"""WITH {_LOG} SELECT project_id, chapter_id, md5(coalesce(max(content) FILTER (WHERE event_id = 0), arg_max(content, event_id) FILTER (WHERE content IS NOT NULL))) AS content FROM log GROUP BY ALL""")
def reverted_versions(spark, sf):
    """Every chapter goes back to its first version"""
    log = edit_log(spark, sf)
    wanted = log.filter("event_id = 0").select("project_id", "chapter_id", F.col("event_id").alias("version_id"))
    later = H.revert(log, wanted, F.lit(10_000).cast("long"), F.lit("2025-01-01").cast("timestamp_ntz"))
    return H.current_edits(later).select("project_id", "chapter_id", F.md5("content").alias("content"))


@query(f"""WITH {_LOG} SELECT 'edits' AS "table", count(*) FILTER (WHERE project_id = 'p1') AS deleted, count(*) FILTER (WHERE project_id <> 'p1') AS kept FROM log
UNION ALL SELECT 'versions', count(*) FILTER (WHERE project_id = 'p1'), count(*) FILTER (WHERE project_id <> 'p1') FROM log WHERE content IS NOT NULL""")
def project_deletion(spark, sf):
    """H3"""
    log = edit_log(spark, sf)
    kept, lost = H.delete_project({"edits": log, "versions": H.versions(log)}, "p1")
    counts = None
    for name, frame in kept.items():
        row = frame.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept")
        counts = row if counts is None else counts.unionByName(row)
    return lost.join(counts, "table")


@query("""SELECT conv_id, turn, turn % 4 = 2 AS blocked FROM conversations""")
def save_integrity(spark, sf):
    """edits with an empty source tag are blocked"""
    body = F.concat("text", F.when(F.col("turn") % 4 == 2, " [来源]").otherwise(" [来源1]"))
    good, bad = H.checked_edits(table(spark, sf, "conversations").select("conv_id", "turn", body.alias("content")))
    return good.select("conv_id", "turn", F.lit(False).alias("blocked")).unionByName(
        bad.select("conv_id", "turn", F.lit(True).alias("blocked")))


@query("""SELECT event_id AS run_id, ts AS created_at FROM events WHERE json_extract_string(props, '$.k') = '42' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def runs_of_project(spark, sf):
    """H4 L1"""
    runs = table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("props").alias("config"))
    return H.runs_of_project(runs, "42", path="$.k").select("run_id", "created_at")


@query("""SELECT user_id AS run_id, event_type AS step_name, arg_max(CASE WHEN value > 10 THEN 'completed' ELSE 'running' END, (ts, event_id)) AS status,
  arg_max(ts, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS started_at, arg_max(ts, (ts, event_id)) FILTER (WHERE value > 10) AS completed_at,
  arg_max('e' || event_id, (ts, event_id)) FILTER (WHERE event_id % 11 = 0) AS error FROM events GROUP BY ALL""")
def step_states(spark, sf):
    """H5"""
    key, ts = F.col("event_id"), F.col("ts")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step_name"), "event_id", "ts",
        F.when(F.col("value") > 10, "completed").otherwise("running").alias("status"), F.when(key % 3 == 0, ts).alias("started_at"),
        F.when(F.col("value") > 10, ts).alias("completed_at"), F.when(key % 11 == 0, F.concat(F.lit("e"), key.cast("string"))).alias("error"))
    return H.step_states(rows)


_UPDATES = """u AS (SELECT user_id AS run_id, event_type AS step_name, ts, event_id, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN value > 10 THEN 'completed' ELSE 'running' END END AS status,
  CASE WHEN event_id % 3 = 0 THEN ts END AS started_at, CASE WHEN value > 10 THEN ts END AS completed_at, CASE WHEN event_id % 11 = 0 THEN 'e' || event_id END AS error,
  CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS pid, CASE WHEN event_id % 6 = 0 THEN 'w' || event_id END AS warning, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS exit_code,
  CASE WHEN event_id % 9 = 0 THEN event_id % 4 END AS retry_count, CASE WHEN event_id % 2 = 1 THEN event_type END AS current_step,
  CASE event_id % 7 WHEN 0 THEN ['error', 'pid', 'current_step'] WHEN 1 THEN ['warning', 'exit_code'] ELSE [] END AS cleared FROM events)"""


def _newest(field, empties=False):
    """SQL of the newest value that was set, or emptied; wrapped, since the aggregate skips NULL."""
    said = f"{field} IS NOT NULL" + (f" OR list_contains(cleared, '{field}')" if empties else "")
    value = f"CASE WHEN list_contains(cleared, '{field}') THEN NULL ELSE {field} END" if empties else field
    return f"arg_max(struct_pack(v := {value}), (ts, event_id)) FILTER (WHERE {said}).v AS {field}".replace("arg_max(", "(arg_max(").replace(").v AS", ")).v AS")


def _updates(spark, sf):
    key, ts = F.col("event_id"), F.col("ts")
    every = lambda n, c: F.when(key % n == 0, c)
    named = lambda head: F.concat(F.lit(head), key.cast("string"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step_name"), "ts", "event_id",
        F.when(key % 4 != 0, F.when(F.col("value") > 10, "completed").otherwise("running")).alias("status"), every(3, ts).alias("started_at"),
        F.when(F.col("value") > 10, ts).alias("completed_at"), every(11, named("e")).alias("error"), every(2, key % 1000).alias("pid"), every(6, named("w")).alias("warning"),
        every(5, key % 3).alias("exit_code"), every(9, key % 4).alias("retry_count"), F.when(key % 2 == 1, F.col("event_type")).alias("current_step"),
        F.when(key % 7 == 0, F.array(F.lit("error"), F.lit("pid"), F.lit("current_step"))).when(key % 7 == 1, F.array(F.lit("warning"), F.lit("exit_code"))).alias("cleared"))


@query(f"""WITH {_UPDATES} SELECT run_id, step_name, {', '.join(map(_newest, ['status', 'started_at', 'completed_at']))}, {', '.join(_newest(c, True) for c in ['error', 'pid', 'warning', 'exit_code'])}
FROM u GROUP BY ALL""")
def step_records(spark, sf):
    """H5: all fields of a step; an event may set a field to NULL"""
    return H.step_states(_updates(spark, sf))


@query(f"""WITH {_UPDATES}, r AS (SELECT run_id, {', '.join(map(_newest, ['status', 'started_at', 'completed_at', 'retry_count']))}, {', '.join(_newest(c, True) for c in ['current_step', 'error'])}
FROM u GROUP BY ALL) SELECT * REPLACE (coalesce(retry_count, 0) AS retry_count) FROM r""")
def run_records(spark, sf):
    """H5: all fields of a run"""
    return H.run_records(_updates(spark, sf))


def _prompt_versions(spark, sf):
    key = F.col("event_id")
    return table(spark, sf, "events").select(
        F.lit("p").alias("project_id"), F.col("user_id").alias("chapter_id"), key.alias("version_id"), F.col("event_type").alias("version_name"),
        F.concat(F.lit("sys "), key.cast("string")).alias("system_prompt"), F.concat(F.lit("user "), key.cast("string")).alias("user_prompt"),
        F.when(key % 4 == 0, F.col("ts")).alias("activated_at"))


@query("""SELECT 'p' AS project_id, user_id AS chapter_id, arg_max(event_id, (ts, event_id)) AS version_id FROM events WHERE event_id % 4 = 0 GROUP BY ALL""")
def active_prompt_versions(spark, sf):
    """H6"""
    return H.active_prompts(_prompt_versions(spark, sf)).select("project_id", "chapter_id", "version_id")


@query("""WITH a AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS v FROM events WHERE event_id % 4 = 0 GROUP BY 1)
SELECT c.user_id AS chapter_id, coalesce('sys ' || v, 'default') AS system_prompt FROM (SELECT DISTINCT user_id FROM events) c LEFT JOIN a USING (user_id)""")
def new_prompt_versions(spark, sf):
    """H6: a new version starts from the active one"""
    rows = _prompt_versions(spark, sf)
    wanted = rows.select("project_id", "chapter_id").distinct()
    return H.new_prompt_version(wanted, H.active_prompts(rows), "default", "default").select("chapter_id", "system_prompt")


@query("""WITH a AS (SELECT arg_max(event_id, (ts, event_id)) AS v FROM events WHERE event_id % 4 = 0 GROUP BY user_id)
SELECT event_id AS version_id, event_id NOT IN (SELECT v FROM a) AS deletable FROM events""")
def deletable_prompt_versions(spark, sf):
    """H6: the active version stays"""
    rows = _prompt_versions(spark, sf)
    free, held = H.deletable_versions(rows, H.active_prompts(rows))
    return free.select("version_id", F.lit(True).alias("deletable")).unionByName(held.select("version_id", F.lit(False).alias("deletable")))


@query("""SELECT user_id AS chapter_id, event_id AS id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END AS accepted FROM events""")
def assistant_history(spark, sf):
    """H7"""
    e = table(spark, sf, "events")
    log = e.select(F.lit("p").alias("project_id"), F.col("user_id").alias("chapter_id"), F.col("event_id").alias("id"), F.col("event_type").alias("action"))
    first = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.lit(0).alias("accepted"), "ts")
    second = e.filter("event_id % 6 = 0").select(F.col("event_id").alias("id"), F.lit(1).alias("accepted"), F.expr("ts + INTERVAL 1 HOUR").alias("ts"))
    return H.assistant_log(log, first.unionByName(second)).select("chapter_id", "id", "accepted")


# --- browse -----------------------------------------------------------------------------------------

_HIT = "(lower(text) LIKE '%the%' OR lower(file_name) LIKE '%the%' OR lower(chunk_id) LIKE '%the%') AND folder_code = '3' AND NOT is_table"


@query(f"""WITH {t.CHUNKS} SELECT chunk_id, file_name, char_count FROM chunks WHERE {_HIT} ORDER BY chunk_id LIMIT 10 OFFSET 10""")
def chunk_page(spark, sf):
    """L2"""
    rows = B.chunk_page(t.chunks(spark, sf), 2, 10, code="3", is_table=False, search="The")
    return rows.select("chunk_id", "file_name", "char_count")


@query(f"""WITH {t.CHUNKS} SELECT count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS pages FROM chunks WHERE {_HIT}""")
def chunk_page_totals(spark, sf):
    """L2"""
    return B.page_totals(t.chunks(spark, sf), 10, code="3", is_table=False, search="The")


@query(f"""WITH {t.CHUNKS} SELECT DISTINCT folder_code FROM chunks""")
def chunk_code_facet(spark, sf):
    """L2"""
    return B.code_facet(t.chunks(spark, sf))


@query("""SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE lower(source) LIKE '%src3%' OR lower(text) LIKE '%theth and%')""")
def section_search(spark, sf):
    """L3"""
    rows = table(spark, sf, "documents").select("doc_id", "source", "text", F.lit("").alias("section_title"))
    hits = B.search_sections(rows, "Theth and", "source").select("doc_id", "source")
    more = B.search_sections(rows, "SRC3", "source").select("doc_id", "source")
    return hits.unionByName(more).distinct()


@query(f"""WITH {t.FRAMEWORK}, m AS (SELECT *, string_split(full_path, ' > ') AS parts, CASE "row" % 3 WHEN 0 THEN 'generated' WHEN 1 THEN 'skipped' ELSE 'error' END AS status FROM leaves),
hit AS (SELECT * FROM m WHERE status = 'generated' AND lower(parts[-1]) LIKE '%0%'),
nodes AS (SELECT leaf_id, "row", unnest(range(1, len(parts) + 1)) AS depth, parts FROM hit)
SELECT array_to_string(parts[1:depth], ' > ') AS path, min(depth) AS depth, min(parts[depth]) AS label, min("row") AS first_row,
  min(leaf_id) FILTER (WHERE depth = len(parts)) AS leaf_id, count(*) FILTER (WHERE depth = len(parts)) AS leaves_here FROM nodes GROUP BY 1""")
def chapter_tree(spark, sf):
    """L4"""
    status = F.when(F.col("row") % 3 == 0, "generated").when(F.col("row") % 3 == 1, "skipped").otherwise("error")
    return B.chapter_tree(t.leaf_rows(spark, sf).withColumn("status", status), "generated", "0").drop("status")


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def newest_orders(spark, sf):
    """L1"""
    return B.newest_first(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlabelled_documents(spark, sf):
    """X2"""
    return B.difference(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query(f"""WITH {t.CHUNKS} SELECT chunk_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS text FROM chunks""")
def result_list(spark, sf):
    """F36"""
    return B.result_list(t.chunks(spark, sf)).select("chunk_id", "text")


@query(f"""WITH {t.CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (WHERE is_table) AS tables, count(*) FILTER (WHERE is_table AND pos % 2 = 0) AS summarised FROM chunks""")
def table_chunk_counts(spark, sf):
    """A15"""
    rows = t.chunks(spark, sf).withColumn("table_summary", F.when(F.col("pos") % 2 == 0, "s"))
    return stats.table_counts(rows)


@query("""WITH f AS (SELECT c_mktsegment || '_' || (2000 + c_nationkey) AS project_id, count(*) AS files FROM customer GROUP BY 1),
d AS (SELECT c_mktsegment || '_' || (2000 + c_nationkey) AS project_id, count(*) AS chapters, count(*) FILTER (WHERE o_orderstatus = 'F') AS generated,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'P') AS error FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT project_id, string_split(project_id, '_')[1] AS company, string_split(project_id, '_')[2] AS year, CASE WHEN chapters > 0 THEN 'draft_generated' ELSE 'data_uploaded' END AS status,
  files, coalesce(chapters, 0) AS chapters, coalesce(generated, 0) AS generated, coalesce(skipped, 0) AS skipped, coalesce(error, 0) AS error FROM f LEFT JOIN d USING (project_id)""")
def project_rollup(spark, sf):
    """A19 F23"""
    project = F.concat("c_mktsegment", F.lit("_"), (F.col("c_nationkey") + 2000).cast("string"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", project.alias("project_id"), F.col("c_name").alias("file_path"))
    status = F.when(F.col("o_orderstatus") == "F", "generated").when(F.col("o_orderstatus") == "O", "skipped").otherwise("error")
    drafts = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("project_id", status.alias("status"))
    return stats.project_rollup(c, drafts)


@query("""SELECT s.scenario, s.stage, s.stale, CASE s.stage WHEN 'sizes' THEN (SELECT count(*) FROM documents) ELSE (SELECT count(DISTINCT source) FROM documents) END AS rows
FROM (VALUES ('first', 'sizes', true), ('first', 'totals', true), ('first', 'shares', true), ('again', 'sizes', false), ('again', 'totals', false), ('again', 'shares', false),
  ('settings', 'sizes', false), ('settings', 'totals', true), ('settings', 'shares', true), ('rows', 'sizes', true), ('rows', 'totals', true), ('rows', 'shares', true),
  ('last settings', 'sizes', false), ('last settings', 'totals', false), ('last settings', 'shares', true)) AS s(scenario, stage, stale)""")
def stage_refresh(spark, sf):
    """Three stages over all documents, saved, then asked again after a change of settings or of one row"""
    from ..sources import stages as G

    root, docs = work_folder(spark), table(spark, sf, "documents").select("doc_id", "source", "text")
    chain = lambda words=1, digits=4: [G.Stage("sizes", ["documents"], {}), G.Stage("totals", ["sizes"], {"least": words}), G.Stage("shares", ["totals"], {"digits": digits})]
    source = {"documents": G.table_fingerprint(docs)}
    other = {"documents": G.table_fingerprint(docs.withColumn("text", F.when(F.col("doc_id") == docs.agg(F.min("doc_id")).scalar(), F.lit("new")).otherwise(F.col("text"))))}
    found = [("first", G.stale_stages(spark, root, chain(), source))]
    G.save_stage(docs.select("doc_id", "source", F.length("text").alias("size")), root, "sizes")
    sizes = G.load_stage(spark, root, "sizes")
    G.save_stage(sizes.groupBy("source").agg(F.sum("size").alias("size")), root, "totals")
    totals = G.load_stage(spark, root, "totals")
    G.save_stage(totals.withColumn("share", F.round(F.col("size") / totals.agg(F.sum("size")).scalar(), 4)), root, "shares")
    for name, made in G.stage_fingerprints(chain(), source).items():
        G.mark_saved(spark, root, name, made)
    found += [("again", G.stale_stages(spark, root, chain(), source)), ("settings", G.stale_stages(spark, root, chain(words=2), source)),
              ("rows", G.stale_stages(spark, root, chain(), other)), ("last settings", G.stale_stages(spark, root, chain(digits=2), source))]
    counts = None
    for s in chain():
        one = G.load_stage(spark, root, s.name).agg(F.count("*").alias("rows")).select(F.lit(s.name).alias("stage"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    states = spark.createDataFrame([(n, s.name, s.name in stale) for n, stale in found for s in chain()], "scenario string, stage string, stale boolean")
    return states.join(counts, "stage")


@query("""WITH n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS now, count(DISTINCT CASE WHEN l_linenumber <> 5 THEN l_partkey END) AS old,
  count(DISTINCT CASE WHEN l_linenumber <> 5 THEN l_partkey END) AS shared FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS leaf_id, 'changed' AS change, o_orderpriority = '1-URGENT' AS has_edit
FROM n JOIN orders ON o_orderkey = l_orderkey WHERE old > 0 AND NOT (now = old AND shared = now)""")
def diff_with_edits(spark, sf):
    """Parts of an order as its chunks, without line 5 before; urgent orders were edited"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("leaf_id"), F.col("l_partkey").alias("chunk_id"), "l_linenumber")
    diff = H.retrieval_diff(rows, rows.filter("l_linenumber <> 5"))
    edits = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("leaf_id"))
    return H.changed_with_edits(diff, edits)


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS total, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'running') AS running,
  count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'pending') AS pending
FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' ELSE 'pending' END AS s FROM events) GROUP BY 1""")
def substep_states(spark, sf):
    """Sub-step states per run; an event is a chapter's last state"""
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "done").when(kind == "view", "running").otherwise("pending")
    return stats.substep_counts(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("key"), status.alias("status")))


# --- streams ---------------------------------------------------------------------------------------------

def _as_steps(events):
    """Step events: a user is a run, an event type a stage."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "failed").when(
        (F.col("event_type") == "purchase") & (k > 50), "completed").otherwise("running")
    return events.select(F.col("user_id").cast("string").alias("run_id"), "event_id", "ts", F.col("event_type").alias("stage"),
                         status.alias("status"), k.alias("current"), F.lit(100).alias("total"))


_STEPS = """steps AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts, event_type AS stage, CAST(json_extract_string(props, '$.k') AS INTEGER) AS current,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'completed' ELSE 'running' END AS status FROM events),
last AS (SELECT run_id, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status, arg_max(current, (ts, event_id)) AS current, max(ts) AS ts FROM steps GROUP BY 1),
first_seen AS (SELECT run_id, stage, min((ts, event_id)) AS entered FROM steps GROUP BY ALL),
last_seen AS (SELECT run_id, stage, max((ts, event_id)) AS seen FROM steps GROUP BY ALL)"""


@query(f"""WITH {_STEPS} SELECT l.run_id, l.stage, status, CASE WHEN status = 'completed' THEN 100.0 ELSE round(current / 100 * 100, 1) END AS percent,
  coalesce((SELECT string_agg(f.stage, ',' ORDER BY entered) FROM first_seen f WHERE f.run_id = l.run_id AND (f.stage <> l.stage OR l.status = 'completed'
    OR EXISTS (SELECT 1 FROM last_seen o WHERE o.run_id = l.run_id AND o.stage <> f.stage AND o.seen > f.entered))), '') AS stages_completed, ts FROM last l""")
def run_progress(spark, sf):
    """T2, batch fold"""
    return P.progress(_as_steps(table(spark, sf, "events"))).withColumn("stages_completed", F.array_join("stages_completed", ","))


@query(f"""WITH {_STEPS} SELECT run_id, CASE WHEN status = 'running' AND ts < (SELECT max(ts) FROM steps) - INTERVAL 2 HOUR THEN 'failed' ELSE status END AS status FROM last""")
def silent_runs(spark, sf):
    """Runs that fell silent"""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts")).scalar()
    return P.close_silent(P.progress(_as_steps(events)), now, "2 hours").select("run_id", "status")


def _event_rows(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark, sf):
    return _as_steps(_event_rows(spark, sf))


@query(f"""WITH {_STEPS} SELECT run_id, stage, status, CASE WHEN status = 'completed' THEN 100.0 ELSE round(current / 100 * 100, 1) END AS percent, ts FROM last""")
def streamed_latest_state(spark, sf):
    """T2 as a stream: built-in aggregation"""
    folder = work_folder(spark)
    P.states_to_table(P.latest_stream(_event_stream(spark, sf)), f"{folder}/out", f"{folder}/log").awaitTermination()
    return P.latest_states(spark.read.parquet(f"{folder}/out")).select(
        "run_id", "stage", "status", "percent", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {_STEPS} SELECT run_id, stage, CASE WHEN status = 'running' AND ts + INTERVAL 10 MINUTE < (SELECT max(ts) FROM steps) - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'completed' THEN 100.0 ELSE round(current / 100 * 100, 1) END AS percent FROM last""")
def streamed_progress_with_timeouts(spark, sf):
    """T2 as a stream: state with time-outs"""
    folder = work_folder(spark)
    P.states_to_table(P.progress_stream(_event_stream(spark, sf)), f"{folder}/out", f"{folder}/log").awaitTermination()
    return P.latest_states(spark.read.parquet(f"{folder}/out")).select("run_id", "stage", "status", "percent")


_RUNS = f"""{_STEPS}, said AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts, event_type AS stage, 'c' || event_id % 7 AS substep,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'running' END AS substep_status,
  CASE WHEN event_id % 11 = 0 THEN list_transform(range(event_id % 4), lambda i: 'n' || CAST(event_id + i AS VARCHAR)) END AS failed_ids FROM events),
steps_said AS (SELECT s.*, 'e' || event_id AS error FROM steps s WHERE event_id % 3 <> 0),
last_step AS (SELECT run_id, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status, arg_max(current, (ts, event_id)) AS current, arg_max(error, (ts, event_id)) AS error
  FROM steps_said GROUP BY 1),
span AS (SELECT run_id, stage, min((ts, event_id)) AS entered, max((ts, event_id)) AS seen FROM steps_said GROUP BY ALL),
part AS (SELECT run_id, substep, arg_max(coalesce(substep_status, 'pending'), (ts, event_id)) AS status FROM said GROUP BY ALL),
parts AS (SELECT run_id, string_agg(substep || ':' || status, ',' ORDER BY substep) AS substeps FROM part GROUP BY 1),
failed AS (SELECT run_id, arg_max(failed_ids, (ts, event_id)) AS ids FROM said WHERE failed_ids IS NOT NULL GROUP BY 1),
heard AS (SELECT run_id, max(ts) AS ts FROM said GROUP BY 1),
state AS (SELECT h.run_id, l.stage, coalesce(l.status, 'running') AS status, CASE WHEN l.status = 'completed' THEN 100.0 ELSE coalesce(round(current / 100 * 100, 1), 0) END AS percent,
  coalesce((SELECT string_agg(f.stage, ',' ORDER BY entered) FROM span f WHERE f.run_id = h.run_id AND (f.stage <> l.stage OR l.status = 'completed'
    OR EXISTS (SELECT 1 FROM span o WHERE o.run_id = h.run_id AND o.stage <> f.stage AND o.seen > f.entered))), '') AS stages_completed,
  substeps, CAST(coalesce(len(ids), 0) AS INTEGER) AS partial_failed, coalesce(array_to_string(ids, ','), '') AS partial_failed_ids, CASE WHEN l.status = 'failed' THEN error END AS error, h.ts
  FROM heard h LEFT JOIN last_step l USING (run_id) LEFT JOIN parts USING (run_id) LEFT JOIN failed USING (run_id))"""


def _whole_events(events):
    """Step events that also name sub-steps and failed ids; every third says nothing of its stage."""
    key = F.col("event_id")
    named = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    kind = F.col("stage")
    silent = key % 3 == 0
    ids = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: named("n", key + i))
    return _as_steps(events).select(
        "run_id", "event_id", "ts", F.when(~silent, kind).alias("stage"), F.when(~silent, F.col("status")).alias("status"), "current", "total",
        named("e", key).alias("error"), named("c", key % 7).alias("substep"),
        F.when(key % 5 == 0, None).when(kind == "error", "error").when(kind == "purchase", "done").otherwise("running").alias("substep_status"),
        F.when(key % 11 == 0, F.slice(ids, F.lit(1), (key % 4).cast("int"))).alias("failed_ids"))


def _state_columns(states):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("substeps")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return states.select("run_id", "stage", "status", "percent", F.array_join("stages_completed", ",").alias("stages_completed"), shown.alias("substeps"),
                         "partial_failed", F.array_join("partial_failed_ids", ",").alias("partial_failed_ids"), "error")


@query(f"""WITH {_RUNS} SELECT * EXCLUDE (ts, status, error, late), CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN '{fixed.LOST_RUN}' ELSE error END AS error
FROM (SELECT *, status = 'running' AND ts < (SELECT max(ts) FROM said) - INTERVAL 2 HOUR AS late FROM state) AS s""")
def run_states(spark, sf):
    """T2 A16, batch: stage, sub-steps, partial failures and error of every run; silent runs fail"""
    events = table(spark, sf, "events")
    return _state_columns(R.close_silent(R.run_states(_whole_events(events)), events.agg(F.max("ts")).scalar(), "2 hours"))


@query(f"""WITH {_RUNS} SELECT * EXCLUDE (ts, status, error, late), CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN '{fixed.LOST_RUN}' ELSE error END AS error
FROM (SELECT *, status = 'running' AND ts + INTERVAL 10 MINUTE < (SELECT max(ts) FROM said) - INTERVAL 10 MINUTE AS late FROM state) AS s""")
def streamed_run_states(spark, sf):
    """T2 A16 as a stream: map states of stages and sub-steps, event-time timers"""
    folder = work_folder(spark)
    P.states_to_table(R.state_stream(_whole_events(_event_rows(spark, sf))), f"{folder}/out", f"{folder}/log").awaitTermination()
    return _state_columns(P.latest_states(spark.read.parquet(f"{folder}/out")))


@query(f"""WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END AS text FROM documents),
s AS (SELECT doc_id, text, {split_sql('text', 400, 100)} AS parts FROM changed)
SELECT doc_id, substr(sha256(text), 1, 16) AS content_key, generate_subscripts(parts, 1) - 1 AS pos, md5(unnest(parts)) AS chunk FROM s""")
def incremental_ingest(spark, sf):
    """All documents, then a version in which every tenth has changed, cut into chunks; copies share theirs"""
    folder = work_folder(spark)
    schema = table(spark, sf, "documents").schema
    cut = lambda rows: rows.select("content_key", "text").mapInArrow(split_batches(400, 100), "key string, pos int, chunk string") \
        .withColumnRenamed("key", "content_key")
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    for log, text in (("first", F.col("text")), ("second", changed)):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/document[s].parquet").withColumn("text", text)
        I.ingest(stream, f"{folder}/out", f"{folder}/{log}", cut, path="doc_id").awaitTermination()
    return I.current(spark, f"{folder}/out", "doc_id").select("doc_id", "content_key", "pos", F.md5("chunk").alias("chunk"))


_VERSIONS = """versions AS (SELECT doc_id, 1 AS version, text FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 10 = 0 THEN text || ' v2' ELSE text END FROM documents)"""


@query(f"""WITH {_VERSIONS}, k AS (SELECT doc_id, version, text, substr(sha256(text), 1, 16) AS content_key FROM versions),
live AS (SELECT DISTINCT content_key, text, true AS live FROM k WHERE version = 2),
gone AS (SELECT DISTINCT content_key, text, false AS live FROM k WHERE content_key NOT IN (SELECT content_key FROM live)),
d AS (SELECT * FROM live UNION ALL SELECT * FROM gone), c AS (SELECT content_key, live, text, {split_sql('text', 400, 100)} AS parts FROM d),
x AS (SELECT content_key, live, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS chunk FROM c)
SELECT content_key, live, 'sections' AS output, 0 AS pos, md5(text) AS value FROM d WHERE {{}}
UNION ALL SELECT content_key, live, 'chunks', CAST(pos AS INTEGER), md5(chunk) FROM x
UNION ALL SELECT content_key, live, 'vectors', CAST(pos AS INTEGER), CASE WHEN {{}} THEN array_to_string(list_transform(['a', 'e', 'i', 'n', 'r'],
  lambda l: CAST(length(chunk) - length(replace(chunk, l, '')) AS VARCHAR)), ',') END FROM x""".replace("{}", "regexp_matches(text, '[^\\s\\p{Z}]')", 1).replace("{}", "regexp_matches(chunk, '[^\\s\\p{Z}]')"))
def incremental_outputs(spark, sf):
    """Two versions of all documents as sections, chunks and vectors; rows of replaced content are retired"""
    folder = work_folder(spark)
    schema = table(spark, sf, "documents").schema
    letters = lambda texts: [[float(t.count(x)) for x in "aeinr"] for t in texts]

    def process(rows):
        chunks = cut_lineage(rows.select("content_key", "text").mapInArrow(split_batches(400, 100), "key string, pos int, chunk string").withColumnRenamed("key", "content_key"))
        vectors = V.embed_with(chunks, letters, text="chunk", dim=5, batch=50).select("content_key", "pos", "embedding")
        sections = rows.filter(has_text("text")).select("content_key", F.lit(0).alias("pos"), "text")
        return {"sections": sections, "chunks": chunks, "vectors": vectors}

    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    for log, text in (("first", F.col("text")), ("second", changed)):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/document[s].parquet").withColumn("text", text)
        I.ingest(stream, f"{folder}/out", f"{folder}/{log}", process, path="doc_id").awaitTermination()
    now = I.newest_keys(spark, f"{folder}/out", "doc_id").select("content_key").distinct().withColumn("live", F.lit(True))
    shown = {"sections": F.md5("text"), "chunks": F.md5("chunk"), "vectors": F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")}
    out = None
    for name, value in shown.items():
        rows = I.output(spark, f"{folder}/out", name).join(now, "content_key", "left").select(
            "content_key", F.coalesce("live", F.lit(False)).alias("live"), F.lit(name).alias("output"), "pos", value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
