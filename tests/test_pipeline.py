import datetime as dt

import pytest
from pyspark.sql import functions as F

from proofloom.operators import alignment as A
from proofloom.operators import browse as B
from proofloom.operators import drafts as D
from proofloom.operators import history as H
from proofloom.operators import model as M
from proofloom.operators import stats
from proofloom.sources import checklist, files, grid, sinks, stages

TOP = "array<struct<code:string,score:double>>"


@pytest.mark.parametrize("folder, top, want", [
    ("GA1", [], ("❓", "GA1")), (None, [], ("❓", None)),
    ("GA1", [("GB1", 0.39)], ("➖", "GA1")), (None, [("GB1", 0.39)], ("➖", "GB1")),
    (None, [("GB1", 0.9)], ("🔍", "GB1")), ("GA1", [("GA1", 0.9)], ("✅", "GA1")),
    ("GA1", [("GA1", 0.9), ("GB1", 0.75)], ("✅", "GA1")), ("GA1", [("GA1", 0.9), ("GB1", 0.76)], ("➕", "GA1")),
    ("GA1", [("X1", 0.6), ("X2", 0.6), ("GA1", 0.5)], ("✅", "GA1")),
    ("GA1", [("X1", 0.6), ("X2", 0.6), ("X3", 0.6), ("GA1", 0.5)], ("⚠️", "X1")), ("GA1", [("GB1", 0.8)], ("⚠️", "GB1"))])
def test_status(rows, folder, top, want):
    got = rows([(folder, top)], f"f string, t {TOP}", A.classify("f", "t", topn=3))[0][0]
    assert (got["consistency"], got["suggested_code"]) == want


def test_review_table_and_files(spark):
    marks = ["✅", "❓", "⚠️", "🔍", "➕", "⚠️"]
    data = [(f"c{i}", f"f{i % 3}.pdf", f"/d/f{i % 3}.pdf", None if m == "🔍" else "GA1", "1", "a\nb" + "\x01" + "x" * 300, [("GA1", 0.5)], m, "GA1", i)
            for i, m in enumerate(marks)]
    aligned = spark.createDataFrame(data, "chunk_id string, file_name string, file_path string, folder_code string, page_or_sheet string, text string, "
                                    f"semantic_topk {TOP}, consistency string, suggested_code string, pos int")
    ind = spark.createDataFrame([("GA1", "T", "I")], "code string, topic string, indicator string")
    got = A.review_table(aligned, ind).collect()
    assert len(got[0]) == 13 and [r.consistency for r in got] == ["⚠️", "⚠️", "🔍", "➕", "✅", "❓"]
    assert [r.chunk_id for r in got][:2] == ["c2", "c5"] and got[0].text_preview == "a b" + "x" * 196
    assert got[2].folder_topic == "" and got[0].semantic_top5 == "GA1:0.50"
    known = spark.createDataFrame([("/d/f0.pdf", "f0.pdf", None), ("/d/new.pdf", "new.pdf", "GB2")], "file_path string, file_name string, folder_code string")
    lost = A.uncovered_files(known, aligned.filter("consistency <> '✅'").withColumn("consistency", F.lit("➖"))).orderBy("file_path").collect()
    assert [(r.file_name, r.chunks, r.reason) for r in lost] == [("f0.pdf", 1, "所有chunk均低相关（top1 < 0.40）"), ("new.pdf", 0, "提取失败或无有效内容")]
    counts = {r.status: r.chunks for r in A.status_counts(aligned).collect()}
    assert counts == {"✅": 1, "➕": 1, "⚠️": 2, "🔍": 1, "➖": 0, "❓": 1}


def test_model_calls_keep_rows_and_record_failures(spark):
    def fn(items):
        if any(x == 3 for (x,) in items):
            raise RuntimeError("down")
        return [f"v{x}" for (x,) in items]
    df = spark.createDataFrame([(i,) for i in range(7)], "x long").coalesce(1)
    got = M.call_model(df, ["x"], fn, "y", batch=2, tries=2, wait=0.0).orderBy("x").collect()
    assert [r.y for r in got] == ["v0", "v1", None, None, "v4", "v5", "v6"]
    assert [r.y_error is None for r in got] == [True, True, False, False, True, True, True]


def test_checklist(spark):
    table = {0: ["清单"], 1: ["类别", "议题", "指标", "序号", "编码"], 2: ["治理（GA）", "T1", "I1", "1", "GA1"], 3: [None, None, "I2", "2", None],
             4: [None, "T3", None, "EB10", "nan"], 5: ["x", None, "I4", "y", None], 6: ["治理（GA）", "T9", "I9", "1", None]}
    cells = [("s", r, c, v) for r, vs in table.items() for c, v in enumerate(vs)]
    cells += [("o", 0, 0, "序号"), ("o", 0, 1, "资料列表"), ("o", 1, 0, "A7"), ("o", 1, 1, "概况")]
    rows = checklist.checklist_rows(spark.createDataFrame(cells, "sheet string, row int, col int, value string"))
    got = {r.code: (r.topic, r.indicator) for r in checklist.indicator_map(rows).collect()}
    assert got == {"GA1": ("T1", "I1"), "GA2": ("T1", "I2"), "EB10": ("T3", "I2"), "A7": (None, None)}
    s = checklist.load_stats(rows).first()
    assert (s.rows_scanned, s.rows_used, s.mapping_size, s.duplicate_codes, s.duplicates_sample) == (6, 5, 4, 1, ["GA1"])


def test_fill_down_crosses_blocks(spark):
    rows = spark.createDataFrame([("s", i, "v" if i == 1 else None) for i in range(25)], "sheet string, row int, v string")
    got = grid.fill_down(rows, ["sheet"], "row", ["v"], block=4).orderBy("row").collect()
    assert [r.v for r in got] == [None] + ["v"] * 24


def test_files(spark, tmp_path):
    for name in ["G-公司治理/GA1/a.pdf", "x/.DS_Store", "x/~$t.docx", "x/Thumbs.db", "x/EB10 材料/b.DOCX", "x/c.zip", "📋说明.txt", "定性ESG资料清单.xlsx"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    known = spark.createDataFrame([("GA1",)], "code string")
    found = files.list_files(spark, str(tmp_path))
    got = {r.relative_path: (r.folder_code, r.extension, r.reader) for r in files.catalog(found, known).collect()}
    assert got == {"G-公司治理/GA1/a.pdf": ("GA1", ".pdf", "pdf"), "x/EB10 材料/b.DOCX": ("EB10", ".docx", "docx"), "x/c.zip": (None, ".zip", None)}


def test_path_code_prefers_known_then_deepest(spark):
    paths = spark.createDataFrame([("GA1/GB2/f.pdf",), ("GB2/GA1/f GC3.pdf",), ("x/y.pdf",)], "relative_path string")
    got = {r.relative_path: r.best and r.best["code"] for r in files.resolve_codes(paths, spark.createDataFrame([("GA1",)], "code string")).collect()}
    assert got == {"GA1/GB2/f.pdf": "GA1", "GB2/GA1/f GC3.pdf": "GA1", "x/y.pdf": None}


def test_stages_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    stages.save_stage(df, str(tmp_path), "chunks", "p1", "2024-01-01")
    stages.save_stage(df.withColumn("t", F.lit("b")), str(tmp_path), "chunks", "p1", "2024-02-01")
    stages.save_stage(df.withColumn("t", F.lit("c")), str(tmp_path), "chunks", "p2", "2024-01-15")
    assert {r.t for r in stages.load_stage(spark, str(tmp_path), "chunks").collect()} == {"a", "b", "c"}
    assert [r.t for r in stages.newest(stages.load_stage(spark, str(tmp_path), "chunks", "p1")).collect()] == ["b"]
    results = spark.createDataFrame([("r1", 2, "c2", 0.5, "f", "bm25"), ("r1", 1, "c1", 0.7, "f", "multi")],
                                    "leaf_id string, rank int, chunk_id string, score double, file_name string, source string")
    leaves = spark.createDataFrame([("r1",), ("r2",)], "leaf_id string")
    sinks.save_results(leaves, results, str(tmp_path / "r"))
    back = {r.leaf_id: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert [c["chunk_id"] for c in back["r1"].top_chunks] == ["c1", "c2"] and back["r2"].stats["chunk_count"] == 0
    drafts = spark.createDataFrame([("r1", "generated", 5, 1, 2)], "leaf_id string, status string, word_count int, prompt_tokens int, completion_tokens int")
    sinks.save_drafts(drafts, str(tmp_path / "d"), {"model": "m"})
    assert spark.read.json(str(tmp_path / "d/summary")).first()["config_model"] == "m"
    sinks.save_review(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["t"] == "a"
    sinks.save_reports(spark.createDataFrame([("x", "# T\n")], "report_id string, report string"), str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).count() >= 1


def test_history(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("p", "c", i, t0 + dt.timedelta(hours=i), c, w, s) for i, (c, w, s) in enumerate(
        [("v1", 2, None), (None, None, "approved"), ("v2", 3, None)])] + [("p", "only", 9, t0, None, None, "reviewed")],
        "project_id string, chapter_id string, event_id long, ts timestamp, content string, word_count int, status string")
    got = {r.chapter_id: (r.content, r.word_count, r.status) for r in H.current_edits(log).collect()}
    assert got == {"c": ("v2", 3, "approved"), "only": ("", 0, "reviewed")}
    wanted = spark.createDataFrame([("p", "c", 0), ("q", "c", 2)], "project_id string, chapter_id string, version_id long")
    later = H.revert(log, wanted, F.lit(50).cast("long"), F.lit("2025-01-01").cast("timestamp"))
    assert {r.chapter_id: r.content for r in H.current_edits(later).collect()}["c"] == "v1"


def test_retrieval_diff(spark):
    schema = "leaf_id string, chunk_id string"
    now = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("new", "1")], schema)
    old = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "2"), ("gone", "1")], schema)
    assert {r.leaf_id: r.change for r in H.retrieval_diff(now, old).collect()} == {"a": "unchanged", "b": "changed", "new": "added"}
    empty = spark.createDataFrame([], schema)
    assert {r.change for r in H.retrieval_diff(now, empty).collect()} == {"added"}


def test_drafts(spark):
    prepared = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "leaf_id string")
    answers = spark.createDataFrame([("r1", None, "Timeout"), ("r2", "[NO_CONTENT]\nwhy", None), ("r3", "文" * 450 + "[来源2,1]", None), ("r4", None, None)],
                                    "leaf_id string, content string, error string")
    got = {r.leaf_id: r for r in D.route_answers(prepared, answers).collect()}
    assert [got[k].status for k in ("r1", "r2", "r3", "r4")] == ["error", "skipped", "generated", "generated"]
    lost = D.route_answers(prepared, answers.filter("leaf_id <> 'r2'")).filter("leaf_id = 'r2'").first()
    assert lost.status == "no_answer" and lost.content is None and lost.citation_warning is None
    assert got["r2"].no_content_analysis == "why" and got["r3"].cited_sources == [1, 2] and got["r3"].citation_warning is None
    results = spark.createDataFrame([("r1", i, 0.5, f"c{i}", "f" if i != 2 else "", "1", f"t{i}", None) for i in (1, 2, 10)],
                                    "leaf_id string, rank int, score double, chunk_id string, file_name string, page_or_sheet string, text string, parent_text string")
    ctx = D.contexts(results).first()
    assert ctx.context_text == "【来源1】f | 第1页 | 相关度: 0.50\nt1\n\n【来源2】未知文件 | 第1页 | 相关度: 0.50\nt2\n\n【来源10】f | 第1页 | 相关度: 0.50\nt10\n"
    assert ctx.available_sources == "[来源1], [来源2], [来源10]" and ctx.sources_mapping["10"]["chunk_id"] == "c10"


def test_chapter_tree(spark):
    rows = spark.createDataFrame([("r1", 1, "A > B > x", "generated"), ("r2", 2, "A > C", "skipped"), ("r3", 3, "D > y", "generated")],
                                 "leaf_id string, row int, full_path string, status string")
    got = {r.path for r in B.chapter_tree(rows, "generated", "X").collect()}
    assert got == {"A", "A > B", "A > B > x"}


def test_score_brackets(spark):
    rows = spark.createDataFrame([("a", 0.6), ("b", 0.5999), ("c", 0.1)], "leaf_id string, avg_score double")
    got = [(r.bracket, r.leaves) for r in stats.score_brackets(rows).orderBy("place").collect()]
    assert got == [("≥ 0.60", 1), ("0.50-0.59", 1), ("0.40-0.49", 0), ("0.30-0.39", 0), ("< 0.30", 1)]


def test_fields_of_a_run_keep_their_newest_value_and_can_be_emptied(spark):
    from proofloom.operators import history as H

    log = [("a", 1, 1, "running", "t1", None, None, "s1", "bad", None), ("a", 2, 2, None, None, None, 2, None, None, ["error", "status"]), ("a", 3, 3, "completed", None, "t3", None, None, None, []),
           ("a", 3, 3, "completed", None, "t3", None, None, None, []), ("b", 1, 1, None, None, None, None, "s1", "old", ["current_step"]), ("b", 2, 1, None, None, None, None, None, "new", None),
           (None, 1, 1, "running", None, None, None, None, None, None)]
    df = spark.createDataFrame(log, "run_id string, ts int, event_id int, status string, started_at string, completed_at string, retry_count int, current_step string, error string, cleared array<string>")
    got = {r.run_id: (r.status, r.started_at, r.completed_at, r.retry_count, r.current_step, r.error) for r in H.run_records(df).collect()}
    assert got == {"a": ("completed", "t1", "t3", 2, "s1", None), "b": (None, None, None, 0, None, "new"), None: ("running", None, None, 0, None, None)}
    assert H.run_records(df.limit(0)).count() == 0
    steps = H.step_states(df.withColumns({"step_name": F.lit("s"), "pid": F.lit(7)}).drop("cleared"))
    assert steps.columns == ["run_id", "step_name", "status", "started_at", "completed_at", "error", "pid"]
    assert {r.run_id: r.error for r in steps.collect()} == {"a": "bad", "b": "new", None: None}


def test_cells_of_one_sheet_spread_over_many_tasks(spark):
    from proofloom.sources import grid

    cells = [("s", 0, c, f"h{c}") for c in range(2)] + [("s", r, c, f"v{r}" if r % 3 else None) for r in range(1, 400) for c in range(2)]
    df = spark.createDataFrame(cells, "sheet string, row int, col int, value string")
    header = df.filter("row = 0").groupBy("sheet").agg(F.min("row").alias("header"))
    columns = grid.find_columns(df, header, {"a_col": ["h0"], "b_col": ["h1"]})
    rows = grid.pick_columns(df, columns, ["a", "b"])
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 8 and rows.count() == 399
    filled = grid.filled_rows(df, header, {"a": ["h0"], "b": ["h1"]}, ["a"]).orderBy("row").collect()
    assert [r.a for r in filled[:7]] == ["v1", "v2", "v2", "v4", "v5", "v5", "v7"] and filled[2].b is None


def test_leaves_of_one_group_spread_over_many_tasks(spark):
    from proofloom.operators import drafts

    leaves = spark.range(4000).selectExpr("'a' l1", "id row")
    got = drafts.batches(leaves, 10)
    assert got.count() == 4000 and got.agg(F.max("batch")).first()[0] == 400
    assert "BroadcastHashJoin [l1#" in got._jdf.queryExecution().executedPlan().toString()
