import pytest
from pyspark.sql import functions as F

from proofloom.functions import citations, codes, template, text
from proofloom.functions.register import register, register_chunker


def test_meaningful_chars(rows):
    cases = [("Hello 你好 123", 10), ("", 0), ("", 0), ("。，！？……", 0), ("㐀", 1), ("中文abc123", 8)]
    assert [r[0] for r in rows([(t,) for t, _ in cases], "t string", text.meaningful_chars("t"))] == [n for _, n in cases]


def test_codes(rows):
    cases = [("XGA1", None, ""), ("A1234", None, ""), ("EB10-GA7", "EB10", "EB10,GA7"), ("ga1 报告", "GA1", "GA1"), (None, None, "")]
    got = rows([(t,) for t, _, _ in cases], "t string", codes.first_code("t"), F.array_join(codes.all_codes("t"), ","))
    assert got == [(a, b) for _, a, b in cases]


def test_prefix_serial_and_row_code(rows):
    got = rows([("应对气候变化（EA）", "第12项"), ("规范治理(GB)", "nan"), ("EA", "7"), ("议题", None)], "c string, s string",
               codes.code_prefix("c"), codes.serial_number("s"), codes.row_code(F.lit(None).cast("string"), "s", "c"))
    assert got == [("EA", 12, "EA12"), ("GB", None, None), ("EA", 7, "EA7"), (None, None, None)]


def test_file_name_codes_are_spelled_out(rows):
    assert rows([("GA1、2,3 材料 EB10.docx",)], "f string", codes.codes_in_file_name("f")) == [(["GA1", "GA2", "GA3", "EB10"],)]


def test_heading_level(rows):
    cases = [("1 范围", 1), ("1.1 总则", 2), ("1.1.1 细则", 3), ("一、公司概况", 1), ("第一章 总则", 1), ("目录", 0), ("1.目的", 1), ("6.2.2.1 熟悉", 4)]
    assert [r[0] for r in rows([(t,) for t, _ in cases], "t string", text.heading_level("t"))] == [n for _, n in cases]


def test_title_level(rows):
    assert rows([("doc_title", "x"), ("paragraph_title", "目录"), ("paragraph_title", "1.1.1 a")], "l string, t string",
                text.title_level("l", "t")) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("tag, want", [
    ("[来源1]", [1]), ("[来源1,3]", [1, 3]), ("[来源1、2]", [1, 2]), ("[来源1-3]", [1, 2, 3]), ("[来源1,3-5]", [1, 3, 4, 5]),
    ("[来源5-3]", []), ("[来源]", []), ("[来源10][来源9，10]", [9, 10])])
def test_cited_sources(rows, tag, want):
    assert rows([(f"x{tag}y",)], "c string", citations.cited_sources("c")) == [(want,)]


def test_no_content_and_density(rows):
    got = rows([("[NO_CONTENT]\n\n缺资料",), (" [NO_CONTENT] ",), ("正文",)], "c string",
               citations.is_no_content("c"), citations.no_content_analysis("c"))
    assert got == [(True, "缺资料"), (True, None), (False, None)]
    got = rows([([1], 450), ([1, 2], 450), ([], 0)], "c array<int>, w int", citations.citation_warning("c", "w").isNotNull())
    assert got == [(True,), (False,), (False,)]


def test_clean_for_report(rows):
    source = "a[来源1]b[待补充：x]c[来源]"
    assert rows([(source,)], "c string", citations.clean_for_report("c"), citations.clean_for_report("c", False),
                citations.pending_blocks("c"), citations.empty_source_tags("c")) == [
        ("ab**[待补充：x]**c[来源]", "ab[待补充]c[来源]", ["[待补充：x]"], 1)]


def test_context_text(rows):
    data = [("p", "t"), ("p" * 30, "t"), ("p" * 30, "t" * 20), ("", "t" * 20), ("p" * 30, "")]
    got = [r[0] for r in rows(data, "p string, t string", text.context_text("p", "t", 10))]
    assert got == ["p", "t", "t" * 10 + "...", "t" * 10 + "...", "p" * 10 + "..."]


def test_top_list_and_score(rows):
    got = rows([([("GA1", 0.526), ("EB10", 0.4)],), ([],)], "t array<struct<code:string,score:double>>",
               text.format_top("t"), text.top_score(text.format_top("t")))
    assert got == [("GA1:0.53, EB10:0.40", 0.53), ("", 0.0)]


def test_image_answers(rows):
    cases = [("类型：照片\n描述：一栋楼", ("照片", "一栋楼")), ("类型: 照片\n描述: 楼", ("照片", "楼")), ("自由文本", ("其他", "自由文本")),
             ("类型：数据图表类\n描述：图", ("数据图表", "图")), ("类型：证书", ("证书", "类型：证书"))]
    got = rows([(c,) for c, _ in cases], "r string", text.image_answer("r"))
    assert [tuple(r[0]) for r in got] == [w for _, w in cases]


def test_image_filter(rows):
    data = [(6000, 200, 200), (6000, 99, 200), (6000, 200, 99), (5119, 200, 200), (5120, 100, 100)]
    assert [r[0] for r in rows(data, "b int, w int, h int", text.image_passes("b", "w", "h"))] == [True, False, False, False, True]


def test_query_text(rows):
    data = [("GA1", "议题", "指标", "需求" * 300, None), ("GA2", "", "指标", "", None), ("GA3", "t", "i", "r", " 更好 ")]
    got = [r[0] for r in rows(data, "c string, t string, i string, r string, e string", text.query_text("c", "t", "i", "r", "e"))]
    assert got[0] == "GA1 议题 指标：" + ("需求" * 300)[:500] and got[1:] == ["GA2 指标", "GA3 更好"]


def test_route_labels(rows):
    assert rows([(1, 6, 9999), (1, 7, 9999), (9, 2, None), (30, 20, 3)], "a int, b int, c int", text.rank_source("a", "b", "c")) == [
        ("multi",), ("retrieval_query",), ("hypothetical_doc",), ("bm25",)]
    assert rows([(0.50, 0.51), (0.6, 0.5), (0.1, 0.5)], "a double, b double", text.score_source("a", "b")) == [
        ("both",), ("retrieval_query",), ("hypothetical_doc",)]


def test_json_items(rows):
    data = [('```json\n[{"id":"r1","q":"x"}]\n```',), ('[{"id":"r2","q":"y"}]',), ("not json",), ('{"id": "r3"}',), (None,)]
    got = [r[0] for r in rows(data, "a string", text.json_items("a", "id", "q"))]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[("r1", "x")], [("r2", "y")], None, None, None]


def test_templates(rows):
    t = "{{#if a}}A={{a}}{{else}}none{{/if}}\n\n\n\n{{#if b}}B{{/if}}{{c}}"
    got = rows([("x", " "), (None, "y")], "a string, b string", template.render(t, {"a": "a", "b": "b"}),
               template.fill("{a}-{zzz}", {"a": "a"}))
    assert got == [("A=x", "x-{zzz}"), ("none\n\nB", "-{zzz}")]


def test_project_parts(rows):
    assert rows([("a_b_2025",), ("solo",)], "p string", *text.project_parts("p")) == [("a_b", "2025"), ("solo", "")]


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT meaningful_chars('Hello 你好 123'), first_code('x EB10'), all_codes('GA1 GB2'), is_blank_text(' NaN '), "
                    "squeeze_text('a b\\n'), shorten_text('abcdef', 3), dot_product(array(1D, 2D), array(3D, 4D))").first()
    assert tuple(got) == (10, "EB10", ["GA1", "GB2"], True, "ab", "abc...", 11.0)
    register_chunker(spark)
    got = spark.sql("SELECT * FROM split_chunks('ab\\n\\ncd\\n\\nef', 5, 1)").collect()
    assert [r["chunk"] for r in got] == ["ab\n\n", "cd\n\n", "ef"]


def test_sql_bodies_equal_their_columns(spark):
    register(spark)
    odd = ["a\fb", "\t\n", " \u3000 nan\u3000", None, "", "NaN", "a\n b\t"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    rows.createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT squeeze_text(t) AS a, is_blank_text(t) AS b FROM odd_texts").collect()
    want = rows.select(text.squeeze("t").alias("a"), text.is_blank("t").alias("b")).collect()
    assert got == want


def test_splitter_by_positions_equals_the_column_form(spark):
    import random

    from proofloom.functions.splitting import split_batches, split_text
    from proofloom.operators.chunks import recursive_split

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc ", "\n", "\n\n", "。", "，", " ", "文字"]) for _ in range(rng.randrange(80))) for _ in range(150)] + [None, "", " \n\n \n\n", "x" * 95]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = rows.select("id", recursive_split("t", 20, 6).alias("c")).collect()
    assert [(r.c or []) for r in sorted(want)] == [split_text(t, 20, 6) for t in texts]
    long = rows.mapInArrow(split_batches(20, 6), "key long, pos int, chunk string").groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in long} == {r.id: len(r.c) for r in want if r.c}


def test_splitter_takes_long_texts():
    import time

    from proofloom.functions.splitting import split_text

    begun = time.time()
    assert len(split_text("abcd efgh ijkl。\n" * 200_000, 16, 1)) >= 100_000 and time.time() - begun < 20


def test_every_sql_function_equals_its_column(spark):
    from proofloom.functions.register import scalars
    from proofloom.plans.text import _SCALARS

    made = scalars()
    assert register(spark) == list(made) and sorted(made) == sorted(_SCALARS)
    odd = [None, "", " ", "nan", "a\n b\t'c' \\d", "\u3000x\u3000", "1.2.3 标题", "第3章 x", "EB10 ga1 EB10", "EB10", "[来源1, 3-5] x [来源]", "[待补充：q] y", "[NO_CONTENT]",
           "类型：照片\n描述：多\n", "a > b >c", "Instruct: i\nQuery: q", "x:0.5, y:0.1", "x" * 5000, "or(1) and(2) in(3) 1.5", "A1/B2_EB3.pdf", "<table>1</table> z"]
    values = {
        "STRING": odd, "INT": [None, 0, 3, 600] + [7] * 17, "BIGINT": [None, 0, 1, 5, 90000] + [9] * 16, "DOUBLE": [None, 0.0, 0.51, 0.5] + [0.9] * 17,
        "BOOLEAN": [None, True, False] * 7, "ARRAY<DOUBLE>": [None, [], [0.0, 0.0], [3.0, 4.0]] + [[1.0, None]] * 17,
        "ARRAY<STRUCT<code: STRING, score: DOUBLE>>": [None, [], [("a", 0.5)], [("a", None), (None, 0.25)]] + [[("b", 1.0)]] * 17}
    for name, (params, fn) in made.items():
        shifted = [values[kind][-i:] + values[kind][:-i] if i else values[kind] for i, kind in enumerate(params.values())]
        rows = spark.createDataFrame(list(zip(*shifted)), ", ".join(f"{p} {kind}" for p, kind in params.items())).coalesce(1)
        got = [r[0] for r in rows.select(F.call_function(name, *params)).collect()]
        assert got == [r[0] for r in rows.select(fn(*[F.col(p) for p in params])).collect()], name


def test_scalars_in_sql_compares_few_functions_at_once(spark):
    from proofloom.plans import text as plans

    rows = plans.scalars_in_sql(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    named = [sum(f" AS {name}#" in line for name in plans._SCALARS) for line in plan.splitlines() if "Aggregate" in line]
    assert named and max(named) <= plans.SCALARS_AT_ONCE
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert sorted(map(tuple, rows.collect())) == sorted((name, n, 0) for name in plans._SCALARS)


def test_scalar_inputs_take_large_ids(spark, tmp_path):
    from proofloom.plans import text as plans

    rows = [(i, "x", "en", "s", 1) for i in (1, 30_000_000, 2**31 + 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n_bytes for r in plans._scalar_inputs(spark, str(tmp_path)).orderBy("doc_id").collect()] == [97 * i for i, *_ in rows]
