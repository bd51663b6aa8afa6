import random

from pyspark.sql import functions as F

from proofloom.functions.text import meaningful_chars
from proofloom.operators import chunks as C
from proofloom.operators import sections as S

SECTION = "section_id string, page_or_sheet string, text string, section_title string"


def merged(spark, texts, low, high):
    data = [(1, i, f"s{i}", str(i), t, "" if i % 2 else f"t{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, f"doc_id int, pos int, {SECTION}")
    got = C.merge_section_rows(df, ["doc_id"], low, high).orderBy("pos").collect()
    listed = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section_id", "page_or_sheet", "text", "section_title"))).alias("s"))
    same = listed.select(F.explode(C.merge_short_sections(F.transform("s", lambda s: F.struct(
        *[s[c].alias(c) for c in ("section_id", "page_or_sheet", "text", "section_title")])), low, high)).alias("m")).select("m.*").collect()
    rows = [(r["section_id"], r["page_or_sheet"], r["text"], r["section_title"]) for r in got]
    assert rows == [tuple(r) for r in same]
    return rows


def by_loop(texts, low, high):
    """Direct statement of the merge on a plain list, for comparison."""
    count = lambda t: sum(c.isascii() and c.isalnum() or "一" <= c <= "鿿" for c in t)
    out = [[f"s{i}", str(i), t, "" if i % 2 else f"t{i}"] for i, t in enumerate(texts)]
    i = 0
    while i < len(out):
        if count(out[i][2]) >= low:
            i += 1
        elif i + 1 < len(out) and len(out[i][2]) + len(out[i + 1][2]) + 1 <= high:
            a, b = out[i], out.pop(i + 1)
            out[i] = [a[0], a[1], a[2] + "\n" + b[2], a[3] or b[3]]
        elif i > 0 and len(out[i - 1][2]) + len(out[i][2]) + 1 <= high:
            a, b = out[i - 1], out.pop(i)
            out[i - 1] = [a[0], a[1], a[2] + "\n" + b[2], a[3] or b[3]]
        else:
            i += 1
    return [tuple(x) for x in out]


def test_merge_short_sections(spark):
    z = "测"
    for sizes, low, high in [([200, 200], 100, 800), ([10, 200], 100, 800), ([200, 10], 100, 800), ([10, 10, 10], 100, 800),
                             ([10, 30], 100, 30), ([30, 20, 30], 100, 50), ([0, 200], 100, 800), ([15, 200, 20, 30], 100, 220)]:
        texts = [z * n for n in sizes]
        assert merged(spark, texts, low, high) == by_loop(texts, low, high)


def test_merge_short_sections_random(spark):
    rng = random.Random(1)
    for _ in range(6):
        texts = ["x" * rng.choice([0, 1, 5, 20, 40, 90]) + "。" * rng.choice([0, 3]) for _ in range(rng.randint(1, 14))]
        assert merged(spark, texts, 30, 80) == by_loop(texts, 30, 80)


def split(spark, text, high, low):
    return spark.createDataFrame([(text,)], "t string").select(C.recursive_split("t", high, low).alias("x")).first()["x"]


def test_recursive_split(spark):
    assert split(spark, "short", 10, 2) == ["short"]
    assert split(spark, "", 10, 2) == []
    assert "".join(split(spark, "a" * 100, 30, 5)) == "a" * 100
    assert split(spark, "ab\n\ncd\n\nef\n\ngh", 50, 10) == ["ab\n\ncd\n\nef\n\ngh"]
    assert split(spark, "a\n\n\nbccc", 4, 1) == ["a\n\n", "bccc"]


def test_recursive_split_keeps_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bc", "。", "，", "\n", "\n\n", "文 "]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.recursive_split("t", 25, 6).alias("x")).collect()
    for t, parts in rows:
        assert "".join(parts).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "")
        assert all(len(p) <= 25 for p in parts[:-1]) and len(parts[-1]) <= 25 + 5


def test_markdown_sections(spark):
    docs = spark.createDataFrame([
        (1, "# 第一章 A\n正文一\n# 第二章 B\n正文二"), (2, "no heading\nhere"), (3, " \n "),
        (4, "# A\nintro\n## A.1\nx\n### A.1.1\ny\n# B\nz")], "doc_id int, text string")
    got = [(r.doc_id, r.section_id, r.text, r.section_title) for r in S.sections_from_markdown(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "s0", "第一章 A\n正文一", ""), (1, "s1", "第二章 B\n正文二", ""), (2, "doc", "no heading\nhere", ""),
                   (4, "s0", "A\nintro", "A"), (4, "s1", "A.1\nx\nA.1.1\ny", "A"), (4, "s2", "B\nz", "B")]


def test_markdown_titles_are_used_in_order(spark):
    docs = spark.createDataFrame([(1, "# B\nx\n# A\ny\n# B\nz", [(1, "A"), (1, "B")])],
                                 "doc_id int, text string, titles array<struct<level:int,text:string>>")
    got = [r.text for r in S.sections_from_markdown(docs, titles="titles").orderBy("pos").collect()]
    assert got == ["# B\nx", "A\ny", "B\nz"]


def threshold(spark, sizes, blocks):
    spans = spark.createDataFrame([("d", float(s)) for s, n in sizes for _ in range(n)], "doc_id string, size double")
    rows = spark.createDataFrame([("d", float(s), t) for s, t, n in blocks for _ in range(n)], "doc_id string, max_size double, text string")
    return S.title_thresholds(spans, rows).first()["threshold"]


def test_title_threshold(spark):
    assert threshold(spark, [(12, 100)], [(12, "x", 10)]) == 0
    assert threshold(spark, [(10, 90), (12, 8), (16, 2)], [(10, "x", 45), (12, "x", 4), (16, "x", 3)]) == 12.0
    assert threshold(spark, [(12, 97), (20, 3)], [(12, "x", 97), (20, "x", 3)]) == 20.0
    assert threshold(spark, [(12, 97), (20, 2)], [(12, "x", 97), (20, "x", 2)]) == 0
    assert threshold(spark, [(10, 10), (20, 90)], [(10, "x", 60), (20, "x" * 201, 40)]) == 0


def test_document_routing(spark):
    schema = "doc_id string, page int, chars int, width double, height double, n_images int, block_chars array<int>"
    pages = [("text", 1, 500, 595.0, 842.0, 0, [200]), ("text", 2, 400, 595.0, 842.0, 0, [200]),
             ("mixed", 1, 500, 595.0, 842.0, 0, [200]), ("mixed", 2, 10, 595.0, 842.0, 1, []),
             ("slides", 1, 300, 1280.0, 720.0, 0, [20, 30]), ("wide", 1, 3000, 1280.0, 720.0, 0, [900])]
    got = {r.doc_id: r.route for r in S.route_documents(spark.createDataFrame(pages, schema)).collect()}
    assert got == {"text": "text", "mixed": "sdk", "slides": "sdk", "wide": "text"}


def chunk_rows(spark, text, **limits):
    df = spark.createDataFrame([("f.pdf", "s0", "1", "", text)], "relative_path string, section_id string, page_or_sheet string, section_title string, text string")
    return C.make_chunks(df, **limits).orderBy("chunk_pos").collect()


def test_table_chunks(spark):
    rows = "".join(f"<tr><td>{i}</td><td></td></tr>" for i in range(61))
    got = chunk_rows(spark, f"<table><tr><td>A</td><td>B</td></tr>{rows}</table>")
    assert [r.table_rows for r in got] == [30, 30, 1]
    assert [r.chunk_id for r in got] == ["f.pdf#s0#t0p0", "f.pdf#s0#t0p1", "f.pdf#s0#t0p2"]
    assert all(r.text.startswith("| A | B |\n| --- | --- |\n") for r in got) and got[2].text.endswith("| 60 |  |")
    broken = chunk_rows(spark, "<table>nothing</table>")
    assert [(r.text, r.table_rows) for r in broken] == [("<table>nothing</table>", 0)]


def test_short_text_joins_text_before_it(spark):
    got = chunk_rows(spark, "长" * 120 + "<table><tr><td>A</td></tr><tr><td>1</td></tr></table>short<table><tr><td>B</td></tr><tr><td>2</td></tr></table>")
    assert [(r.is_table, r.char_count) for r in got] == [(False, 126), (True, 2), (True, 2)]
    assert got[0].text == "长" * 120 + "\nshort"


def test_blank_pieces(spark):
    text = "a" * 1200 + "\n\n" + "b" * 1200
    assert [(r.text[-2:], r.char_count) for r in chunk_rows(spark, text)] == [("aa", 1200), ("bb", 1200)]
    assert [(r.chunk_id, r.text[-3:], r.char_count) for r in chunk_rows(spark, "a" * 1200 + "\n" + "b" * 1200, keep_blank=True)] == [
        ("f.pdf#s0#c0p0", "a\n\n", 1201), ("f.pdf#s0#c0p2", "bbb", 1200)]


def test_parents_and_context(spark):
    df = spark.createDataFrame([("f", "s0", "x<TABLE><tr><th>A</th></tr><tr><td>1 &amp; 2</td></tr></TABLE>y")], "relative_path string, section_id string, text string")
    parent = C.make_parents(df).first()["parent_text"]
    assert parent == "x\n| A |\n| --- |\n| 1 & 2 |\ny"
    rows = spark.createDataFrame([("b" * 500 + "TABLE" + "a" * 500, "TABLE"), ("none", "TABLE"), ("none", "")], "p string, t string")
    got = [tuple(r[0]) for r in rows.select(C.table_context("t", "p")).collect()]
    assert got == [("b" * 300, "a" * 300), ("", ""), ("", "")]
    ctx = spark.createDataFrame([("x" * 1500 + "HIT" + "y" * 1500, "HIT"), ("short HIT", "HIT"), ("", "HIT"), ("z" * 3000, "HIT")], "p string, t string")
    got = [r[0] for r in ctx.select(C.chunk_context("t", F.lit(None).cast("string"), "p")).collect()]
    assert got == ["x" * 300 + "HIT" + "y" * 300, "short HIT", "HIT", "HIT"]


def test_images(spark):
    assets = spark.createDataFrame([("d", "h1", 1, 0), ("d", "h1", 2, 0), ("d", "h2", 1, 1)], "doc_id string, sha256 string, page int, pos int")
    got = sorted((r.sha256, r.page, r.number) for r in S.number_images(assets).collect())
    assert got == [("h1", 1, 1), ("h2", 1, 2)]
    found = spark.createDataFrame([("a.png", 1, "文档扫描件", "d", "识别出的文字内容超过十个字"), ("a.png", 1, "照片", "d", "识别出的文字内容超过十个字"),
                                   ("a.png", 1, "表格截图", "d", "短")], "file_name string, page int, type string, description string, ocr_text string")
    got = [r.text.split("\n")[1] for r in S.image_sections(found).collect()]
    assert got == ["识别出的文字内容超过十个字", "d", "d"]


def test_html_keeps_all_visible_text(spark):
    from proofloom.operators.sections import html_marks

    html = ("<html><head><title>no</title></head><body>loose<div>in div<p>one<p>two <b>bold</b></div><!-- no --><H2 class='x'>Head</H2>after"
            "<table><tr><td><p>cell</p></td></tr></table><footer>foot&nbsp;er</footer><script>no()</script><li>item<h3>last")
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(html_marks("h").alias("m")).collect()
    got = [(m["level"], m["text"]) for m in rows[0]["m"]]
    assert got == [(0, "loose"), (0, "in div"), (0, "one"), (0, "two bold"), (2, "Head"), (0, "after"),
                   (0, "<table><tr><td><p>cell</p></td></tr></table>"), (0, "foot er"), (0, "item"), (3, "last")]
    assert rows[1]["m"] is None and rows[2]["m"] == []


def test_spanning_cells_are_repeated():
    from proofloom.functions import tables

    cell = lambda text, **spans: f"<td{''.join(f' {k}={v}' for k, v in spans.items())}>{text}</td>"
    rows = lambda *lines: tables.grid("<table>" + "".join(f"<tr>{x}</tr>" for x in lines) + "</table>")
    assert rows(cell("a", rowspan=2) + cell("b", colspan=2), cell("c") + cell("d")) == [["a", "b", "b"], ["a", "c", "d"]]
    assert rows(cell("a") + cell("b", rowspan=3), cell("c"), cell("d")) == [["a", "b"], ["c", "b"], ["d", "b"]]
    assert rows(cell("a", rowspan=2, colspan=2), cell("b"), cell("c")) == [["a", "a", ""], ["a", "a", "b"], ["c", "", ""]]
    assert rows(cell("a") + cell("b") + cell("c", rowspan=0), cell("d"), "", cell("e")) == [["a", "b", "c"], ["d", "", "c"], ["", "", "c"], ["e", "", "c"]]
    assert rows(cell("a", rowspan='"9"'), "") == [["a"], ["a"]] and rows("", "") == []
    assert rows(cell("x", colspan=0)) == [["x"]] and len(rows(cell("x", colspan=10**9))[0]) == tables.MAX_COLUMNS


def test_long_sections_are_cut_in_one_walk():
    import time

    from proofloom.functions import splitting

    begun = time.time()
    lines = splitting.section_chunks("f#s", "word word\n" * 1_000_000, 20, 1)
    tables = splitting.section_chunks("f#s", "<table><tr><td>h</td></tr><tr><td>1</td></tr></table>x\n" * 50_000)
    leading = splitting.section_chunks("f#s", "a。\n" * 300_000, 4, 10**9)
    assert len(lines) == 500_000 and len(tables) == 50_001 and len(leading) == 1 and time.time() - begun < 60
    assert "\n".join(leading[0].parts).count("a") == 300_000 and leading[0].count == 300_000 + len(leading[0].parts) - 1


def test_chunks_keep_other_columns(spark):
    df = spark.createDataFrame([("f", "s", "a b", 1, [1, 2], ("x", 2)), ("g", "s", None, 2, None, None), ("h", "s", " ", 3, [], ("y", None))],
                               "relative_path string, section_id string, text string, row int, list array<int>, parent struct<a:string,b:int>")
    got = C.make_chunks(df)
    assert got.columns == ["chunk_id", "parent_id", "relative_path", "row", "list", "parent", "chunk_pos", "text", "char_count", "is_table", "table_markdown", "table_html", "table_rows"]
    assert [tuple(r)[:9] for r in got.collect()] == [("f#s#c0", "f#s", "f", 1, [1, 2], ("x", 2), 0, "a b", 2)]


def test_messages_of_a_large_group_spread_over_parts(spark, monkeypatch):
    from proofloom.operators import drafts as D

    monkeypatch.setattr(D, "BATCHES_AT_ONCE", 2)
    leaves = [("a", i, f"r{i:03d}", f"p{i}" if i != 4 else None, f"t{i}", f"g{i}") for i in range(23)] + [("b", 99, "r099", "p", "t", "g")]
    rows = D.batches(spark.createDataFrame(leaves, "l1 string, row int, leaf_id string, full_path string, leaf_title string, gloss string"), 3)
    got = {(r.l1, r.batch): r.message for r in D.batch_messages(rows).collect()}
    assert len(got) == 9 and got["b", 1] == "[r099] 路径：p\n    标题：t\n    释义：g"
    for batch in range(1, 9):
        mine = range(3 * batch - 3, min(3 * batch, 23))
        around = [f"{'→ ' if i in mine else '  '}[r{i:03d}] p{i}" for i in range(23) if i != 4]
        own = [f"[r{i:03d}] 路径：p{i}\n    标题：t{i}\n    释义：g{i}" for i in mine if i != 4]
        assert got["a", batch] == "\n\n".join(["## 完整章节列表（供参考，理解各节点间的区分）\n", *around, "", "## 待生成节点（只需为以下节点生成输出）\n", *own])


def test_blocks_are_dealt_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_CHARS", 1000)
    rows = spark.range(90).selectExpr("id % 30 doc_id", "id pos", "1 page", "10.0D size", "10.0D max_size", "repeat('x', 200) text")
    got = S.sections_from_blocks(rows.select("doc_id", "size"), rows)
    assert got.rdd.getNumPartitions() == -(-90 * (200 + S.BLOCK_CHARS) // 1000)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(i, "\n".join(["x" * 200] * 3)) for i in range(30)}


def test_message_digests_are_those_of_the_messages(spark, monkeypatch):
    import hashlib

    from proofloom.operators import drafts as D

    leaves = [("a", i, f"r{i:03d}", f"p{i}" if i not in (4, 12, 13, 14) else None, f"t{i}", f"g{i}" if i < 20 else None) for i in range(23)]
    leaves += [("b", 99, "r099", "p", "t", "g"), ("c", 100, "r100", None, "t", "g"), (None, 101, "r101", "p", "t", "g")]
    rows = D.batches(spark.createDataFrame(leaves, "l1 string, row int, leaf_id string, full_path string, leaf_title string, gloss string"), 3)
    want = None
    for at_once, parts, text in ((256, 64, 1 << 20), (1, 3, 1), (1, 64, 200)):
        monkeypatch.setattr(D, "BATCHES_AT_ONCE", at_once)
        monkeypatch.setattr(D, "PARTS", parts)
        monkeypatch.setattr(D, "TEXT_AT_ONCE", text)
        texts, digests = (sorted(map(tuple, D.batch_messages(rows, digest).select("l1", "batch", "batch_name", "leaf_ids", "message").collect())) for digest in (False, True))
        assert [(*r[:4], hashlib.md5(r[4].encode()).hexdigest()) for r in texts] == digests and len(texts) == 10
        assert texts == (want := want or texts) and texts[-1][4] == "" and "p13" not in texts[0][4]


def test_message_digests_hold_one_list_and_no_message():
    import tracemalloc

    import pyarrow as pa

    from proofloom.operators import drafts as D

    line = ("  [r] " + "x" * 994).encode()
    columns = [("l1", pa.string()), ("part", pa.int64()), ("batch", pa.int32()), ("splits", pa.int64()), ("plain", pa.binary()), ("mine", pa.bool_()),
               ("marked", pa.binary()), ("own", pa.binary()), ("leaf_ids", pa.list_(pa.string()))]

    def rows():
        for at in range(0, 4000, 100):
            batch = [("a", 0, i, 4000, line, i < 40, line if i < 40 else None, b"own" if i < 40 else None, ["r"] if i < 40 else None) for i in range(at, at + 100)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*batch), columns)], schema=pa.schema(columns))

    tracemalloc.start()
    got = [r for b in D._messages(True)(rows()) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 40 and len({r["message"] for r in got}) == 1 and peak < 12_000_000
