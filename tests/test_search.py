import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.operators import fusion as X
from proofloom.operators import lexical as L
from proofloom.operators import postings
from proofloom.operators import vectors as V
from proofloom.operators.ranking import global_rank


def brute_bm25(docs, queries, n):
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    size, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(size - c + .5) - math.log(c + .5) for w, c in df.items()}
    floor = .25 * sum(raw.values()) / len(raw)
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = set()
    for q, text in queries:
        scores = {}
        for d, t in toks.items():
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (.25 + .75 * len(t) / mean)) for w in re.findall(r"\w+", text.lower()) if w in tf)
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        for rank, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.add((q, d, s, rank))
    return out


@pytest.mark.parametrize("max_terms", [10_000, 0])
def test_bm25_equals_brute_force_with_a_third_of_copies(spark, max_terms):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, "the copy text w1 w2 w2" if i % 3 == 0 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) + " the")
            for i in range(150)] + [(999, "")]
    queries = [(j, " ".join(rng.choices(vocabulary + ["the", "unknown"], k=5))) for j in range(8)]
    got = L.search(spark.createDataFrame(docs, "d long, text string").repartition(5), "d",
                   spark.createDataFrame(queries, "q long, text string"), "q", 20, max_terms=max_terms)
    got = {(r.q, r.d, r.score, r["rank"]) for r in got.collect()}
    assert got == brute_bm25(docs, queries, 20)


def test_bm25_padding(spark):
    docs = spark.createDataFrame([(i, "cat" if i == 5 else "dog bird") for i in range(10)], "d long, text string")
    got = L.search(docs, "d", spark.createDataFrame([(1, "cat")], "q long, text string"), "q", 4, pad=True)
    assert [(r.d, r.score > 0) for r in got.orderBy("rank").collect()] == [(5, True), (0, False), (1, False), (2, False)]


def test_han_pairs(spark):
    rows = spark.createDataFrame([("碳排放 ESG报告",), ("碳排放碳排放",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(L.words_and_han_pairs("t")).collect()] == [["碳排", "排放", "esg", "报告"], ["碳排", "排放", "放碳", "碳排", "排放"], None, []]
    tokens = L.with_dictionary(spark.createDataFrame([("碳排放",), ("放碳排放",), ("报告",), ("ESG",), (None,)], "term string"))
    got = [r[0] for r in rows.select(tokens("t")).collect()]
    assert got[0] == ["碳排", "排放", "esg", "报告", "碳排放"] and got[1][5:] == ["碳排放", "碳排放", "放碳排放"] and got[2:] == [None, []]
    with pytest.raises(ValueError):
        L.with_dictionary(spark.range(9).selectExpr("concat('term', id) term"), max_terms=8)


@pytest.mark.parametrize("first_ranges", [1, 4])
def test_stored_postings_equal_the_scan(spark, tmp_path, first_ranges):
    rng = random.Random(first_ranges)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randrange(0, 40))) if i % 17 else None) for i in range(400)] + [(900 + i, "same text here") for i in range(30)]
    asked = [(i, " ".join(rng.choices([*words, "absent", "same"], k=rng.randrange(0, 6)))) for i in range(25)] + [(99, None)]
    rows, queries = spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(asked, "q long, text string")
    want = sorted(tuple(r) for r in L.search(rows, "d", queries, "q", 7).collect())
    index = postings.build(rows, "d", folder=str(tmp_path / "index"), range_docs=16)
    assert sorted(tuple(r) for r in postings.search(index, queries, "q", "d", 7, first_ranges=first_ranges).collect()) == want
    again = postings.load(spark, str(tmp_path / "index"), rows.schema["d"].dataType)
    assert sorted(tuple(r) for r in postings.search(again, queries, "q", "d", 7).collect()) == want
    empty = postings.build(rows.limit(0), "d", folder=str(tmp_path / "empty"))
    assert postings.search(empty, queries, "q", "d", 7).collect() == []


def test_a_search_of_stored_postings_reads_no_text(spark, tmp_path):
    """The texts may be gone: the build read them once, a search opens the folders of its tokens only."""
    spark.createDataFrame([(i, f"a{i % 50} b{i % 7}") for i in range(300)], "d long, text string").write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    index = postings.build(rows, "d", folder=str(tmp_path / "index"))
    for file in (tmp_path / "docs").glob("*"):
        file.write_bytes(b"")
    hits = postings.search(index, spark.createDataFrame([(1, "a3 b3")], "q long, text string"), "q", "d", 5)
    assert hits.count() == 5
    plan = index.blocks.filter(F.col("bucket").isin([3])).select("token", "top")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "postings" not in plan.split("ReadSchema")[-1]


def test_embedder_from_outside(spark):
    from proofloom.operators import vectors as V

    def fn(texts):
        assert 0 < len(texts) <= 3
        if "bad" in texts:
            raise RuntimeError("no")
        return [[len(t), 1] if t != "long" else [1, 2, 3] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "  "), (4, "bad"), (5, "b"), (6, "c"), (7, "long")], "i int, text string").coalesce(1)
    got = {r["i"]: (r["embedding"], r["embedding_error"]) for r in V.embed_with(rows, fn, dim=2, batch=3, tries=2, wait=0.0).collect()}
    assert got[1] == ([1.0, 1.0], None) and got[2] == got[3] == (None, None)
    assert all(got[i] == (None, "RuntimeError: no") for i in (4, 5, 6)) and got[7] == (None, "ValueError: a vector has not 2 values")


def test_global_rank_with_one_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "cold", i % 4, i) for i in range(500)], "g string, s int, id int")
    got = {(r.g, r.id): r["rank"] for r in global_rank(df, ["g"], [F.desc("s"), F.col("id")], partitions=7).collect()}
    for g in ("hot", "cold"):
        ids = sorted([(-(i % 4), i) for i in range(500) if ("hot" if i % 3 else "cold") == g])
        assert [got[(g, i)] for _, i in ids] == list(range(1, len(ids) + 1))


def vectors(rng, n, dim=6):
    return [[float(x) for x in rng.normal(size=dim)] for _ in range(n)]


def test_nearest_ways_agree_and_invalid_vectors_stay_out(spark):
    rng = np.random.default_rng(4)
    data = [(f"c{i}", v) for i, v in enumerate(vectors(rng, 40))] + [("none", None), ("zero", [0.0] * 6), ("empty", [])]
    rows = spark.createDataFrame(data, "chunk_id string, embedding array<double>")
    targets = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(vectors(rng, 12))], "code string, embedding array<double>")
    one = {tuple(r) for r in V.nearest(rows, "chunk_id", targets, "code", 3).collect()}
    two = {tuple(r) for r in V.nearest(rows, "chunk_id", targets, "code", 3, shipped=0).collect()}
    assert one == two and len(one) == 120


def test_dual_scores_ways_agree(spark):
    rng = np.random.default_rng(5)
    pool = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(vectors(rng, 20))], "chunk_id string, embedding array<double>")
    leaves = spark.createDataFrame([(f"r{i}", a, b) for i, (a, b) in enumerate(zip(vectors(rng, 4), vectors(rng, 4)))],
                                   "leaf_id string, rq array<double>, hyde array<double>")
    key = lambda df: {(r.leaf_id, r.chunk_id, r.score) for r in df.collect()}
    assert key(V.dual_scores(pool, leaves)) == key(V.dual_scores(pool, leaves, shipped=0))


def brute_fuse(pool, leaves, bm25, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for leaf, code, rq, hyde in leaves:
        s = {c: (round(float(unit(v) @ unit(rq)), 6), round(float(unit(v) @ unit(hyde)), 6)) for c, _, _, _, v in pool}
        rank = [{c: i for i, c in enumerate(sorted(s, key=lambda c: (-s[c][j], c)), 1)} for j in (0, 1)]
        lex = {c: r for l, c, r in bm25 if l == leaf}
        fused = []
        for c, parent, folder, status, _ in pool:
            score = (1 / (60 + rank[0][c]) + 1 / (60 + rank[1][c]) + (1 / (60 + lex[c]) if c in lex else 0)) if lex else max(s[c])
            if folder == code:
                score += -0.25 if status == "misplaced" else 0.5
            fused.append((-round(score, 9), c, parent or c, score))
        seen, top = set(), []
        for _, c, parent, score in sorted(fused):
            if parent not in seen and len(top) < k:
                seen.add(parent)
                top.append((c, rank[0][c], rank[1][c], round(score, 6)))
        out[leaf] = top
    return out


@pytest.mark.parametrize("options", [{}, {"depth": 2}, {"depth": 2, "depth_limit": 1}, {"depth": 4, "leaf_block": 2}])
def test_fusion_equals_brute_force(spark, options):
    rng = np.random.default_rng(6)
    base = vectors(rng, 120)
    pool = []
    for i, v in enumerate(base):
        v = base[0] if i % 3 == 0 else v                     # a third of the chunks are copies
        parent = "hot" if i % 4 == 0 else (None if i % 10 == 3 else f"p{i // 2}")
        pool.append((f"c{i:03d}", parent, f"k{i % 5}" if i % 7 else None, "misplaced" if i % 6 == 0 else "consistent", v))
    leaves = [(f"r{j}", f"k{j}", vectors(rng, 1)[0], vectors(rng, 1)[0]) for j in range(5)]
    bm25 = [(f"r{j}", f"c{(7 * j + 11 * r) % 120:03d}", r) for j in range(4) for r in range(1, 9)]
    got = X.fuse(
        spark.createDataFrame(pool, "chunk_id string, parent_id string, folder_code string, alignment_status string, embedding array<double>").repartition(3),
        spark.createDataFrame(leaves, "leaf_id string, code string, rq array<double>, hyde array<double>"),
        spark.createDataFrame([(a, b, r, 1.0) for a, b, r in bm25], "leaf_id string, chunk_id string, rank int, score double"),
        k=7, **options).orderBy("leaf_id", "rank").collect()
    want = brute_fuse(pool, leaves, bm25, 7)
    for leaf, rows in want.items():
        assert [(r.chunk_id, r.rank_rq, r.rank_hyde, r.score) for r in got if r.leaf_id == leaf] == rows


def test_rerank(spark):
    rows = [("a", 1, 0.9, 0.1), ("a", 2, 0.8, 0.7), ("a", 3, 0.7, 0.7), ("b", 1, 0.9, None), ("b", 2, 0.8, 0.9)]
    df = spark.createDataFrame(rows, "leaf_id string, rank int, score double, new_score double")
    got = [(r.leaf_id, r["rank"], r.biencoder_rank, r.score, r.skipped) for r in X.rerank(df, k=2).orderBy("leaf_id", "rank").collect()]
    assert got == [("a", 1, 2, 0.7, False), ("a", 2, 3, 0.7, False), ("b", 1, 1, 0.9, True), ("b", 2, 2, 0.8, True)]


def test_hashing_vector_equals_plain_computation(spark):
    import hashlib

    texts = ["the cat the dog", "Étage 12 cat", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.hashing_vector("t", 8).alias("v")).collect()
    assert rows[3].v == [0.0] * 8 and rows[4].v is None
    for text, row in zip(texts[:3], rows):
        want = np.zeros(8)
        for token in re.findall(r"\w+", text.lower()):
            h = int(hashlib.md5(token.encode()).hexdigest()[:4], 16)
            want[h % 8] += -1 if h >> 8 & 1 else 1
        assert np.allclose(row.v, want / np.linalg.norm(want))


@pytest.mark.parametrize("kind,first", [("int", 1), ("long", 1), ("string", "a"), ("date", __import__("datetime").date(2020, 1, 1))])
def test_search_ways_agree_for_every_kind_of_id(spark, kind, first):
    ids = [first, {"string": "b"}.get(kind, first + __import__("datetime").timedelta(1) if kind == "date" else 2)]
    docs = spark.createDataFrame([(ids[0], "red fox red"), (ids[1], "blue fox")], f"d {kind}, text string")
    asked = spark.createDataFrame([(ids[0], "red"), (ids[1], "blue fox"), (ids[1], None)], f"q {kind}, text string")
    show = lambda df: sorted(map(tuple, df.collect()))
    one, two = (show(L.search(docs, "d", asked, "q", 5, max_terms=m, pad=True)) for m in (500_000, 0))
    assert one == two and len(one) == 4



def test_query_vectors_fall_back_to_the_query(spark):
    leaves = spark.createDataFrame([("a", "q one", ""), ("b", "q two", "answer"), ("c", " ", "x")],
                                   "leaf_id string, retrieval_query string, hypothetical_doc string")
    ready, rejected = V.split_ready(leaves)
    got = {r.leaf_id: r for r in V.embed_queries(ready).collect()}
    assert got["a"].rq == got["a"].hyde and got["b"].rq != got["b"].hyde and [r.leaf_id for r in rejected.collect()] == ["c"]


def test_nearest_lists_equal_nearest_rows_without_moving_the_rows(spark):
    import random

    random.seed(5)
    draw = lambda: [round(random.uniform(-1, 1), 1) for _ in range(4)]
    rows = spark.createDataFrame([(f"c{i}", f"t{i}", draw()) for i in range(60)] + [("c60", "z", [0.0] * 4), ("c61", "n", None), ("c62", "e", []), ("c63", "x", [1.0])],
                                 "chunk_id string, text string, embedding array<double>")
    targets = spark.createDataFrame([(f"d{i:02}", v) for i in range(12) for v in [draw()]] + [("d98", [1.0, 0.0, 0.0, 0.0]), ("d99", [2.0, 0.0, 0.0, 0.0]), ("bad", None)],
                                    "code string, embedding array<double>")
    proper = rows.filter("chunk_id <> 'c63'")
    want = {}
    for r in V.nearest(proper, "chunk_id", targets, "code", 3).orderBy("chunk_id", "rank").collect():
        want.setdefault(r["chunk_id"], []).append((r["code"], r["score"]))
    for df, shipped in ((rows, 4096), (proper, 0)):
        got = {r.chunk_id: [tuple(x) for x in r.top] for r in V.with_nearest(df, "chunk_id", targets, "code", 3, shipped=shipped).collect()}
        assert {k: v for k, v in got.items() if v} == want and set(got) == {r.chunk_id for r in df.collect()}
    plan = V.with_nearest(rows, "chunk_id", targets, "code", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    none = V.with_nearest(rows, "chunk_id", targets.limit(0), "code", 3)
    assert none.count() == 64 and all(r.top == [] for r in none.collect())


def test_pool_reasons_carry_no_text_that_is_not_asked_for(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "类型：照片"), ("c", "x"), ("d", "x"), ("e", None)], "chunk_id string, text string")
    vectors = spark.createDataFrame([(c, [1.0, 0.0]) for c in "abc"] + [("d", [0.0, 0.0]), ("e", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1), ("d", 0.9), ("e", 0.9)], "chunk_id string, top1 double")
    reasons = X.candidate_reasons(chunks, vectors, scores, 0.3)
    assert {r.chunk_id: r.reason for r in reasons.collect()} == {"a": None, "b": "photo", "c": "low_score", "d": "invalid_embedding", "e": None}
    assert reasons.columns == ["chunk_id", "text", "embedding", "top1", "reason"]


def test_vector_places_round_as_their_sql(spark):
    from proofloom.plans.retrieval import _places

    rows = spark.createDataFrame([(1, [41 / 640, -41 / 640, 0.0, 4e-7, 0.5])], "id long, v array<double>")
    got = [(r.place, r.value) for r in _places(rows, "v").orderBy("place").collect()]
    assert got == [(0, 0.064062), (1, -0.064062), (4, 0.5)]


def test_vocabulary_query_lists_every_token(spark, tmp_path):
    from proofloom.plans.retrieval import bm25_vocabulary

    spark.createDataFrame([(1, "one two two"), (2, "Two three"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.df for r in bm25_vocabulary(spark, str(tmp_path)).select("token", "df").collect()}
    assert got == {"one": 1, "two": 2, "three": 1}


def test_dictionary_holds_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    runs = pa.concat_arrays([pa.array([["甲乙丙丁", "丙丁"] * 1000, None, []], pa.list_(pa.string()))] * 300)
    tracemalloc.start()
    got = L._occurrence_lists(runs, {"甲乙丙", "丙丁戊"})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == ["甲乙丙"] * 1000 and got[1].as_py() is None and got[899].as_py() == [] and len(got) == 900
    assert peak < 5_000_000


def test_texts_are_searched_where_they_are_read(spark, monkeypatch):
    from proofloom.operators import alignment
    from proofloom.plans import retrieval, tables

    sf, plans, real = "/root/testdata/sf0.001", [], L.search

    def search(docs, *args, **options):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return real(docs, *args, **options)

    monkeypatch.setattr(L, "search", search)
    monkeypatch.setattr(alignment, "search", search)
    retrieval.fusion_inputs(spark, sf)
    retrieval.two_route_alignment(spark, sf)
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    whole, light = tables.chunks(spark, sf), tables.chunk_texts(spark, sf)
    assert sorted(whole.select(*light.columns).collect()) == sorted(light.collect())


def test_join_deals_documents_by_the_pairs_they_make(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS_AT_ONCE", 50)
    docs = spark.createDataFrame([(i, "z" if i >= 100 else "a b" if i % 2 else "a") for i in range(300)], "d long, text string")
    asked = L.query_terms(spark.createDataFrame([(q, "a b") for q in range(7)], "q long, text string"), "q")
    idf, stats = L.vocabulary_index(docs)
    scored = L._join(docs, "d", "text", L.words, asked, idf, stats, "q")
    # 7 queries, 100 documents with one word and 50 with the other: the join makes 1,050 rows
    assert scored.rdd.getNumPartitions() == 21
    assert scored.select("q", "d").distinct().count() == scored.count() == 700


@pytest.mark.parametrize("depth,limit", [(2, 16384), (1, 1)])
def test_fusion_reads_its_pool_once(spark, depth, limit):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rng = np.random.default_rng(4)
    schema = "chunk_id string, parent_id string, folder_code string, alignment_status string, embedding array<double>"
    pool = spark.createDataFrame([(f"c{i:03}", f"p{i // 2}", str(i % 3), "consistent", rng.normal(size=4).tolist()) for i in range(200)],
                                 schema).repartition(3).mapInPandas(counted, schema)
    leaves = spark.createDataFrame([(f"r{i}", str(i), rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(2)],
                                   "leaf_id string, code string, rq array<double>, hyde array<double>")
    bm25 = spark.createDataFrame([("r0", f"c{i:03}", i + 1, 1.0 / (i + 1)) for i in range(30)], "leaf_id string, chunk_id string, rank int, score double")
    assert X.fuse(pool, leaves, bm25, k=20, depth=depth, depth_limit=limit).count() == 40
    assert read.value == 200


def test_places_in_both_routes_come_from_one_pass(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i % 2, i % 3, f"c{i:03}", float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(120)],
                                 "leaf int, cls int, chunk_id string, score_rq double, score_hyde double")
    got = X._best_places(rows, ["leaf", "cls"], 4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for place, route in (("place_rq", "score_rq"), ("place_hyde", "score_hyde")):
        for r in X.top_n(rows, ["leaf", "cls"], [F.desc(route), F.col("chunk_id")], 4, place).collect():
            want.setdefault(r.chunk_id, {})[place] = r[place]
    assert {r.chunk_id: {p: r[p] for p in ("place_rq", "place_hyde") if r[p]} for r in got.collect()} == want


def test_first_chunks_are_found_without_moving_vectors(spark):
    from proofloom.plans import tables

    sf = "/root/testdata/sf0.001"
    assert not re.search(r"\bembedding#", tables.first_places(spark, sf)._jdf.queryExecution().executedPlan().toString())
    whole = tables.chunks(spark, sf).groupBy("label").agg(F.min_by(F.struct("embedding", "text"), "pos").alias("f")).select("label", "f.*")
    assert sorted(map(str, tables.first_chunks(spark, sf).collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("name", ["leaf_stats", "retrieval_diff", "rerank"])
def test_leaves_are_derived_once(spark, monkeypatch, name):
    from proofloom.plans import retrieval, tables

    calls, real = [], tables.query_leaves
    monkeypatch.setattr(tables, "query_leaves", lambda *args: calls.append(args) or real(*args))
    retrieval.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["retrieval_diff", "weakest_leaves", "leaf_stats", "mean_score_by_source", "source_distribution", "rerank"])
def test_figures_over_results_read_no_text_again(spark, name):
    from proofloom.plans import retrieval

    figures = retrieval.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert figures.inputFiles() and not any("/documents.parquet" in f or "/embeddings.parquet" in f for f in figures.inputFiles())


def test_vectors_of_texts_whose_tokens_cancel_equal_their_sql(spark, tmp_path):
    import hashlib

    import duckdb

    from proofloom.plans.retrieval import ORACLE, query_vectors, text_vectors

    code = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    first = {}
    pair = next((first[key], w) for w in (f"w{i}" for i in range(999)) for key in [(code(w) % 64, 1 - code(w) // 256 % 2)]
                if first.setdefault((code(w) % 64, code(w) // 256 % 2), w) and key in first)
    texts = [" ".join(pair), " ".join(pair * 3), f"{pair[0]} {pair[1]} {pair[0]}", "...", " ", None, "one two three"]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts) if (t or "").strip()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for query, view, least in ((text_vectors, "documents", 2), (query_vectors, "benchmark", 1)):
        name = query.__name__
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path}/{view}.parquet/*.parquet'")
        want = sorted(map(str, con.execute(ORACLE[name]).fetchall()))
        assert sorted(str(tuple(r)) for r in query(spark, str(tmp_path)).collect()) == want
        assert sum("nan" in w for w in want) == least


def test_counts_with_a_dictionary_equal_its_tokens(spark, monkeypatch):
    import pyarrow as pa

    random.seed(3)
    draw = lambda n: "".join(random.choice("甲乙丙丁𠀀々é9a 〆.") for _ in range(n))
    texts = [draw(n) for n in (0, 1, 2, 3, 5, 40, 40, 400, 2000)] + [None, "甲", "abc", "甲" * 50, "𠀀𠀀𠀀", "Ab甲乙丙"] + [draw(60) for _ in range(40)]
    terms = spark.createDataFrame([("甲乙丙",), ("丙丁𠀀",), ("甲甲甲甲",), ("乙丙丁甲乙",), ("甲乙",), ("9甲乙",), ("甲乙é",), (None,)] + [(draw(3),) for _ in range(300)], "term string")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    words, counts = L.with_dictionary(terms), L.counts_with_dictionary(terms)
    marked, known = L._lookup(L._terms(terms, "term", 1000))
    kind = pa.list_(pa.struct([("run", pa.string()), ("han", pa.bool_())]))
    for size in (1, 100, 1 << 19):
        monkeypatch.setattr(L, "BYTES_AT_ONCE", size)
        made = rows.select("i", words("t").alias("w"), L._marked_runs("t").alias("r")).collect()
        lists = L._counted_lists(pa.array([r.r and [x.asDict() for x in r.r] for r in made], kind), marked, known)
        for r, got in zip(made, lists.to_pylist()):
            want = None if r.w is None else [{"token": t, "n": n} for t, n in sorted(Counter(r.w).items(), key=lambda x: x[0].encode())]
            assert got == want, r.i
    found = {r.i: r.c for r in rows.select("i", counts("t").alias("c")).collect()}
    assert found[9] is None and found[0] == [] and [tuple(x) for x in found[12]] == [("甲甲", 49), ("甲甲甲甲", 47)]
    assert L._counted_lists(pa.array([], kind), marked, known).to_pylist() == []
    assert [tuple(x) for r in rows.filter("i = 14").select(L.counts_with_dictionary(terms.limit(0))("t").alias("c")).collect() for x in r.c] == [("ab", 1), ("乙丙", 1), ("甲乙", 1)]


def test_dictionary_query_equals_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from proofloom.plans.retrieval import ORACLE, dictionary_tokens

    texts = ["abcd abcd xabcdx", None, "", "...", "a", "12 é9 ab", "Water WATER water-course", "abc" * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "abcde water"), (2, None), (3, "bc")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path}/{view}.parquet/*.parquet'")
    got = sorted(map(tuple, dictionary_tokens(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE["dictionary_tokens"]).fetchall()) and len(got) == 8
