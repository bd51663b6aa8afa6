import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import pstable, url_rules

SF = "/root/testdata/sf0.01"

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x=/y#z", "https://example.org", "https://example.org/",
    "https://blog.example.org/en/12", "https://notexample.org/en/1", "http://org/a", "http://a.com/fr/", "http://a.com/fr", "http://a.com/DE/x", "http://a.com/de/",
    "ftp://h?q://k/p", "x\ny://Host.NET/pa\nth#f", "http://ÄB.com/de/" + "x" * 50_000, "a://b://c/d",
]


def plain(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def plain_rule(host, path):
    fits = [(h, p, v) for h, p, v in url_rules.GIVEN if (host == h or host.endswith("." + h)) and path.startswith(p)]
    h, p, v = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, None))
    return (h + p, v) if h else (None, None)


def test_hosts_paths_and_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)] + [(None, "http://x.org/", None), (3, URLS[3], "k")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "id long, bad boolean")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path = plain(URLS[r["page_id"]])
            rule, verdict = plain_rule(host, path)
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def brute_rules(taught, least, confidence, lift, most):
    n, bad = len(taught), sum(b for _, b in taught)
    counts = {}
    for tokens, b in taught:
        for k in range(1, most + 1):
            for c in combinations(sorted(tokens), k):
                x = counts.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += b
    rules = {c: b / k for c, (k, b) in counts.items() if b >= least and b / k >= confidence and b / k >= lift * bad / n}
    return {c for c in rules if not any(set(o) < set(c) and rules[o] >= rules[c] for o in rules)}


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    taught = []
    for _ in range(400):
        tokens = {f"t{i}" for i in rng.choice(9, 4, replace=False)}
        bad = bool(rng.random() < (0.8 if {"t1", "t2"} <= tokens else 0.9 if "t5" in tokens and "t7" in tokens else 0.15))
        taught.append((tokens, bad))
    rows = spark.createDataFrame([(sorted(t), b) for t, b in taught], "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(rows, min_support=0.02, min_count=5, min_confidence=0.6, min_lift=1.5).collect()
    want = brute_rules(taught, 8, 0.6, 1.5, 3)
    assert {tuple(r["tokens"]) for r in rules} == want and want
    for r in rules:
        holds = [b for t, b in taught if set(r["tokens"]) <= t]
        assert (r["n"], r["bad"]) == (len(holds), sum(holds))


def test_rules_of_more_than_three_tokens(spark):
    """Four tokens that are bad together while every part of them is mostly good; and a fifth that they need nowhere."""
    four = ("a", "b", "c", "d")
    taught = [({*four, f"x{i % 2}"}, True) for i in range(20)] + [({*four} - {t}, False) for t in four for _ in range(30)]
    taught += [({"z", *four}, False)] * 2 + [({"y"}, False)] * 60
    rows = spark.createDataFrame([(sorted(t), b) for t, b in taught], "tokens array<string>, bad boolean")
    rules = {tuple(r["tokens"]): (r["n"], r["bad"]) for r in url_rules.mine_rules(rows).collect()}
    assert set(rules) == brute_rules(taught, 5, 0.5, 1.5, 5) and rules[four] == (22, 20)


def test_rules_where_most_urls_are_bad(spark):
    taught = [({"a", "s"}, True)] * 80 + [({"b", "s"}, True)] * 10 + [({"b", "s"}, False)] * 20
    rows = spark.createDataFrame([(sorted(t), b) for t, b in taught], "tokens array<string>, bad boolean")
    assert [tuple(r["tokens"]) for r in url_rules.mine_rules(rows).collect()] == [("a",)]
    rows = rows.filter("bad")
    assert {tuple(r["tokens"]) for r in url_rules.mine_rules(rows).collect()} == {("a",), ("b",), ("s",)}


def test_rules_block_unlabelled_urls(spark):
    bad = [f"http://casino-win.example.net/en/{100 + i}" for i in range(40)]
    good = [f"http://news.example.net/en/{100 + i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 40) for i in range(0, 240, 2)] + [(1, True), (1, False), (None, True), (5, None)], "id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert all(v == ("block" if i < 40 else "allow") for i, v in got.items())


def test_no_pages(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([(1, True)], "id long, bad boolean")
    assert url_rules.judge(pages, labels).collect() == []


# --- nearest neighbours ---------------------------------------------------------------------


def exact(ids, vectors, query, k):
    d = np.sqrt(((vectors - vectors[ids == query][0])**2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    frame = table.toPandas()
    ids, vectors = frame.vec_id.to_numpy(), np.array(frame.embedding.tolist(), float)
    got = pstable.search(table, table.filter("vec_id % 10 = 0"), 10).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        want = exact(ids, vectors, q, 10)
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g.score.is_monotonic_increasing
        distance = dict(exact(ids, vectors, q, len(ids)))
        assert all(distance[v] == s for v, s in zip(g.vec_id, g.score))
        hits.append(len(set(g.vec_id) & {v for v, _ in want}) / 10)
    assert len(hits) == 50 and np.mean(hits) >= 0.9


def test_perturbations_come_in_order_of_success():
    from itertools import product

    rest = np.array([0.1, 0.45, 0.8])
    cost = lambda moves: sum((rest[j] if step < 0 else 1 - rest[j])**2 for j, step in moves)
    got = pstable.perturbations(rest, 26)
    every = [[(j, s) for j, s in enumerate(steps) if s] for steps in product((-1, 0, 1), repeat=3) if any(steps)]
    assert sorted(sorted(m) for m in got) == sorted(every)
    costs = [cost(m) for m in got]
    assert costs == sorted(costs)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 5.0]), (None, [1.0, 1.0]), (200, None), (9, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = pstable.search(table, table.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()
    far = float(np.sqrt(26.0))
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, far), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, far)]
    assert pstable.search(table.limit(0), table.limit(0), 10).collect() == []


def test_far_queries_are_answered_in_full(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 300)] + [(1000, (1000 * np.ones(8)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pstable.search(table, table.filter("vec_id = 1000"), 10).orderBy("rank").collect()
    vectors, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    assert [(r["vec_id"], r["score"]) for r in got] == exact(ids, vectors, 1000, 10)


def test_blocks_of_queries_agree(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = table.filter("vec_id % 100 = 0")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(pstable.search(table, queries, 3)) == show(pstable.search(table, queries, 3, block_bytes=1))


def test_repeated_rows_take_one_place(spark):
    """More than k copies of one id, in one batch and over several, and more than k other rows."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    others = [(i, (base + 0.1 * i * np.ones(8)).tolist()) for i in range(2, 40)]
    near = [(1, (base + 0.01 * (1 + c % 3)).tolist()) for c in range(30)]
    ids, vectors = np.array([0, 1, *(i for i, _ in others)]), np.array([base, base + 0.01, *(v for _, v in others)])
    want = exact(ids, vectors, 0, 5)
    for rows in ([(0, base.tolist()), *near, *others], [*near * 150, (0, base.tolist()), *others, *near * 150]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        for frame in (table, table.repartition(3)):
            got = pstable.search(frame, table.filter("vec_id = 0"), 5).orderBy("rank").collect()
            assert [(r["vec_id"], r["rank"]) for r in got] == [(v, i) for i, (v, _) in enumerate(want, 1)]
            assert np.allclose([r["score"] for r in got], [d for _, d in want])


def test_no_token_is_frequent_but_those_of_every_url(spark):
    """Ten URLs share all their frequent tokens, so nothing is left to mine."""
    pages = spark.createDataFrame([(i, f"http://a.com/{chr(97 + i) * 3}") for i in range(10)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 6) for i in range(10)], "id long, bad boolean")
    assert {r["verdict"] for r in url_rules.judge(pages, labels, given=[]).collect()} == {"allow"}


def test_mined_rules_fire_where_given_ones_taught_them(spark):
    from proofloom.llm import queries

    got = {r["page_id"]: r["verdict"] for r in queries.url_rules_learned(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    taught = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, pages.limit(0).selectExpr("page_id id", "false bad")).collect()}
    bad = {i for i, v in taught.items() if v == "block"}
    assert len(bad) > 10 and sum(got[i] == "block" for i in bad) > len(bad) / 2
