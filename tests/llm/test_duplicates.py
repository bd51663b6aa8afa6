import random

import numpy as np
import pyarrow as pa
import pytest

from proofloom.llm import minhash, words
from proofloom.llm.components import components

from . import helpers

SF = "/root/testdata/sf0.001"


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_word_hashes_follow_the_bytes():
    texts = ["One two\tTHREE", "", "two", " ", "Émile émile", "one"]
    w = words.words(pa.array(texts))
    per_text = [w.hash[a:b].tolist() for a, b in zip(w.first, w.first[1:])]
    assert [len(p) for p in per_text] == [len(helpers.words(t)) for t in texts]
    assert per_text[0][1] == per_text[2][0] and per_text[0][0] == per_text[5][0]
    assert per_text[4][0] != per_text[4][1]  # only A-Z are lower-cased


@pytest.mark.parametrize("seed", range(3))
def test_shingle_sets_have_the_right_sizes(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(60)]
    assert [len(s) for s in words.shingle_sets(pa.array(texts))] == [len(helpers.shingles(t)) for t in texts]


def test_slices_cover_all_texts_whatever_their_length():
    texts = pa.array(["a" * 10, None, "b" * (words.SLICE_BYTES + 5), "", "c"])
    assert [(at, len(part)) for at, part in words.slices(texts)] == [(0, 2), (2, 1), (3, 2)]


def test_densification_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (4, 40, 4000):
        hits = []
        for _ in range(40):
            shared, rest = rng.integers(0, 2**63, n * 3 // 4, np.uint64), rng.integers(0, 2**63, n - n * 3 // 4, np.uint64)
            a, b = np.unique(words.mix(np.concatenate([shared, rest]))), np.unique(words.mix(shared))
            hits.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(hits) - 0.75) < 0.06


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(minhash.near_duplicates(docs)) == helpers.near_duplicates(rows)


def test_hot_group_of_border_cases_loses_no_link(spark):
    """Copies of one text with random changes: many pairs lie close to the threshold, centres miss some."""
    rng = random.Random(5)
    base = helpers.prose(120).split()
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    want = helpers.near_duplicates(rows)
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({c for _, c in want.values()}) > 1


def test_threshold_is_inclusive(spark):
    base = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:10])), (3, " ".join(base[:9])), (4, "p q r s t u v w"), (5, "p q r s t u v")]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == helpers.near_duplicates(rows)


def test_odd_rows(spark):
    rows = helpers.odd_documents()
    docs = spark.createDataFrame([(*r, "x") for r in rows], helpers.DOCS + ", component_id string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = helpers.near_duplicates([(r[0], r[1]) for r in rows if r[0] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert kept.filter("doc_id IS NULL").count() == 2


def test_different_texts_under_one_id(spark):
    rows = [(1, helpers.prose(50)), (1, helpers.prose(50, 900)), (2, helpers.prose(50)), (3, helpers.prose(50, 900))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_rows_are_dropped_by_their_own_text(spark):
    a, b, c = helpers.prose(50), helpers.prose(50, 900), helpers.prose(60, 2000)
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (4, c), (4, c), (5, None), (5, None), (5, a), (None, a), (7, c + " x"), (7, c + " y")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, [(1, a), (2, b), (4, c), (5, None), (None, a)]))


def test_near_texts_under_one_smallest_id(spark):
    a = helpers.prose(60)
    kept = minhash.drop_near_duplicates(spark.createDataFrame([(1, a), (1, a + " x"), (2, a + " y")], "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_hot_classes_meet_their_rows(spark, monkeypatch):
    """Both ways to give a row its component, within one table."""
    monkeypatch.setattr(minhash, "HOT_SHARE", 10)
    rows = [(i, helpers.prose(40) if i % 3 == 0 else helpers.prose(40, 50 * (i // 4))) for i in range(1, 121)] + [(500, None), (None, "x")]
    got = found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IS NOT NULL"))
    assert got == helpers.near_duplicates([r for r in rows if r[0] is not None])


def test_empty_table(spark):
    docs = spark.createDataFrame([], helpers.DOCS)
    assert minhash.near_duplicates(docs).collect() == [] and minhash.drop_near_duplicates(docs).collect() == []


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == helpers.components(nodes, [e for e in edges if e[0] != e[1]])


def test_members_of_one_component_do_not_meet_again(spark):
    from proofloom.llm.minhash import BLOCK, _deal

    sizes = {1: 3 * BLOCK, 2: BLOCK // 2, 3: 2}
    rows = [(7, 1000 * c + i, c) for c, n in sizes.items() for i in range(n)] + [(8, i, 1) for i in range(9)]
    got = _deal(spark.createDataFrame(rows, "key long, node long, component long")).collect()
    assert {r.key for r in got} == {7} and len(got) <= sizes[1] + (sizes[2] + sizes[3]) * 4
    meet = {}
    for r in got:
        meet.setdefault((r.low, r.high), []).append(r)
    pairs = {frozenset((a.node, b.node)) for side in meet.values() for a in side for b in side if a.component < b.component and (a.block != b.block or a.block == side[0].low == side[0].high)}
    assert pairs == {frozenset((a, b)) for _, a, c in rows[:-9] for _, b, d in rows[:-9] if c < d}
