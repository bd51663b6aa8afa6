import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofloom.llm import first_fit, packed_products, queries, turn_trie

from . import helpers

VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"


# --- hard negatives ------------------------------------------------------------------------------


def plain_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """All inner products with Python integers."""
    best = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(256 * x) for x in e):
            continue
        best[i] = min(best.get(i, (str(label), e)), (str(label), e))
    v = {i: (label, [math.floor(256 * x) for x in e]) for i, (label, e) in best.items()}
    bound = lambda s: max(-2**63, min(2**63 - 1, s))
    dot = lambda a, b: bound(sum(x * y for x, y in zip(a, b)))
    out = set()
    for a in filter(anchor, v):
        scored = sorted((-dot(v[a][1], v[b][1]), b) for b in v if b != a)
        for p, positive in [x for x in scored if v[x[1]][0] == v[a][0]][:positives]:
            rest = [x for x in scored if v[x[1]][0] != v[a][0] and low * -p <= 100 * -x[0] <= high * -p]
            out |= {(a, positive, r, n, -p, -s) for r, (s, n) in enumerate(rest[:negatives], 1)}
    return out


def mined(df, **kw):
    got = [tuple(r) for r in packed_products.mine(df, F.col("vec_id") % 5 == 0, **kw).collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("scale", [1, 40, 1e4, 1e9, 1e20])
def test_fields_hold_exact_scores(scale):
    rng = np.random.default_rng(3)
    c, a = (np.floor(rng.normal(size=(n, 13)) * scale) for n in (77, 9))
    got = np.zeros((77, 9), np.int64)
    for here, score in packed_products.products(c, a):
        got[here] = score
    want = [[max(-2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, q)))) for q in a] for r in c]
    assert got.tolist() == want


def test_two_candidates_share_a_product_of_unit_vectors():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None])
    assert [len(h) for h, _ in packed_products.products(v, v[:3])] == [100, 100]


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_negatives_equal_all_products(spark, block_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), (centres[i % 4] + rng.normal(size=6)).tolist(), int(i % 3)) for i in range(-20, 150)]
    got = mined(spark.createDataFrame(rows, VECTORS).repartition(5), block_rows=block_rows)
    assert got == plain_negatives(rows, lambda i: i % 5 == 0) and len(got) > 500


def test_copies_of_one_vector_keep_their_order(spark):
    """Most rows are one vector, so every list is decided by ids."""
    rng = np.random.default_rng(6)
    hot = [0.5, -0.25, 0.125]
    rows = [(int(i), hot if i % 3 else rng.normal(size=3).tolist(), int(i % 2)) for i in rng.permutation(300)]
    rows += [(1000 + i, [0.4, -0.2, 0.1], 7) for i in range(40)]
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(3)) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [9.0, 9.0], 2), (6, [1.0, 2.5], 1), (7, [1.0, 1.0], 2), (8, [0.9, 1.0], 2), (9, None, 1), (10, [1.0, None], 1),
            (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (13, [1.0, 1.0], None), (14, [], 2), (15, [], 1), (16, [1.0, 1.0, 50.0], 2),
            (20, [1e20, -1e20], 1), (21, [1e20, 0.0], 1), (22, [1e6, 0.0], 3), (25, [0.0, 0.0], 1), (26, [1e308, 0.0], 3), (30, [-1.0, -1.0], 4)]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], VECTORS + ", score long, anchor_id string")
    assert mined(df) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(df.limit(0)) == set()
    assert mined(df.filter("vec_id = 5")) == set()


# --- conversation trie ----------------------------------------------------------------------------


def plain_sequences(rows, branched=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, name, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    if not branched:
        return own
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    return out


def plain_trie(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    for p, found in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = {q for q in below if len(q) == len(p) + 1}
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in found if len(sequences[c]) == len(p)))
        out.add((min(found), len(p), min(members[p[:-1]]) if p else None, len(found), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df, **kw):
    got = [tuple(r) for r in turn_trie.trie(df, **kw).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def talks(seed, n=130):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 420), n):
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"]) if turn < 7 else f"{rng.randrange(50)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [4096, 9, 1])
def test_trie_equals_all_prefixes(spark, shard):
    rows = talks(shard)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_rows(turn_trie.branched(df), shard=shard) == plain_trie(plain_sequences(rows))
    assert trie_rows(turn_trie.own_turns(df), shard=shard) == plain_trie(plain_sequences(rows, False))


def test_one_conversation_held_by_many(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4 if c % 3 else 6)]
    assert trie_rows(turn_trie.own_turns(spark.createDataFrame(rows, TURNS).repartition(7)), shard=2) == plain_trie(plain_sequences(rows, False))


def test_chunks_of_ids_digest_alike():
    ids = list(range(7, 7 + 3 * turn_trie.CHUNK, 1))
    batch = pa.record_batch([pa.array(ids), pa.array(["n"] * len(ids)), pa.array([b"t" * 16] * len(ids)), pa.array([[3]] * len(ids))], ["conv_id", "name", "turns", "sizes"])
    row = next(turn_trie._classes(turn_trie._chunks(iter([batch.slice(0, 5000), batch.slice(5000)])))).to_pylist()
    assert len(row) == 1 and row[0]["n"] == len(ids) and row[0]["least"] == 7
    assert row[0]["ends"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None), (None, 0, "user", "x"), (100, 3, "b", "é漢"), (100, 3, "a", "x" * 100_000),
            (101, 0, "1:", "a"), (102, 0, "1", ":a"), (-7, 1, "user", "x"), (-100, 1, "user", "y"), (205, 0, "only", "turn")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", name string, base int")
    assert trie_rows(turn_trie.branched(df)) == plain_trie(plain_sequences(rows))
    assert any(not s for s in plain_sequences(rows).values())  # a conversation without turns is a member of the root
    assert trie_rows(turn_trie.branched(df.limit(0))) == set()


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{min(t, 2000 + c)}") for c in (1, 2) for t in range(3000)]
    got = trie_rows(turn_trie.own_turns(spark.createDataFrame(rows, TURNS)), shard=1)
    assert len(got) == 1 + 2002 + 2 * 998 and {r[3] for r in got if r[1] <= 2002} == {2}


def test_median_insertion_keeps_alternatives_balanced():
    classes = [turn_trie.Class(np.array([i.to_bytes(16, "big")], "S16"), np.array([1]), 1, i, "") for i in range(1, 1024)]
    tree = turn_trie.Tree()
    for i in turn_trie.medians(len(classes)):
        tree.insert([i], classes[i])
    depth, level = 0, [tree.next[0]]
    while level:
        depth, level = depth + 1, [k for n in level for k in (tree.less[n], tree.more[n]) if k]
    assert depth == 10 and sorted(turn_trie.medians(77)) == list(range(77))


# --- packing -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(first_fit.vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return first_fit.Encoder(open(first_fit.vocabulary_path(), "rb").read(), remembered=2000)


def check_packing(rows, got, tokenizer, capacity=2048):
    """Every id of every document once, sequences gapless, full or a power of two."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r["length"] for r in got) == sum(len(x) for v in texts.values() for x in v)
    places, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        places[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        bodies = [x for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in bodies) and r["length"] > 0
    for doc, pieces in places.items():
        want, have = defaultdict(int), defaultdict(int)
        for x in texts[doc]:
            for k in range(len(x)):
                want[len(x), k] += 1
        for r in pieces:
            for k in range(r["start"], r["start"] + r["length"]):
                have[r["doc_tokens"], k] += 1
        assert want == have
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_packing_of_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (first_fit.GROUP_BYTES, 40_000):
        got = first_fit.pack(docs, first_fit.vocabulary_path(), group_bytes=size).collect()
        check_packing(rows, got, tokenizer)
    cuts = sum(r["length"] < r["doc_tokens"] for r in got)
    assert cuts < len(got)


def test_packing_of_odd_rows(spark, tokenizer):
    rows = helpers.odd_documents()
    docs = spark.createDataFrame([(*r, 3) for r in rows], helpers.DOCS + ", part int")
    check_packing([r[:2] for r in rows], first_fit.pack(docs, first_fit.vocabulary_path()).collect(), tokenizer)
    assert first_fit.pack(docs.limit(0), first_fit.vocabulary_path()).collect() == []


def test_words_encode_like_texts(encoder, tokenizer):
    rng = random.Random(2)
    special = ["don't", "it's 42", "<|endoftext|>", "ÀÉß×÷ÿ", "ﬁ", "é", "́a", "İI", "Σας ΣΑΣ", "漢字かな", "👍🏽ok", "a b", "x\x1cy", " ", "\x85", "'S'll", "##!?", "½²", "\x00", "ａｂ"]
    for _ in range(300):
        text = "".join(rng.choice([*special, "word", "Word,", "été", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(1, 30)))
        assert encoder.texts(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_latin_letter_and_sign(encoder, tokenizer):
    for c in [*range(1, 0x180), *range(0x2000, 0x2070)]:
        text = f"a{chr(c)}b 1{chr(c)} {chr(c)}'S {chr(c)}{chr(c)}x"
        assert encoder.texts(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, c


def test_long_texts_are_encoded_in_stretches(encoder, tokenizer, monkeypatch):
    text = helpers.prose(3000) + " " * 5000 + "é" * 3000 + "\n" * 3000 + helpers.prose(500, 9)
    monkeypatch.setattr(first_fit, "_CUT", 1000)
    assert first_fit._long_text(encoder, pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for run in (" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000):
        assert len(first_fit._long_text(encoder, pa.array([run]))[0]) in (0, 125_000, 250_000, 500_000, 1_000_000) or run[0] == "x"


def plain_first_fit(sizes, capacity):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b in range(len(bins)) if room[b] >= sizes[i]), len(bins))
        if at == len(bins):
            bins.append([])
            room.append(capacity)
        bins[at].append(i)
        room[at] -= sizes[i]
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_tournament_is_first_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 50, 100, rng.randrange(1, 101)]) for _ in range(rng.randrange(0, 200))]
    assert first_fit.first_fit(sizes, 100) == plain_first_fit(sizes, 100)


@pytest.mark.parametrize("seed", range(20))
def test_groups_hold_every_token_once_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 5, 100, 700, 2047, 2048, 2049, 5000, rng.randrange(1, 3000)]) for _ in range(rng.randrange(0, 60))]
    held = defaultdict(list)
    for sequence in first_fit.pack_group(lengths):
        n = sum(x[2] for x in sequence)
        assert n == 2048 or n & (n - 1) == 0
        for doc, start, length in sequence:
            held[doc].append((start, start + length))
    for doc, n in enumerate(lengths):
        spans = sorted(held[doc])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
