import hashlib

import pytest
from pyspark.sql import functions as F

from proofloom.llm import mixing, sharding

from . import helpers

SF = "/root/testdata/sf0.001"


def slow_table(shards, slots):
    """Every shard writes down its whole order; turns go round until all slots are claimed."""
    orders = []
    for name in shards:
        code = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(code[:15], 16) % slots, int(code[15:30], 16) % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 31), (7, 211)])
def test_lookup_table_equals_brute_force(n, slots):
    names = sharding.shard_names(n)
    assert sharding.lookup_table(names, slots).tolist() == slow_table(names, slots)


def test_table_is_even_and_stable():
    names = sharding.shard_names(16)
    table = sharding.lookup_table(names, 4099)
    sizes = [int((table == i).sum()) for i in range(16)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.lookup_table(names[:-1], 4099)
    assert ((table != fewer) & (table != 15)).mean() < 0.1


def test_parameters_are_checked():
    for shards, slots in ((["a"], 10), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_every_document_is_placed_by_its_key(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    names, slots = sharding.shard_names(), sharding.SLOTS
    owner = sharding.lookup_table(names, slots)
    for r in sharding.place(docs, "doc_id", names).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % slots
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])


def test_odd_rows_are_placed(spark):
    docs = spark.createDataFrame([(*r, 5) for r in helpers.odd_documents()], helpers.DOCS + ", shard int")
    out = sharding.place(docs, "doc_id", sharding.shard_names(3), 101)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["shard"] for r in rows) and set(out.columns) == {*docs.columns, "slot"}
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.place(docs.limit(0), "doc_id", sharding.shard_names(3), 101).collect() == []


def want_targets(sizes, weights, cap=3.0):
    """Share by weight, stop full sources, share the excess again until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight >= cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100, 100], [10, 5000, 1, 700, 30], [0, 0, 9], [5], [1, 1, 1, 10_000, 20_000, 3]])
def test_targets_share_the_excess(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    out = mixing.targets(mixing.cyclic_weights(spark.createDataFrame(rows, "source string, source_size long"))).orderBy("source").collect()
    weights = [mixing.CYCLE[i % 3] for i in range(len(sizes))]
    assert [r["weight"] for r in out] == weights
    assert [r["target"] for r in out] == pytest.approx(want_targets(sizes, weights))


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, mixing.mix(docs, merit=mixing.length_merit(F.col("text"))).toPandas()


def test_mix_follows_its_targets(mixed):
    docs, got = mixed
    assert len(got) == docs.count() and (got["size"] == [len(helpers.words(t)) for t in got.text]).all()
    names = sorted(got.source.unique())
    sizes = [int(got[got.source == s]["size"].sum()) for s in names]
    want = dict(zip(names, want_targets(sizes, [mixing.CYCLE[i % 3] for i in range(len(names))])))
    for source, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[source]) and g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - want[source]) <= max(0.1 * want[source], 50)  # ten documents a source
    assert (got.taken <= 3 * got["size"]).all() and (got.taken[got["size"] > 0] % got["size"][got["size"] > 0] == 0).all()


def test_reruns_agree_in_any_order(spark, mixed):
    docs, got = mixed
    again = mixing.mix(docs.repartition(5, "text"), merit=mixing.length_merit(F.col("text"))).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_pareto_order_equals_plain_ranking(spark):
    """The cut found from bucket totals is that of a full sort; one document at most changes side per source."""
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    merit = 1 + F.col("doc_id") % 3
    got = {r["doc_id"]: r for r in mixing.mix(docs, merit=merit).collect()}
    plan = {r["source"]: r for r in mixing.source_plan(docs, merit=merit).collect()}
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing._uniform(F.col("doc_id"), F.col("text"), 20).alias("u")).collect()}
    for source, p in plan.items():
        expected, drawn = 0.0, []
        for i, text, s in rows:
            if s == source:
                e = round(min(3.0, p["scale"] * (1 + i % 3)), 9)
                expected += e * (i % 37 + 1)
                part = e - int(e)
                if part > 0:
                    drawn.append(((u[i] / (1 - u[i])) / (part / (1 - part)), i, int(e)))
        assert expected == pytest.approx(p["target"], rel=1e-6)
        room = p["target"] - sum(int(round(min(3.0, p["scale"] * (1 + i % 3)), 9)) * (i % 37 + 1) for i, _, s in rows if s == source)
        chosen, run = set(), 0
        for q, i, whole in sorted(drawn):
            size = i % 37 + 1
            if run + size / 2 > room:
                break
            run += size
            chosen.add(i)
        real = {i for _, i, whole in drawn if got[i]["taken"] > whole * (i % 37 + 1)}
        assert len(chosen ^ real) <= mixing.MAX_TURNS
        assert abs(sum(got[i]["taken"] for i, _, s in rows if s == source) - p["target"]) <= mixing.NEAR * p["target"] + 37  # 37 words: the longest text


def test_odd_rows_and_names(spark):
    rows = helpers.odd_documents()
    names = ", merit string, u string, v int, p int, scale int, copies int, size string, taken string, stop int"
    docs = spark.createDataFrame([(*r, "m", "u", 1, 2, 3, 4, "s", "t", 5) for r in rows], helpers.DOCS + names)
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows) and all(r["merit"] == "m" and r["v"] == 1 and r["copies"] == 4 for r in got)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    nulls = [r for r in got if r["source"] is None]
    assert len({r["target"] for r in nulls}) == 1 and nulls[0]["source_size"] == sum(r["size"] for r in nulls)
    repeated = mixing.repeat_taken(out)
    assert repeated.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix(docs.limit(0)).collect() == []
