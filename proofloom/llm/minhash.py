"""Near-duplicate groups: one-permutation MinHash, bands, star edges, exact checks.

1. One pass hashes every word shingle once. The range of the hash is cut into
   ``BINS`` equal bins; a text's signature is its smallest hash per bin. An
   empty bin borrows from the full bin that comes first in the empty bin's own
   fixed random order (optimal densification). ``BANDS`` groups of ``ROWS``
   bins give the bucket keys.
2. Texts with equal shingle sets form a class; only its smallest id goes on.
3. Every bucket links its members to one centre, picked by a hash of (id,
   bucket): as many edges as members. Edges are checked on full sets, and the
   true ones give a first partition.
4. Star edges alone can miss a link between two members of a bucket when
   neither is its centre. So every bucket whose members still lie in several
   components is compared in full, block by block: members of its largest
   component meet only the others, so rows are bounded by (members x blocks
   of the others) and (others x blocks), a task holds two blocks, and only
   links that join components leave it. Buckets that lie in one component, which is what large
   groups of copies come to, cost nothing here.

A pair at similarity 0.75 shares no bucket with probability
(1 - 0.75 ** ROWS) ** BANDS = 0.0003, one at 0.8 with 0.000003.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import words
from .components import components

BINS, BANDS, ROWS = 256, 42, 6
PERCENT = 75
BLOCK = 128
HOT_SHARE = 1000

_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
#: Row i: place of every bin in the order in which empty bin i looks for a full one.
_ORDER = np.argsort(np.argsort(words.mix(words.seeds(BINS * BINS, 11)).reshape(BINS, BINS), axis=1), axis=1).astype(np.uint8)
_ROW_MULTIPLIERS = words.seeds(ROWS, 13)
_BAND_SALT = words.seeds(BANDS, 17)

SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
SETS = "doc_id long, d1 long, d2 long, shingles array<long>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash per bin of a sorted, non-empty set, with empty bins filled."""
    at = np.searchsorted(shingles, _EDGES)
    has = np.diff(at, append=len(shingles)) > 0
    out = np.empty(BINS, np.uint64)
    full = np.flatnonzero(has)
    out[full] = shingles[at[full]]
    if len(full) < BINS:
        empty = np.flatnonzero(~has)
        out[empty] = out[full[_ORDER[empty][:, full].argmin(axis=1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys, one row per signature; the band is part of the key."""
    parts = signatures[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS) * _ROW_MULTIPLIERS
    return words.mix(words.mix(parts.sum(axis=2)) + _BAND_SALT)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    return int(shingles.sum()), int(words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum())


def _lists(flat: np.ndarray, lengths: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(words.signed(flat), pa.int64()))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            sizes, digests, found = [], [], []
            for shingles in words.shingle_sets(texts):
                sizes.append(len(shingles))
                digests.append(digest(shingles) if len(shingles) else (None, None))
                if len(shingles):
                    found.append(signature(shingles))
            keys = band_keys(np.array(found)) if found else np.zeros((0, BANDS), np.uint64)
            named = [pa.array(words.signed(np.array([d[i] or 0 for d in digests], np.uint64)),
                              mask=np.array([d[i] is None for d in digests])) for i in (0, 1)]
            yield pa.record_batch(
                [batch.column("doc_id").slice(at, len(texts)).cast(pa.int64()), pa.array(sizes, pa.int64()), *named,
                 _lists(keys.ravel(), [BANDS if n else 0 for n in sizes])],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            found = list(words.shingle_sets(texts))
            digests = [digest(s) for s in found]
            yield pa.record_batch(
                [batch.column("doc_id").slice(at, len(texts)).cast(pa.int64()),
                 *(pa.array(words.signed(np.array([d[i] for d in digests], np.uint64))) for i in (0, 1)),
                 _lists(np.concatenate(found), [len(s) for s in found])],
                ["doc_id", "d1", "d2", "shingles"])


def linked(members: list[np.ndarray], component: np.ndarray, block: np.ndarray, sides: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of linked members of two blocks, only as many as join their components.

    Intersections of all sets come from one matrix of shared shingles, counted
    in column pieces. Pairs inside one component, or inside a block that
    belongs to another task, are left out.
    """
    n = len(members)
    sizes = np.array([len(m) for m in members], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n))
    for low in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((n, 8192), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    good = (100 * common >= PERCENT * union) & (component[:, None] != component[None, :])
    if sides[0] != sides[1]:
        good &= block[:, None] != block[None, :]
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in np.argwhere(np.triu(good, 1)).tolist():
        a, b = top(int(component[i])), top(int(component[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of block pairs whose rows follow each other; a pair may cross batches."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        ids = np.array([h[1] for h in held], np.int64)
        found = linked([h[4] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held]), held[0][0][1:])
        return pa.record_batch([pa.array(ids[[i for i, _ in found]], pa.int64()), pa.array(ids[[j for _, j in found]], pa.int64())], ["a", "b"])

    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")))
        sets = batch.column("shingles")
        for i, (name, node, component, block) in enumerate(zip(names, *(batch.column(c).to_pylist() for c in ("node", "component", "block")))):
            if held and held[0][0] != name:
                if len(held) > 1:
                    yield done()
                held = []
            held.append((name, node, component, block, sets[i].values.to_numpy().copy()))
    if len(held) > 1:
        yield done()


def _fits(a: str, b: str) -> F.Column:
    """Sizes that still allow the similarity."""
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _meet(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``rows`` with the values of their key, if there are any; ``values`` has one row per key.

    Keys of over a thousandth of all rows, fewer than a thousand, are sent to the rows; the others
    meet them in a join, none of whose keys has more rows than that.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n"))
    many = (rows.count() // HOT_SHARE) + 1
    hot = F.broadcast(cut_lineage(sizes.filter(F.col("__n") > many).join(values, key, "left").drop("__n")))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(values, key, "left"))


def _deal(placed: DataFrame) -> DataFrame:
    """Rows (key, low, high, node, component, block): the block pairs of buckets whose members (key, node, component) lie in several components.

    Members of a bucket's largest component meet the others only, never each other, so rows grow with the others.
    """
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main")) \
        .filter("parts > 1").select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("own"), F.ceil((F.col("all") - F.col("n")) / BLOCK).cast("int").alias("rest"))
    of_main = F.col("component") == F.col("main")
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks).cast("long")).cast("int")
    blocks = placed.join(open_keys, "key").withColumn("block", F.when(of_main, F.col("rest") + place("own")).otherwise(place("rest")))
    return blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(of_main, 0).otherwise(F.col("own")) - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component", "block")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, (d1, d2, n, component_id, k1, k2) of all classes of equal sets).

    ``component_id`` is the smallest doc_id that a class reaches, (``k1``, ``k2``) the set that it stands for there.
    Nodes are classes, numbered as they are written, so different texts under one doc_id are different nodes.
    """
    signed = cut_lineage(docs.mapInArrow(_signatures, SIGNATURES))
    with_id = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")

    classes = cut_lineage(with_id.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
                          .withColumn("node", F.monotonically_increasing_id()))
    leads = classes.select(F.col("d1").alias("l1"), F.col("d2").alias("l2"), "least", "node")
    lead = (F.col("doc_id") == F.col("least")) & (F.col("d1") == F.col("l1")) & (F.col("d2") == F.col("l2"))
    members = with_id.join(leads, lead).select("node", "n_shingles", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("centre"), F.col("n_shingles").alias("size"))).alias("c"),
        F.max("node").alias("most"), F.min("node").alias("least")).filter("most > least").select("key", "c.centre", "c.size")
    shared = cut_lineage(members.join(buckets, "key"))

    stars = cut_lineage(shared.filter(F.col("node") != F.col("centre")).filter(_fits("n_shingles", "size")).select(
        F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct())
    busy = leads.join(shared.select("node").distinct(), "node", "left_semi")
    sets = docs.join(busy.select("least").distinct(), F.col("doc_id") == F.col("least"), "left_semi").mapInArrow(_sets, SETS)
    sets = cut_lineage(sets.join(busy, lead).select("node", "shingles").dropDuplicates(["node"]))

    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    links = stars.join(left, "a").join(right, "b").filter(
        F.lit(100) * both >= F.lit(PERCENT) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")
    first = cut_lineage(components(links, "a", "b"))

    placed = cut_lineage(shared.join(first, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")).distinct())
    pairs = _deal(placed).join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = pairs.mapInArrow(_block_links, "a long, b long")

    top = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"top_{c}"))
    second = components(more.join(top("a"), "a", "left").join(top("b"), "b", "left").select(
        F.coalesce("top_a", "a").alias("a"), F.coalesce("top_b", "b").alias("b")), "a", "b") \
        .select(F.col("node").alias("component"), F.col("component").alias("above"))
    # a node of the second round that is no component of the first is a class on its own
    alone = second.join(first.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("above").alias("top"))
    tops = cut_lineage(_meet(first, "component", second).select("node", F.coalesce("above", "component").alias("top")).unionByName(alone))
    linked_classes = cut_lineage(classes.join(tops, "node"))
    heads = linked_classes.groupBy("top").agg(F.min(F.struct("least", "d1", "d2")).alias("head"))
    joined = _meet(linked_classes, "top", heads).select("node", F.col("head.least").alias("component_id"), F.col("head.d1").alias("k1"), F.col("head.d2").alias("k2"))
    last = classes.join(joined, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("k1", "d1").alias("k1"), F.coalesce("k2", "d2").alias("k2"))
    return signed, cut_lineage(last)


def _with_component(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, d1, d2, component_id, k1, k2): every row with what its class reached.

    Classes that hold over a thousandth of all rows, fewer than a thousand, are sent to the rows; the others
    meet them in a join, none of whose keys has more rows than that. Rows without a set join nothing.
    """
    rows = signed.select("doc_id", "n_shingles", "d1", "d2")
    alone = rows.filter("doc_id IS NULL OR d1 IS NULL").select("*", F.col("doc_id").alias("component_id"), F.col("d1").alias("k1"), F.col("d2").alias("k2"))
    rest = rows.filter("doc_id IS NOT NULL AND d1 IS NOT NULL")
    many = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // HOT_SHARE
    found = ["component_id", "k1", "k2"]
    hot = F.broadcast(classes.filter(F.col("n") > many).select("d1", "d2", *found))
    out = rest.join(hot, ["d1", "d2"]).select(*rows.columns, *found)
    cold = rest.join(hot, ["d1", "d2"], "left_anti").join(classes.filter(F.col("n") <= many).select("d1", "d2", *found), ["d1", "d2"])
    return alone.unionByName(out).unionByName(cold.select(*rows.columns, *found))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two texts are linked when their sets of distinct five-word shingles have a
    Jaccard similarity of at least 0.75. ``component_id`` is the smallest
    doc_id a document reaches over links, ``kept`` is true for that document.

    A null or wordless text has no shingles and no links. A row without doc_id
    has no component (null) and is kept. Repeated rows share id and component.
    Different texts under one id are judged each by its own set. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_component(*_classes(docs)).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in words.slices(batch.column("text")):
            named = [digest(s) if len(s) else (None, None) for s in words.shingle_sets(texts)]
            ids = [pa.array(words.signed(np.array([d[i] or 0 for d in named], np.uint64)), mask=np.array([d[i] is None for d in named])) for i in (0, 1)]
            yield pa.record_batch([batch.column("row").slice(at, len(texts)), *ids], ["row", "d1", "d2"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest doc_id; all columns stay.

    Each row is judged by its own text: of different texts under one id, those without a near duplicate stay.
    Rows without doc_id stay. Of rows that repeat a doc_id and its set of shingles one stays.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, classes = _classes(plain)
    sets = F.struct("d1", "d2")
    # ids with one set are judged by id; only the rows of ids with several sets need theirs beside them
    mixed = cut_lineage(signed.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min(sets).alias("lo"), F.max(sets).alias("hi"))
                        .filter("lo <> hi").select("__id"))
    gone = cut_lineage(_with_component(signed, classes).filter("doc_id <> component_id OR d1 <> k1 OR d2 <> k2")
                       .select(F.col("doc_id").alias("__id"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2")).distinct())
    known = docs.filter("doc_id IS NOT NULL")
    own = known["doc_id"].cast("long") == F.col("__id")
    single = known.join(gone.select("__id").unionByName(mixed), own, "left_anti").dropDuplicates(["doc_id"])
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    several = known.join(mixed, own, "left_semi").select(row, F.col("text").cast("string").alias("text"))
    named = several.mapInArrow(_digests, T.StructType([several.schema["row"], T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])) \
        .withColumn("id", F.col("row.doc_id").cast("long"))
    its = (F.col("id") == F.col("__id")) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))
    kept = named.join(gone, its, "left_anti").dropDuplicates(["id", "d1", "d2"]).select("row.*")
    return single.unionByName(kept).unionByName(docs.filter("doc_id IS NULL"))
