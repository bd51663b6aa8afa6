"""Prefix trie of conversations from ternary search trees over range shards.

A conversation is a sequence of turns, named by the MD5 of role and text. Equal conversations are one class.
Classes are range-partitioned by their sequence, so all that share a prefix follow each other, and
cut into shards of at most ``SHARD`` classes or ``SHARD_TURNS`` turns. A shard encodes its turns by its own sorted dictionary and
builds a ternary search tree, inserting the middle sequence first and then the middles of
both halves, which keeps the alternatives of a turn balanced. Trees are traversed with a stack; on the way
back up every node gets its members, children, leaves and savings.

Only prefixes of a shard's first or last sequence can go on in other shards. These boundary nodes leave a shard as
partial sums without their own share, one path for the first and one for the last sequence. Merging adds the parts of a node;
its own leaf and savings, known only then, are credited to one path that holds it and summed up along that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARD, SHARD_TURNS = 4096, 1 << 20
CHUNK = 8192
NAME = 16  # bytes of a turn's name
GROUP, SHARED = 100, 6
EMPTY_ENDS = hashlib.sha256(b"").hexdigest()

CHUNKS = "name string, first long, n long, ids string, turns binary, sizes binary"
CLASSES = "name string, turns binary, sizes binary, n long, least long, ends string"
NODES = ("name string, parent string, path long, depth long, size long, least long, parent_least long, n_convs long, "
         "n_children long, n_leaves long, saved long, ends string, counts boolean")


class Class(NamedTuple):
    """A distinct conversation: names and sizes of its turns, members, smallest member, digest of the members' ids."""

    turns: np.ndarray
    sizes: np.ndarray
    n: int
    least: int
    ends: str


class Tree:
    """A ternary search tree: parallel lists of code, smaller, larger and next node; node 0 is the root of the trie."""

    def __init__(self):
        self.code, self.less, self.more, self.next = [-1], [0], [0], [0]
        self.depth, self.size, self.n, self.least, self.ends = [0], [0], [0], [None], [None]

    def _node(self, code: int, depth: int, size: int) -> int:
        for column, value in ((self.code, code), (self.less, 0), (self.more, 0), (self.next, 0), (self.depth, depth),
                              (self.size, size), (self.n, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], found: Class) -> None:
        at = 0
        self._count(at, found)
        for depth, (code, size) in enumerate(zip(codes, found.sizes.tolist()), 1):
            side, node = self.next, at
            while side[node]:
                node = side[node]
                if code == self.code[node]:
                    break
                side = self.less if code < self.code[node] else self.more
            else:
                side[node] = self._node(code, depth, size)
                node = side[node]
            at = node
            self._count(at, found)
        self.ends[at] = found.ends

    def _count(self, node: int, found: Class) -> None:
        self.n[node] += found.n
        if self.least[node] is None or found.least < self.least[node]:
            self.least[node] = found.least

    def children(self, node: int) -> list[int]:
        """Children in the order of their codes."""
        out, open_, at = [], [], self.next[node]
        while open_ or at:
            while at:
                open_.append(at)
                at = self.less[at]
            at = open_.pop()
            out.append(at)
            at = self.more[at]
        return out


def medians(n: int) -> Iterator[int]:
    """Places 0 to ``n - 1``: the middle, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        after = []
        for low, high in spans:
            middle = (low + high) // 2
            yield middle
            after += [(a, b) for a, b in ((low, middle), (middle + 1, high)) if a < b]
        spans = after


def prefix_names(turns: bytes, n: int) -> list[str]:
    """MD5 of the first 0, 1, ... ``n`` turns; that of all turns is the name of the class."""
    running, out = hashlib.md5(), [hashlib.md5().hexdigest()]
    for i in range(n):
        running.update(turns[NAME * i:NAME * (i + 1)])
        out.append(running.copy().hexdigest())
    return out


def shard_nodes(classes: list[Class], shard: int) -> list[tuple]:
    """Rows ``NODES`` of one shard, whose classes are sorted by their turns.

    Inner nodes are final but for the smallest member of a parent on the boundary. A boundary node's
    children, leaves and savings count inner nodes only. Where both paths hold a node, the
    second repeats its name without its counts.
    """
    flat = np.concatenate([c.turns for c in classes])
    codes = np.unique(flat, return_inverse=True)[1].tolist()
    ends = np.cumsum([0, *(len(c.turns) for c in classes)]).tolist()
    tree = Tree()
    for i in medians(len(classes)):
        tree.insert(codes[ends[i]:ends[i + 1]], classes[i])

    border: dict[int, str] = {}
    paths = []
    for i in (0, len(classes) - 1):
        names = prefix_names(classes[i].turns.tobytes(), len(classes[i].turns))
        at, path = 0, [0]
        for code in codes[ends[i]:ends[i + 1]]:
            at = tree.next[at]
            while tree.code[at] != code:
                at = tree.less[at] if code < tree.code[at] else tree.more[at]
            path.append(at)
        border.update(zip(path, names))
        paths.append(path)

    total = len(tree.code)
    kids, leaves, saved, inner = [0] * total, [0] * total, [0] * total, [0] * total
    parent = [-1] * total
    rows, stack = [], [(0, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            for child in tree.children(node):
                parent[child] = node
                kids[node] += 1
                stack.append((child, False))
            continue
        up = parent[node]
        if node not in border:
            leaves[node] += kids[node] == 0
            saved[node] += (tree.n[node] - 1) * tree.size[node]
            inner[up] += 1
            rows.append((None, border.get(up), None, tree.depth[node], tree.size[node], tree.least[node], None if up in border else tree.least[up],
                         tree.n[node], kids[node], leaves[node], saved[node], tree.ends[node], True))
        if up >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    seen: set[int] = set()
    for number, path in enumerate(paths):
        for node in path:
            new = node not in seen
            seen.add(node)
            rows.append((border[node], border.get(parent[node]), 2 * shard + number, tree.depth[node], tree.size[node], tree.least[node] if new else None, None,
                         *((tree.n[node], inner[node], leaves[node], saved[node], tree.ends[node]) if new else (0, 0, 0, 0, None)), new))
    return rows


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 9, pa.string(), pa.bool_()]
    names = [part.split()[0] for part in NODES.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _sharder(shard: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = _task_number() << 32, [], 0
        for batch in batches:
            for turns, sizes, n, least, ends in zip(*(batch.column(c).to_pylist() for c in ("turns", "sizes", "n", "least", "ends"))):
                held.append(Class(np.frombuffer(turns, f"S{NAME}"), np.frombuffer(sizes, np.int64), n, least, ends))
                size += len(held[-1].sizes)
                if len(held) == shard or size >= SHARD_TURNS:
                    yield _node_batch(shard_nodes(held, number))
                    number, held, size = number + 1, [], 0
        if held:
            yield _node_batch(shard_nodes(held, number))
    return task


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal conversations of one task, at most ``CHUNK`` in a row; only a class's first chunk carries its turns."""
    held: list[int] = []
    now, body = None, (None, None)
    rows: list[tuple] = []

    def close() -> None:
        if held:
            rows.append((now, held[0], len(held), ",".join(map(str, held)), *body))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "first", "n", "ids", "turns", "sizes"])

    for batch in batches:
        names, ids = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
        for i, (name, conv) in enumerate(zip(names, ids)):
            if name != now or len(held) == CHUNK:
                close()
                held, body = [], (None, None) if name == now else (batch.column("turns")[i].as_py(), np.array(batch.column("sizes")[i].as_py(), np.int64).tobytes())
                now = name
            held.append(conv)
        if len(rows) >= 1000:
            yield batch_of()
            rows = []
    close()
    if rows:
        yield batch_of()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class from its chunks in the order of their first ids; the digest runs over them."""
    now, body, n, least, running = None, (None, None), 0, 0, None
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "turns", "sizes", "n", "least", "ends"])

    for batch in batches:
        for name, first, size, ids, turns, sizes in zip(*(batch.column(c).to_pylist() for c in ("name", "first", "n", "ids", "turns", "sizes"))):
            if name != now:
                if running:
                    rows.append((now, *body, n, least, running.hexdigest()))
                now, body, n, least, running = name, (turns, sizes), 0, first, hashlib.sha256()
            running.update(("," if n else "").encode() + ids.encode())
            n += size
        if len(rows) >= 1000:
            yield batch_of()
            rows = []
    if running:
        rows.append((now, *body, n, least, running.hexdigest()))
    if rows:
        yield batch_of()


def turns(conversations: DataFrame, base: Column) -> DataFrame:
    """(base, conv_id, own): the turns of every conversation in order, (turn, name, size), partitioned by ranges of ``base``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"), F.length(text).cast("long").alias("size")) \
        .filter("conv_id IS NOT NULL").withColumn("base", base)
    return named.repartitionByRange("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "size"))).alias("own"))


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): every conversation as it stands."""
    return turns(conversations, F.col("conv_id")).select("conv_id", F.col("own").alias("seq"))


def branched(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """(conv_id, seq): every conversation's first turns replaced by those of the first one of its group of ids.

    Conversation c takes the first h turns of c - c % ``group`` (all if fewer, none if absent), then its own after its first h;
    h is the CRC of its id's text modulo ``shared``.
    """
    rows = turns(conversations, F.col("conv_id") - F.col("conv_id") % group)
    whole = Window.partitionBy("base")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, max(shared - 1, 1)))).over(whole)
    none = F.slice("own", 1, 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    return rows.withColumns({"head": F.coalesce(head, none), "h": h}).select(
        "conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("seq"))


def trie(sequences: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    ``sequences`` has (conv_id, seq) as ``own_turns`` and ``branched`` return it, one row per conversation. A node is a
    distinct sequence of the first ``depth`` turns of some conversation; conversations that start with it
    are its members, also those without turns at the root. ``conv_id`` is the smallest member, ``parent_conv_id`` that
    of the parent (null at the root). ``saved_tokens`` adds up, over the node and all below it, members but one times
    the code points of the last text. ``ends_sha256`` digests the ids, in order, of the members that end here.

    Null roles and texts are empty and null turns come first, turns of equal number by the MD5 of role and text; a repeated
    row is a turn of its own; rows without conv_id take no part; no rows give no nodes. A
    conversation is one row of 24 bytes per turn, however its texts are long.
    """
    rows = sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("seq", lambda s: s["name"]), "")).alias("turns"), F.transform("seq", lambda s: s["size"]).alias("sizes")) \
        .withColumn("name", F.md5("turns"))
    parts = rows.sortWithinPartitions("name", "conv_id").mapInArrow(_chunks, CHUNKS)
    classes = cut_lineage(parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_classes, CLASSES))
    nodes = cut_lineage(classes.repartitionByRange("turns").sortWithinPartitions("turns").mapInArrow(_sharder(shard), NODES))

    border = nodes.filter("path IS NOT NULL")
    sums = border.groupBy("name").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("least").alias("least"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.min("path").alias("owner"))
    below = sums.groupBy("parent").agg(F.count("*").alias("more")).filter("parent IS NOT NULL").withColumnRenamed("parent", "above")
    merged = cut_lineage(sums.join(below, sums["name"] == below["above"], "left").withColumn("n_children", F.col("inner") + F.coalesce("more", F.lit(0))).drop("above", "more"))
    credit = merged.select("name", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    up = Window.partitionBy("path").orderBy(F.desc("depth"))
    mine = lambda c: F.sum(F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)).over(up)
    lifted = border.select("path", "depth", "name").join(credit, "name").select("name", mine("leaf").alias("leaf"), mine("own").alias("own")) \
        .groupBy("name").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    above = merged.select(F.col("name").alias("above"), F.col("least").alias("above_least"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends = F.coalesce("ends", F.lit(EMPTY_ENDS)).alias("ends_sha256")
    on_border = merged.join(lifted, "name").join(above, F.col("parent") == F.col("above"), "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("above_least").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("own")).alias("saved_tokens"), ends)
    inside = nodes.filter("path IS NULL")
    inside = inside.join(above, F.col("parent") == F.col("above"), "left").select(
        F.col("least").alias("conv_id"), "depth", F.coalesce("parent_least", "above_least").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), ends)
    return on_border.select(*final).unionByName(inside.select(*final))
