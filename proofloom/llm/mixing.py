"""Mixing sources to target weights by Pareto order sampling.

Every source has a target, in words. A document of merit ``m`` is expected
``e = min(3, c * m)`` times, with ``c`` solved per source so that expected
words meet the target. The whole part of ``e`` is taken for certain. The rest,
``p``, is the inclusion probability of one more copy: the document gets a
ranking value ``q = [u / (1 - u)] / [p / (1 - p)]`` from its own random ``u``, and
the smallest ``q`` are taken until the words left for the source are
used up (a fixed-size sample in words).

No source is sorted. The cut in the ranking is found from word totals per
(source, bucket of q), then per finer bucket inside the bucket that holds the
cut, then among the few values left; the final pass compares every row with its
source's cut. Where a source still misses its target by over ``NEAR``, up to ``MAX_TURNS`` of its
documents change side, each the one that closes the gap best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import cut_lineage

MAX_COPIES = 3
BUCKETS = 4096
MERIT_STEPS = 16
CYCLE = (5.0, 2.0, 1.0)
NEAR, MAX_TURNS = 0.005, 8


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_merit(text: Column) -> Column:
    """A merit that grows with the logarithm of the words: fragments get lower odds than articles."""
    return F.log2(1 + word_count(text)) / 8


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight`` by place of the source in code-point order, null last, repeating ``cycle``."""
    ranked = global_rank(sources, [], [F.col("source").asc_nulls_last()], "__place")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.col("__place") - 1) % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("__place")


def targets(sources: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight): shares of all words by weight.

    A source stops at ``max_copies`` times its size; what it leaves is shared
    again by weight until no source is above. Only the common level (words per
    weight) comes to the driver; it rises from round to round, and a source
    that is full stays full, so the rounds end.
    """
    cap = F.lit(float(max_copies)) * F.col("source_size")
    level = -1.0
    while True:
        full = (F.lit(level) * F.col("weight") >= cap) & F.lit(level >= 0)
        sums = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("full"),
                           F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not sums["open"]:
            return sources.withColumn("target", cap)
        new = (sums["all"] - (sums["full"] or 0.0)) / sums["open"]
        if new <= level:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        level = new


def _merit(merit: Column | None) -> Column:
    """Merit in sixteenths between 1/16 and 16, so a source has 256 values at most; null counts as 1."""
    if merit is None:
        return F.lit(1.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(256.0), F.round(F.coalesce(merit.cast("double"), F.lit(1.0)) * MERIT_STEPS))) / MERIT_STEPS


def _uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, or from the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def _source_scales(classes: DataFrame, max_copies: int) -> DataFrame:
    """Per source the factor ``c`` at which expected words meet the target.

    ``classes`` has (source, merit, words, target). With the largest merits
    first, a running sum gives the factor for every number of full classes.
    """
    above = Window.partitionBy("source").orderBy(F.col("merit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.col("merit").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scale = (F.col("target") - F.coalesce(F.sum(max_copies * F.col("words")).over(above), F.lit(0))) / F.sum(F.col("merit") * F.col("words")).over(rest)
    tried = classes.filter("words > 0").withColumn("scale", scale).filter(F.col("scale") * F.col("merit") <= max_copies * (1 + 1e-12))
    return tried.groupBy("source").agg(F.max_by("scale", "merit").alias("scale"))


def _ranked(rows: DataFrame, max_copies: int) -> DataFrame:
    """Adds whole copies and, as ``v`` in [0, 1), the rank ``q / (1 + q)``; ``v`` is null where nothing is left to draw.

    Taking documents whole makes a copy count of 2.9999999999 out of 3, so expectations are rounded at nine decimals.
    """
    expected = F.round(F.least(F.lit(float(max_copies)), F.coalesce("scale", F.lit(0.0)) * F.col("merit")), 9)
    rows = rows.withColumn("copies", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("v", F.when((F.col("p") > 0) & (F.col("size") > 0), q / (1 + q)))


def _crossing(totals: DataFrame, at: str) -> DataFrame:
    """Per source the first bucket in which the running words pass what is left; ``before`` are the words ahead of it."""
    w = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = totals.withColumn("run", F.sum("words").over(w))
    return run.filter("run > room").groupBy("source").agg(
        F.min_by(F.struct(at, (F.col("run") - F.col("words")).alias("before")), at).alias("x")).select("source", f"x.{at}", "x.before")


def source_plan(docs: DataFrame, weights=cyclic_weights, merit: Column | None = None, max_copies: int = MAX_COPIES, seed: int = 20) -> DataFrame:
    """One row per source: source_size, target, scale, the cut in the ranking and the values that change side."""
    narrow = cut_lineage(docs.select(
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _merit(merit).alias("merit"),
        _uniform(F.col("doc_id"), F.col("text"), seed).alias("u")))
    classes = cut_lineage(narrow.groupBy("source", "merit").agg(F.sum("size").alias("words")))
    sources = targets(cut_lineage(weights(classes.groupBy("source").agg(F.sum("words").alias("source_size")))), max_copies)
    scales = _source_scales(_with(classes, sources, "target"), max_copies)
    plan = cut_lineage(_with(sources, scales, "scale"))
    ranked = _ranked(_with(narrow, plan, "target", "scale"), max_copies)
    coarse = F.floor(F.col("v") * BUCKETS).cast("int")
    fine = F.floor(F.col("v") * (BUCKETS * BUCKETS)).cast("int") % BUCKETS
    certain = cut_lineage(ranked.groupBy("source", coarse.alias("b")).agg(
        F.sum(F.col("copies") * F.col("size")).alias("sure"), F.sum(F.when(F.col("v").isNotNull(), F.col("size"))).alias("words")))
    room = plan.select("source", "target", "scale").join(certain.groupBy("source").agg(F.sum("sure").alias("sure")).withColumnRenamed("source", "__s"),
                                                        F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s") \
        .withColumn("room", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("sure", F.lit(0))))
    room = cut_lineage(room)
    first = cut_lineage(_crossing(_with(certain.filter("b IS NOT NULL"), room, "room"), "b"))
    inside = _with(ranked, first, "b", "before").filter(coarse == F.col("b"))
    second = cut_lineage(inside.groupBy("source", fine.alias("f"), "v").agg(F.sum("size").alias("words"), F.max("before").alias("before")))
    ahead = _with(second.groupBy("source", "f").agg(F.sum("words").alias("words"), F.max("before").alias("ahead")), room, "room") \
        .withColumn("room", F.col("room") - F.col("ahead"))
    at = _crossing(ahead, "f").withColumnsRenamed({"f": "f_at", "before": "f_before"})
    values = _with(_with(second, at, "f_at", "f_before").filter("f = f_at"), room, "room") \
        .withColumn("room", F.col("room") - F.col("before") - F.col("f_before"))
    w = Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The value that crosses is taken when at least half of its words still fit.
    cut = values.withColumn("run", F.sum("words").over(w)).filter(F.col("run") - F.col("words") / 2 > F.col("room")) \
        .groupBy("source").agg(F.min("v").alias("stop"))
    # Where every value of the crossing bucket fits, the first value of a later bucket is the stop.
    edge = at.join(first.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select(
        "source", ((F.col("b") * BUCKETS + F.col("f_at") + 1) / float(BUCKETS * BUCKETS)).alias("edge"))
    out = _with(_with(_with(plan, room, "room"), cut, "stop"), edge, "edge")
    stops = cut_lineage(out.withColumn("stop", F.coalesce("stop", "edge")).select("source", "source_size", "target", "scale", "room", "stop"))
    # Long documents at the cut can leave a gap: documents whose change of side closes it best change side, one a round.
    drawn = _with(ranked.filter("v IS NOT NULL").select("source", "v", "size"), stops, "stop")
    ahead = F.col("stop").isNull() | (F.col("v") < F.col("stop"))
    drawn = cut_lineage(drawn.select("source", "v", "size", ahead.alias("ahead")))
    words = drawn.filter("ahead").groupBy("source").agg(F.sum("size").alias("words"))
    gaps = cut_lineage(_with(stops, words, "words").select(
        "source", "target", (F.col("room") - F.coalesce("words", F.lit(0))).alias("gap"), F.array().cast("array<double>").alias("turned")))
    for _ in range(MAX_TURNS):
        wide = gaps.filter(F.abs("gap") > NEAR * F.col("target"))
        inside = F.col("ahead") != F.array_contains("turned", F.col("v"))
        change = F.when(inside, -F.col("size")).otherwise(F.col("size"))
        off = F.col("gap") - change
        turned = _with(drawn, wide, "gap", "turned").filter(F.abs(off) < F.abs("gap")).groupBy("source").agg(
            F.min(F.struct(F.abs(off).alias("off"), "v", off.alias("left"))).alias("t")).select("source", F.col("t.v").alias("more"), "t.left")
        turned = cut_lineage(turned)
        if turned.isEmpty():
            break
        gaps = cut_lineage(_with(gaps, turned, "more", "left").select("source", "target", F.coalesce("left", "gap").alias("gap"), F.when(
            F.col("more").isNull(), F.col("turned")).otherwise(F.array_append("turned", F.col("more"))).alias("turned")))
    return cut_lineage(_with(stops, gaps, "turned").select("source", "source_size", "target", "scale", "stop", "turned"))


def _with(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
    """Left join on the source, null meeting null."""
    side = other.select(F.col("source").alias("__s"), *columns)
    return rows.join(side, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def mix(docs: DataFrame, weights=cyclic_weights, merit: Column | None = None, max_copies: int = MAX_COPIES, seed: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken.

    ``taken`` is the number of words the mix takes of the document, a multiple of
    its size up to ``max_copies`` times. Reruns agree: the random numbers are
    hashes of the ids. ``weights`` turns rows (source, source_size) into
    rows with a ``weight`` > 0 more; ``merit`` tilts the odds inside a source.

    A null or empty text has size 0 and is taken 0 times; a null source is a source
    of its own; rows with equal id are taken together; rows without id go
    by their text; an empty table gives no rows. Existing columns named like the new
    ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    plan = source_plan(docs, weights, merit, max_copies, seed).withColumnRenamed("source", "__source")
    # The row travels as one value, so no column of the caller meets one of ours.
    rows = docs.select(
        F.struct(*docs.columns).alias("__row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        _merit(merit).alias("merit"), _uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    joined = _ranked(rows.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left"), max_copies)
    ahead = F.col("stop").isNull() | (F.col("v") < F.col("stop"))
    one_more = F.col("v").isNotNull() & (ahead != F.coalesce(F.array_contains("turned", F.col("v")), F.lit(False)))
    taken = (F.col("copies") + F.when(one_more, 1).otherwise(0)) * F.col("size")
    return joined.select("__row.*", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
                         F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was taken, without the columns of ``mix``."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    return mixed.filter(times > 0).select(*columns, F.explode(F.sequence(F.lit(1), times)).alias("__copy")).drop("__copy")
