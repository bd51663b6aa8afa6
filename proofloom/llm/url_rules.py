"""URL filter by association rules, with DataFrame functions and Spark's FP-growth only.

A URL becomes a set of tokens: its words by part (scheme, host label, path
word, query word). FP-growth mines combinations that are frequent among the
labelled URLs; a combination whose URLs are bad with enough confidence, and
more often than URLs in general, becomes a rule. Rules are pruned when a part
of them is at least as confident. An inverted index holds every rule under its
rarest token, so a URL meets only the rules of its own tokens. Given rules on
host and path come first; the longest that fits decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

BAD = "label:bad"
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
#: Fixed rules (host, path, verdict) of the registered query.
GIVEN = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each with its part: scheme, host label, path word, query or fragment word.

    Numbers are one token per part and number of digits, so an id counts as a shape.
    """
    scheme = F.regexp_extract(url, r"^([A-Za-z]+)://", 1)
    tail = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^?#]*(.*)$", 1)
    words = lambda text, mark: F.transform(
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w)))
    return F.coalesce(F.array_distinct(F.concat(
        words(scheme, "s:"), words(F.regexp_replace(host_of(url), "-", " "), "h:"), words(path_of(url), "p:"), words(tail, "q:"))),
        F.array().cast("array<string>"))


def given_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "host string, path string, rule string, verdict string")


def given_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, nulls where none does; length is that of host and path together, ties go to the longer host.

    The rules are a short list of a person's making, so they are part of the expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (tokens, n, bad, confidence) from rows (tokens array, bad boolean).

    ``n`` URLs hold all tokens, ``bad`` of them are bad. Support counts bad
    URLs: at least ``min_support`` of all labelled URLs and ``min_count``. Tokens that are too
    rare for that are dropped before mining; combinations have any length. Confidence is at least ``min_lift`` times
    the share of bad URLs, or half-way from that share to 1 where this is less, so rules stay possible when most URLs are bad.
    A rule with a proper part that is at least as confident is dropped. Without labels there are no rules.
    """
    urls = cut_lineage(urls.select("tokens", "bad"))
    totals = urls.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    least = max(min_count, int(-(-n * min_support // 1)))
    none = urls.limit(0).select("tokens", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"), F.lit(0.0).alias("confidence"))
    if bad < least:
        return none
    # A rule's tokens are frequent among bad URLs, so only such tokens are mined.
    bound = max(min_confidence, min(min_lift * bad / n, (1 + bad / n) / 2))
    frequent = urls.filter("bad").select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= least).select("token")
    if bad / n < bound:  # a token of every URL is no rule then, and a set with it is no better than without
        every = urls.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") == n).select("token")
        frequent = frequent.join(every, "token", "left_anti")
    kept = cut_lineage(urls.withColumn("id", F.monotonically_increasing_id()))
    seen = kept.select("id", "bad", F.explode("tokens").alias("token")).join(broadcast_if_small(frequent), "token") \
        .groupBy("id", "bad").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    seen = cut_lineage(seen)
    items = seen.filter("bad").select(F.col("tokens").alias("items"))
    n_items = items.count()
    if n_items < least:  # no token is frequent
        return none
    grown = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_items, minConfidence=1.0,
                     numPartitions=items.sparkSession.sparkContext.defaultParallelism).fit(items).freqItemsets
    sets = grown.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad"))
    sets = cut_lineage(sets)
    # How often bad or not: every combination of a URL that is in the list of candidates is counted.
    counted = matches(_dealt(seen.select("id", "tokens")), sets).groupBy("rule").agg(F.count("*").alias("n"))
    sets = cut_lineage(sets.join(counted.withColumnRenamed("rule", "tokens"), "tokens").withColumn("confidence", F.col("bad") / F.col("n")))
    rules = sets.filter(F.col("confidence") >= bound)
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    # Every part of a frequent set is frequent, so the best confidence among all parts climbs one token at a time.
    below, kept = None, none
    for size in range(1, longest + 1):
        here = sets.filter(F.size("tokens") == size)
        if below is None:
            here = here.withColumn("parts", F.lit(-1.0))
        else:
            best = here.select("tokens", F.explode(_shorter()).alias("part")).join(below, "part").groupBy("tokens").agg(F.max("best").alias("parts"))
            here = here.join(best, "tokens")
        here = cut_lineage(here)
        kept = kept.unionByName(here.filter((F.col("confidence") >= bound) & (F.col("confidence") > F.col("parts"))).drop("parts"))
        below = here.select(F.col("tokens").alias("part"), F.greatest("confidence", "parts").alias("best"))
    return kept


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions by their id: a URL meets many rules, so few rows are much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def _shorter() -> Column:
    """The parts of the array ``tokens`` that lack one of its values."""
    return F.transform("tokens", lambda t: F.array_except(F.col("tokens"), F.array(t)))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (id, rule) for every rule all of whose tokens a row (id, tokens) holds.

    The inverted index names a rule under its token that is in fewest rules.
    """
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    index = rules.select("tokens", F.explode("tokens").alias("token")).join(uses, "token") \
        .groupBy("tokens").agg(F.min_by("token", F.struct("uses", "token")).alias("token")).withColumnRenamed("tokens", "rule")
    found = urls.select("id", "tokens", F.explode("tokens").alias("token")).join(broadcast_if_small(index), "token")
    return found.filter(F.size(F.array_except("rule", "tokens")) == 0).select("id", "rule")


def judge(pages: DataFrame, labels: DataFrame, given: list[tuple[str, str, str]] = GIVEN, **mining) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``labels`` has (id, bad). A given rule decides where one fits; else the
    URL is blocked when any mined rule matches it, and allowed otherwise.

    Null or broken URLs have empty host and path, no tokens, and are allowed
    unless a given rule fits. Ids that are null or have two different labels
    teach nothing; repeated rows get equal verdicts. No labels: no mined rules.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    sure = labels.select(F.col("id").cast("long").alias("id"), F.col("bad").cast("boolean").alias("bad")).filter("id IS NOT NULL AND bad IS NOT NULL") \
        .groupBy("id").agg(F.min("bad").alias("bad"), F.max("bad").alias("other")).filter("bad = other").drop("other")
    taught = pages.filter("url IS NOT NULL").select(F.col("page_id").cast("long").alias("id"), "url").distinct().join(sure, "id")
    rules = cut_lineage(mine_rules(taught.select(url_tokens(F.col("url")).alias("tokens"), "bad"), **mining))
    urls = pages.select("url").filter("url IS NOT NULL").distinct()
    blocked = matches(_dealt(urls.select(F.col("url").alias("id"))).select("id", url_tokens(F.col("id")).alias("tokens")), rules) \
        .select(F.col("id").alias("__url")).distinct()
    rule, verdict = given_verdict(F.col("host"), F.col("path"), given)
    return pages.join(blocked, F.col("url") == F.col("__url"), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("__url").isNotNull().alias("__hit")) \
        .select("page_id", "host", "path", rule.alias("rule"),
                F.coalesce(verdict, F.when(F.col("__hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
