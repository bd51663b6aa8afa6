"""The registered queries of the operators, on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import first_fit, line_crf, minhash, mixing, ordinal, packed_products, pstable, secrets, sharding, spaced_seeds, token_spans, turn_trie, url_rules


def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard of every document by the permutation-filled lookup table."""
    docs = table(spark, sf, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.shard_names()).select("doc_id", "slot", "shard")


def op2_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, merit=mixing.length_merit(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's URL; a page is bad when its label says quality 0."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"))
    return url_rules.judge(table(spark, sf, "pages"), labels)


def url_rules_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Operator 4 where rules must fire: pages that the given rules block are the bad ones, and mined rules alone judge all pages."""
    pages = table(spark, sf, "pages")
    labels = url_rules.judge(pages, pages.limit(0).selectExpr("page_id AS id", "false AS bad")).select(F.col("page_id").alias("id"), (F.col("verdict") == "block").alias("bad"))
    return url_rules.judge(pages, labels, given=[]).select("page_id", "host", "path", "verdict")


def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf, "embeddings")
    return pstable.search(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    return line_crf.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "n_lines", "n_good")


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return secrets.scan(table(spark, sf, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), "base_sha256", spans.alias("spans"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected toxicity of every document."""
    return ordinal.grade_by_labels(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return spaced_seeds.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per line of source, language and text of every document."""
    return token_spans.count_tokens(table(spark, sf, "documents"), ["source", "lang", "text"], "most")


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row's label is moved on by one."""
    label = F.col("label").cast("long")
    rows = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return packed_products.mine(rows, F.col("vec_id") % 100 == 0)


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix trie of all conversations, each branched from the first one of its hundred."""
    return turn_trie.trie(turn_trie.branched(table(spark, sf, "conversations")))


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return first_fit.pack(table(spark, sf, "documents"), first_fit.vocabulary_path())


QUERIES = {f.__name__: f for f in (op1_sharding, op2_near_dedup, op3_mixing, op4_url_filter, op5_nearest, op6_quality, op7_secrets,
                                   op8_toxicity, op9_decontamination, op10_token_counts, op11_hard_negatives, op12_conversation_trie, op13_packing, url_rules_learned)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, their exact similarity, and the smallest id over links.
OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
y AS (SELECT doc_id, i, n, concat_ws(' ', t, lead(t, 1) OVER v, lead(t, 2) OVER v, lead(t, 3) OVER v, lead(t, 4) OVER v) AS g
  FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM y WHERE i <= n - 4 OR (n < 5 AND i = 1)),
g AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN c ON a = doc_id"""

_HOST = _LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")


def _words_sql(text: str, mark: str) -> str:
    return (f"list_transform(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
            f"lambda w: '{mark}' || CASE WHEN regexp_full_match(w, '[0-9]+') THEN '#' || length(w) ELSE w END)")


def _given_sql() -> str:
    rows = sorted(url_rules.GIVEN, key=lambda r: -len(r[0] + r[1]))
    return "(VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows) + ") AS given(h, p, v)"


_URLS_SQL = rf"""u AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_distinct(list_concat(
      {_words_sql("regexp_extract(url, '^([A-Za-z]+)://', 1)", "s:")},
      {_words_sql("replace(" + _HOST + ", '-', ' ')", "h:")},
      {_words_sql("regexp_extract(url, '://[^/?#]*([^?#]*)', 1)", "p:")},
      {_words_sql("regexp_extract(url, '://[^?#]*(.*)$', 1)", "q:")}))) AS t
  FROM pages)"""
_GIVEN_SQL = f"""SELECT h, p, v FROM {_given_sql()} WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  ORDER BY length(h) + length(p) DESC, length(h) DESC LIMIT 1"""

#: Every combination of up to three tokens of the labelled URLs is counted; no mining.
OP4_SQL = rf"""
WITH {_URLS_SQL},
taught AS (SELECT DISTINCT page_id, url, t, quality = 0 AS bad FROM u JOIN labels ON page_id = doc_id),
total AS (SELECT count(*) AS n, count(*) FILTER (bad) AS b, greatest({url_rules.MIN_COUNT}, ceil(count(*) * {url_rules.MIN_SUPPORT})) AS least FROM taught),
x AS (SELECT page_id, url, bad, t, unnest(t) AS a FROM taught),
y AS (SELECT *, unnest(t) AS b FROM x),
c AS (
  SELECT page_id, url, bad, [a] AS k FROM x UNION ALL
  SELECT page_id, url, bad, [a, b] FROM y WHERE a < b UNION ALL
  SELECT page_id, url, bad, [a, b, d] FROM (SELECT *, unnest(t) AS d FROM y WHERE a < b) WHERE b < d),
k AS (SELECT k, count(*) AS n, count(*) FILTER (bad) AS bad FROM c GROUP BY k),
r AS (SELECT k, n, bad / n AS confidence FROM k WHERE bad >= (SELECT least FROM total)
  AND bad / n >= {url_rules.MIN_CONFIDENCE} AND bad / n >= {url_rules.MIN_LIFT} * (SELECT b / n FROM total)),
pruned AS (SELECT k FROM r WHERE NOT EXISTS (
  SELECT 1 FROM r o WHERE o.k <> r.k AND list_has_all(r.k, o.k) AND o.confidence >= r.confidence)),
hit AS (SELECT DISTINCT url FROM u WHERE EXISTS (SELECT 1 FROM pruned WHERE list_has_all(u.t, pruned.k)))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, g.h || g.p AS "rule",
  coalesce(g.v, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit USING (url) LEFT JOIN LATERAL ({_GIVEN_SQL}) g ON true"""

#: Every combination of any length of the tokens that are frequent in bad URLs, by the bits of its number.
LEARNED_SQL = rf"""
WITH {_URLS_SQL},
taught AS (SELECT DISTINCT page_id, url, t, coalesce(g.v, '') = 'block' AS bad FROM u LEFT JOIN LATERAL ({_GIVEN_SQL}) g ON true WHERE url IS NOT NULL),
total AS (SELECT count(*) AS n, count(*) FILTER (bad) AS b, greatest({url_rules.MIN_COUNT}, ceil(count(*) * {url_rules.MIN_SUPPORT})) AS least,
  greatest({url_rules.MIN_CONFIDENCE}, least({url_rules.MIN_LIFT} * b / n, (1 + b / n) / 2)) AS bound FROM taught),
often AS (SELECT list(a) AS often FROM (SELECT a FROM (SELECT unnest(t) AS a FROM taught WHERE bad) GROUP BY a HAVING count(*) >= (SELECT least FROM total))),
x AS (SELECT page_id, bad, list_filter(t, lambda a: list_contains(often, a)) AS t FROM taught, often),
c AS (SELECT bad, list_filter(t, lambda a, i: (m >> (i - 1)) & 1 = 1) AS k FROM (SELECT *, unnest(range(1, 1 << len(t))) AS m FROM x)),
k AS (SELECT k, count(*) AS n, count(*) FILTER (bad) AS bad FROM c GROUP BY k),
r AS (SELECT k, k.bad / k.n AS confidence FROM k, total WHERE k.bad >= least AND k.bad / k.n >= bound),
pruned AS (SELECT k FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.k <> r.k AND list_has_all(r.k, o.k) AND o.confidence >= r.confidence)),
hit AS (SELECT DISTINCT url FROM u WHERE EXISTS (SELECT 1 FROM pruned WHERE list_has_all(u.t, pruned.k)))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN hit USING (url)"""

def _seeds_sql(table: str, key: str) -> str:
    """Rows (key, mask, place, seed) of all windows; a seed joins the words that the mask looks at."""
    parts = []
    for number, mask in enumerate(spaced_seeds.MASKS):
        looked = ", ".join(f"w[i + {j}]" for j, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, {number} AS m, i, array_to_string([{looked}], ' ') AS seed FROM "
                     f"(SELECT *, unnest(range(1, len(w) - {spaced_seeds.SPAN - 2})) AS i FROM {table})")
    return " UNION ALL ".join(parts)


#: Seeds joined as strings, then every diagonal word by word. All given items have at least as many words as a mask.
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS ({_seeds_sql("d", "doc_id")}),
bs AS ({_seeds_sql("b", "item_id")}),
c AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
k AS (SELECT doc_id, item_id, shift, b.w AS bw, d.w AS dw, least({spaced_seeds.WINDOW}, len(b.w)) AS width,
  unnest(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1)) AS k, least(len(b.w), len(d.w) - shift) AS last
  FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
a AS (SELECT doc_id, item_id, shift, width, k, last, sum(CAST(bw[k] = dw[k + shift] AS INTEGER)) OVER (
  PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS agree FROM k)
SELECT doc_id, item_id, CAST(k + shift - 1 AS INTEGER) AS start, CAST(k + shift - 1 + width AS INTEGER) AS "end",
  CAST(width AS INTEGER) AS n_words, CAST(agree AS INTEGER) AS n_agree
FROM a WHERE k + width - 1 <= last AND agree >= {spaced_seeds.AGREE} * width
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, k + shift) = 1"""

#: Integer inner products of all anchors with all rows, ranked twice.
OP11_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({packed_products.SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {packed_products.POSITIVES}),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS "rank"
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND {packed_products.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {packed_products.HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST("rank" AS INTEGER) AS "rank", negative_id, positive_score, negative_score
FROM n WHERE "rank" <= {packed_products.NEGATIVES}"""

_CRC_BITS = "list_reduce(list_prepend({x}, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"

#: Every prefix of every branched conversation as a list; subtrees by joining each prefix to those it starts.
OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % {turn_trie.GROUP} AS base, CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))),
    lambda c, d: {_CRC_BITS.format(x="xor(c, d)")}), 4294967295) % {turn_trie.SHARED} AS INTEGER) AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
x AS (SELECT conv_id, depth, s[1:depth] AS p, len(s) = depth AS e, CASE WHEN depth > 0 THEN length(s[depth].text) ELSE 0 END AS size FROM m),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e), '')) AS ends FROM x GROUP BY p, depth),
k AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS k FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN k USING (p, depth)),
u AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM f),
z AS (SELECT p[1:d] AS p, d AS depth, sum(CAST(k = 0 AS BIGINT)) AS leaves, sum((n - 1) * size) AS saved FROM u GROUP BY 1, 2)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN z USING (p, depth) LEFT JOIN f a ON a.depth = f.depth - 1 AND a.p = f.p[1:f.depth - 1]"""

ORACLE = {"op2_near_dedup": OP2_SQL, "op4_url_filter": OP4_SQL, "url_rules_learned": LEARNED_SQL, "op9_decontamination": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_conversation_trie": OP12_SQL}
