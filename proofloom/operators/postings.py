"""BM25 from stored postings: an inverted index at rest, and exact searches that skip what cannot win.

``build`` reads the texts once. Its tables lie in one folder: the vocabulary with document
frequencies, corpus totals, and the postings. Documents are dealt to ranges of about ``RANGE_DOCS``
by a hash; a block holds a token's postings of one range, with the largest share among them.
Blocks lie in folders by a hash of their token, so a search opens the folders of its tokens only.

``search`` adds up, per query and range, the largest gains that the range can give, scores the few best ranges in
full, and then only the ranges whose bound reaches the n-th score found so far. No text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import col
from ..session import cut_lineage, top_n, work_folder
from .lexical import DIGITS, Tokenizer, inverse_frequency, query_terms, words

RANGE_DOCS = 512
BUCKETS = 64
SLOTS = 8        # files of a bucket, each with its own ranges
FIRST_RANGES = 4  # ranges scored before the others are judged


class Index(NamedTuple):
    """``vocabulary`` (token, df, idf), ``stats`` (docs, avg_length), ``blocks`` (bucket, token, range, top, postings)."""

    vocabulary: DataFrame
    stats: DataFrame
    blocks: DataFrame


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) to (doc_id, token, tf, length, lead): one row per distinct token of a document, one of them leading."""
    for batch in batches:
        lists = batch.column(1)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pc.dictionary_encode(lists.flatten())
        width = max(len(named.dictionary), 1)
        doc = np.repeat(np.arange(batch.num_rows), lengths)
        cell, tf = np.unique(doc * width + named.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc, token = cell // width, cell % width
        lead = np.ones(len(doc), bool)
        lead[1:] = doc[1:] != doc[:-1]
        yield pa.record_batch([batch.column(0).take(pa.array(doc)), named.dictionary.take(pa.array(token)), pa.array(tf.astype(np.int32)),
                               pa.array(lengths[doc].astype(np.int32)), pa.array(lead)], ["doc_id", "token", "tf", "length", "lead"])


def _bucket(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, doc_id: str, text: str = "text", tokenizer: Tokenizer = words, folder: str | None = None,
          k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, range_docs: int = RANGE_DOCS) -> Index:
    """Write the index of a document table, by default to a new work folder, and return it.

    Documents without text or tokens are not in it; ids are taken as they are, one row per id.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark)
    tokens = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokenizer(text).alias("tokens"))
    shape = T.StructType([tokens.schema["doc_id"], *T.StructType.fromDDL("token string, tf int, length int, lead boolean").fields])
    counts = cut_lineage(tokens.mapInArrow(_counts, shape))

    n = F.count_if("lead")
    counts.agg(n.alias("docs"), (F.sum(F.when(F.col("lead"), F.col("length"))) / F.nullif(n, F.lit(0))).alias("avg_length")) \
        .write.mode("overwrite").parquet(f"{folder}/stats")
    stats = spark.read.parquet(f"{folder}/stats")
    inverse_frequency(counts.groupBy("token").agg(F.count("*").alias("df")), stats).write.mode("overwrite").parquet(f"{folder}/vocabulary")

    total = stats.first()
    ranges = max(1, -(-total["docs"] // range_docs))
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(total["avg_length"] or 1.0)))
    dealt = counts.select("doc_id", "token", share.alias("share"), _bucket("token").alias("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).alias("range")) \
        .withColumn("slot", F.pmod("range", F.lit(SLOTS)))
    # placed once, by bucket and slot: blocks are made and written where their postings meet
    blocks = dealt.repartition("bucket", "slot").groupBy("bucket", "slot", "token", "range").agg(
        F.max("share").alias("top"), F.collect_list(F.struct("doc_id", "share")).alias("postings")).drop("slot")
    blocks.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/blocks")
    return load(spark, folder, shape["doc_id"].dataType)


def load(spark: SparkSession, folder: str, id_type: T.DataType) -> Index:
    """The index that lies in a folder."""
    posting = T.StructType([T.StructField("doc_id", id_type), T.StructField("share", T.DoubleType())])
    blocks = T.StructType([T.StructField("token", T.StringType()), T.StructField("range", T.LongType()), T.StructField("top", T.DoubleType()),
                           T.StructField("postings", T.ArrayType(posting)), T.StructField("bucket", T.IntegerType())])
    return Index(spark.read.schema("token string, df long, idf double").parquet(f"{folder}/vocabulary"),
                 spark.read.schema("docs long, avg_length double").parquet(f"{folder}/stats"), spark.read.schema(blocks).parquet(f"{folder}/blocks"))


def _scored(wanted: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, doc_id, score) of all documents in the wanted (query, range) pairs that hold a token of the query."""
    parts = wanted.join(terms, "query").join(blocks, ["token", "range"]).select("query", "gain", F.explode("postings").alias("p"))
    total = F.sum(F.col("p.share") * F.col("gain"))
    return parts.groupBy("query", F.col("p.doc_id").alias("doc_id")).agg(
        (F.floor(total * 10.0**DIGITS + 0.5) / 10.0**DIGITS).alias("score")).filter("score > 0")


def search(index: Index, queries: DataFrame, query_id: str, doc_id: str, n: int = fixed.BM25_TOP, query_text: str = "text",
           tokenizer: Tokenizer = words, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """Best ``n`` documents of every query: (query_id, doc_id, score, rank), as :func:`lexical.search` gives them.

    Ranks follow the rounded score, then the id; documents without a matching token, or with a score of
    zero or less, are no hits.
    """
    asked = query_terms(queries, query_id, query_text, tokenizer)
    terms = cut_lineage(asked.join(index.vocabulary, "token").select(
        F.col(query_id).alias("query"), "token", (F.col("qtf") * F.col("idf")).alias("gain"), _bucket("token").alias("bucket")))
    opened = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS values
    blocks = index.blocks.filter(F.col("bucket").isin(opened))
    terms = terms.drop("bucket")

    most = F.sum(F.greatest("gain", F.lit(0.0)) * F.col("top"))
    bounds = cut_lineage(terms.join(blocks.select("token", "range", "top"), "token").groupBy("query", "range").agg((most * (1 + 1e-9) + 10.0**-DIGITS).alias("bound")))
    first = top_n(bounds, ["query"], [F.desc("bound"), F.asc("range")], first_ranges, pieces=1).select("query", "range")
    order = [F.desc("score"), F.asc("doc_id")]
    seen = top_n(_scored(first, terms, blocks), ["query"], order, n)
    reached = seen.filter(F.col("rank") == n).select("query", F.col("score").alias("least"))
    left = bounds.join(reached, "query", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0))).select("query", "range")
    return top_n(_scored(left, terms, blocks), ["query"], order, n).select(F.col("query").alias(query_id), F.col("doc_id").alias(doc_id), "score", "rank")
