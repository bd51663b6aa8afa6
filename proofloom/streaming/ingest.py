"""Incremental ingest: only new or changed content is processed.

Keys of processed content lie in a table of their own, in folders by the first characters of the
key, so a batch reads the folders of its own keys and nothing else. What is made of a document, such as sections, chunks and
vectors, is written as one table each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key
from ..session import cut_lineage

BATCH = "ingest_batch"
PREFIX = 1  # characters of a key that name its folder; more for tables whose batches are small beside them


def read_documents(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                   max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def new_content(batch: DataFrame, seen: DataFrame | None, text: str = "text",
                key: str = "content_key") -> DataFrame:
    """One row per content hash that ``seen`` does not hold yet."""
    keyed = batch.withColumn(key, content_key(text)).dropDuplicates([key])
    return keyed if seen is None else keyed.join(seen.select(key), key, "left_anti")


def ingest(stream: DataFrame, target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame | dict[str, DataFrame]],
           text: str = "text", key: str = "content_key", path: str | None = None):
    """Process unseen content of every micro-batch and append it to ``target``.

    A batch writes its own partitions, named by checkpoint and batch number, and
    overwrites them when replayed: a restart after a lost driver or executor
    neither loses nor doubles rows, and a second stream with a checkpoint of
    its own adds only what is new. ``process`` must keep the key column; it returns one
    table, or several by name, each of which goes to ``target/name``. Keys are noted last, so content
    whose tables were not all written counts as unseen.

    Given the name of a ``path`` column, every path of the batch is noted with the
    key of its content in ``path_table(target)``, also where the content is known:
    equal files share what was processed, and none is lost.
    """
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = f"{source}-{batch_id}"
        keyed = cut_lineage(new_content(batch, None, text, key))
        seen = seen_keys(keyed, target, own, key)
        fresh = keyed if seen is None else cut_lineage(keyed.join(seen, key, "left_anti"))
        made = process(fresh)
        for name, rows in (made if isinstance(made, dict) else {"": made}).items():
            rows.write.mode("overwrite").parquet(f"{target}/{name}/{BATCH}={own}" if name else f"{target}/{BATCH}={own}")
        if path:
            batch.select(path, content_key(text).alias(key), F.current_timestamp().alias("ingested_at")).write.mode(
                "overwrite").parquet(f"{path_table(target)}/{BATCH}={own}")
        fresh.select(key, F.substring(key, 1, PREFIX).alias("prefix"), F.lit(own).alias(BATCH)).repartition("prefix").write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, "prefix").parquet(key_table(target))

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def key_table(target: str) -> str:
    return f"{target.rstrip('/')}_keys"


def seen_keys(keyed: DataFrame, target: str, own: str, key: str = "content_key") -> DataFrame | None:
    """Keys of other batches, from the folders of the prefixes that ``keyed`` has; at most 16 ** PREFIX of them are named."""
    try:
        known = keyed.sparkSession.read.option("basePath", key_table(target)).parquet(key_table(target))
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    opened = [r["p"] for r in keyed.select(F.substring(key, 1, PREFIX).alias("p")).distinct().collect()]
    return known.filter((F.col(BATCH) != own) & F.col("prefix").cast("string").isin(opened)).select(key).distinct()


def path_table(target: str) -> str:
    return f"{target.rstrip('/')}_paths"


def newest_keys(spark: SparkSession, target: str, path: str, key: str = "content_key") -> DataFrame:
    """(path, key): the content that every path has now."""
    noted = spark.read.option("basePath", path_table(target)).parquet(path_table(target))
    return noted.groupBy(path).agg(F.max_by(key, F.struct("ingested_at", BATCH)).alias(key))


def output(spark: SparkSession, target: str, name: str = "") -> DataFrame:
    """One of the tables that ``process`` made."""
    folder = f"{target.rstrip('/')}/{name}".rstrip("/")
    return spark.read.option("basePath", folder).parquet(folder).drop(BATCH)


def current(spark: SparkSession, target: str, path: str, key: str = "content_key", name: str = "") -> DataFrame:
    """What was processed of every path's newest content; a changed file replaces its rows, an equal one shares them."""
    return newest_keys(spark, target, path, key).join(output(spark, target, name), key, "left")


def retired(spark: SparkSession, target: str, path: str, key: str = "content_key", name: str = "") -> DataFrame:
    """Rows of content that no path has any more: what a clean-up may drop."""
    return output(spark, target, name).join(newest_keys(spark, target, path, key).select(key).distinct(), key, "left_anti")
