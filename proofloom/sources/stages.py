"""Stage tables on Parquet: save, load, newest dated table, and which of them are out of date."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_stage(df: DataFrame, root: str, stage: str, project: str | None = None,
               date: str | None = None) -> str:
    """Write one stage; a project or date becomes a partition folder."""
    path = f"{root.rstrip('/')}/{stage}"
    keys = []
    if project is not None:
        df, keys = df.withColumn("project", F.lit(project)), ["project"]
    if date is not None:
        df, keys = df.withColumn("dt", F.lit(date)), [*keys, "dt"]
    writer = df.write.mode("overwrite")
    if keys:
        # only the partitions of this project and date are replaced
        writer = writer.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, stage: str, project: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root.rstrip('/')}/{stage}")
    return df if project is None else df.filter(F.col("project") == project)


def newest(df: DataFrame, date: str = "dt") -> DataFrame:
    """Rows of the newest date. On a partitioned table both sides prune folders."""
    last = df.agg(F.max(date).alias(date))
    return df.join(F.broadcast(last), date, "left_semi")  # one row by construction


class Stage(NamedTuple):
    """A stage by name, what it reads (source tables or earlier stages) and its settings."""

    name: str
    inputs: Sequence[str]
    settings: Mapping[str, object]


def table_fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever the order of its rows; repeated rows count."""
    parts = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)").alias("h")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor(F.col("h").cast("long")), F.lit(0)).alias("mixed")).first()
    return hashlib.sha256(json.dumps([df.schema.json(), *parts]).encode()).hexdigest()


def stage_fingerprints(stages: Sequence[Stage], sources: Mapping[str, str]) -> dict[str, str]:
    """What every stage's table depends on: its inputs' fingerprints, through all earlier stages, and its settings.

    ``sources`` holds the fingerprints of the tables that no stage makes; stages are given in order.
    """
    known = dict(sources)
    for stage in stages:
        body = [stage.name, [known[i] for i in stage.inputs], sorted((k, repr(v)) for k, v in stage.settings.items())]
        known[stage.name] = hashlib.sha256(json.dumps(body).encode()).hexdigest()
    return {s.name: known[s.name] for s in stages}


def mark_saved(spark: SparkSession, root: str, stage: str, fingerprint: str) -> None:
    """Note what a saved stage was made from. Written after its table, so a stage that broke off stays stale."""
    spark.createDataFrame([(stage, fingerprint)], "stage string, fingerprint string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{root.rstrip('/')}/_made/{stage}")


def stale_stages(spark: SparkSession, root: str, stages: Sequence[Stage], sources: Mapping[str, str]) -> list[str]:
    """Stages that must run again, in order: never saved, or made from other inputs or settings, or after one that is."""
    wanted = stage_fingerprints(stages, sources)
    out: list[str] = []
    for stage in stages:
        try:
            made = spark.read.parquet(f"{root.rstrip('/')}/_made/{stage.name}").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            made = None
        if made is None or made["fingerprint"] != wanted[stage.name] or any(i in out for i in stage.inputs):
            out.append(stage.name)
    return out
