"""Session defaults, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(app: str = "proofloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when they were read from too few files to fill them.

    Looks at the number of input partitions only; a large table stays where it
    is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, spread if it is small."""
    return spread(table(spark, sf_dir, name))


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for written stage tables.

    Only a local session may leave ``spark.checkpoint.dir`` unset; it gets a
    local folder. On a cluster such a folder would not be seen by all, so the
    setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a shared folder and read it back.

    Later stages start from the files, also after an executor is lost. A
    checkpoint would compute the rows twice, once to count and once to save.
    """
    folder = work_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def collect_if_small(df: DataFrame, max_rows: int) -> list | None:
    """All rows when there are at most ``max_rows`` of them, else ``None``.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` short rows.

    A larger side is left to a shuffled join. The count stops at the bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int,
          rank: str = "rank", pieces: int = 64) -> DataFrame:
    """First ``n`` rows of every group under a total order, with their rank.

    A hot group is cut twice: first inside ``pieces`` salted parts (Spark
    already drops rows beyond ``n`` before that shuffle), then as a whole, so
    the last window never sees more than ``pieces * n`` rows per group. Groups
    of known small size are ranked at once with ``pieces=1``.
    """
    if pieces == 1:
        small = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(small)).filter(F.col(rank) <= n)
    salt = "__salt"
    part = Window.partitionBy(*group, salt).orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(pieces)))
        .withColumn(rank, F.row_number().over(part))
        .filter(F.col(rank) <= n)
        .drop(rank, salt)
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= n)
    )
