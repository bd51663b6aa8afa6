"""Run progress folded from a step log, as a batch and as a stream.

Events: (run_id, event_id, ts, stage, status, current, total).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .run_states import state_stream


def _percent(current, total):
    return F.when(F.col("status") == "completed", 100.0).when(
        F.col(total) > 0, F.round(F.col(current) / F.col(total) * 100, 1)).otherwise(0.0)


def progress(events: DataFrame) -> DataFrame:
    """Latest state, percentage and finished stages per run.

    A stage is finished once another one has followed it, also when it was
    entered again later; the current stage of a completed run is finished too.
    Stages are first reduced to one row per (run, stage), so a run's log is
    never gathered.
    """
    at = F.struct("ts", "event_id")
    per_stage = events.groupBy("run_id", "stage").agg(
        F.min(at).alias("entered"), F.max_by(F.struct("ts", "event_id", "status", "current", "total"), at).alias("last"))
    folded = per_stage.groupBy("run_id").agg(
        F.max_by(F.struct("stage", "last"), F.struct("last.ts", "last.event_id")).alias("now"),
        F.array_sort(F.collect_list(F.struct("entered", "stage", F.struct("last.ts", "last.event_id").alias("seen")))).alias("stages"))
    flat = folded.select("run_id", F.col("now.stage").alias("stage"), "now.last.*", "stages")
    done = F.transform(F.filter("stages", lambda s: (s["stage"] != F.col("stage")) | (F.col("status") == "completed") | F.exists(
        F.col("stages"), lambda o: (o["stage"] != s["stage"]) & (o["seen"] > s["entered"]))), lambda s: s["stage"])
    return flat.select("run_id", "stage", "status", _percent("current", "total").alias("percent"),
                       done.alias("stages_completed"), "ts")


def close_silent(states: DataFrame, now, silence: str = "10 minutes") -> DataFrame:
    """Runs still running after a silence count as failed."""
    late = (F.col("status") == "running") & (F.col("ts") < now - F.expr(f"INTERVAL {silence}"))
    return states.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def latest_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming latest state per run (update mode), built-in aggregation only."""
    at = F.struct("ts", "event_id")
    latest = events.withWatermark("ts", late).groupBy("run_id").agg(
        F.max_by(F.struct("stage", "status", "current", "total", "ts"), at).alias("s"))
    return latest.select("run_id", "s.*").withColumn("percent", _percent("current", "total"))


def progress_stream(events: DataFrame, silence_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """Streaming fold with time-outs: a run that falls silent while running fails. See :func:`run_states.state_stream`."""
    return state_stream(events, silence_ms, late).select("run_id", "stage", "status", "percent", "stages_completed", "ts")


def states_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Write every emitted state; a replayed batch overwrites its own folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_states(written: DataFrame) -> DataFrame:
    """Last emitted state per run of a table written batch by batch."""
    names = [c for c in written.columns if c not in ("run_id", "batch")]
    return written.groupBy("run_id").agg(
        F.max_by(F.struct(*names), F.struct("batch", "ts")).alias("s")).select("run_id", "s.*")
