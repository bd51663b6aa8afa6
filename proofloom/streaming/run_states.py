"""Whole state of a run: stage, sub-steps, partial failures and error, as a batch and as a stream.

Events: (run_id, event_id, ts, stage, status, current, total, error, substep, substep_status, failed_ids).
A row may speak of the stage, of one sub-step, of the ids that failed in part, or of several of these;
what it leaves NULL stays as it was. An empty ``failed_ids`` clears the list. Columns that the table
lacks count as NULL. The newest (ts, event_id) decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

OPTIONAL = {"error": "string", "substep": "string", "substep_status": "string", "failed_ids": "array<string>"}
STATE = ("run_id string, stage string, status string, percent double, stages_completed array<string>, substeps map<string,string>, "
         "partial_failed int, partial_failed_ids array<string>, error string, ms long")
FACT = ("run_id string, kind string, name string, first_ms long, ms long, event_id long, status string, current int, total int, "
        "error string, ids array<string>, ts timestamp")
FOLDED = ("kind", "name", "first_ms", "ms", "event_id", "status", "current", "total", "error", "ids")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def facts(events: DataFrame) -> DataFrame:
    """One row per thing that an event says: kind (stage, substep or failed), name and values."""
    for name, kind in OPTIONAL.items():
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    none = F.lit(None)

    def fact(kind, name, status, current=none, total=none, error=none, ids=none):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), status.cast("string").alias("status"), current.cast("int").alias("current"),
                        total.cast("int").alias("total"), error.cast("string").alias("error"), ids.cast("array<string>").alias("ids"))

    c = F.col
    said = F.array_compact(F.array(
        F.when(c("stage").isNotNull(), fact("stage", c("stage"), c("status"), c("current"), c("total"), c("error"))),
        F.when(c("substep").isNotNull(), fact("substep", c("substep"), c("substep_status"))),
        F.when(c("failed_ids").isNotNull(), fact("failed", F.lit(""), none, ids=c("failed_ids")))))
    return events.select(c("run_id").cast("string").alias("run_id"), c("ts").cast("timestamp").alias("ts"), c("event_id").cast("long").alias("event_id"),
                         F.explode(said).alias("f")).select("run_id", "ts", F.unix_millis("ts").alias("ms"), "event_id", "f.*")


def run_states(events: DataFrame) -> DataFrame:
    """State of every run: the columns of ``STATE``, with ``ts``, its newest event, instead of ``ms``.

    Facts are reduced to one row per run and stage or sub-step first, so no run's log is gathered. A run
    without a stage is running. Sub-steps without a status are pending.
    """
    at = F.struct("ts", "event_id")
    newest = F.struct("ts", "event_id", "status", "current", "total", "error", "ids")
    each = facts(events).groupBy("run_id", "kind", "name").agg(F.min(at).alias("entered"), F.max_by(newest, at).alias("last"))
    seen = F.struct("last.ts", "last.event_id")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    runs = each.groupBy("run_id").agg(
        F.max_by(F.struct("name", "last"), of("stage", seen)).alias("now"), F.max("last.ts").alias("ts"),
        F.array_sort(F.collect_list(of("stage", F.struct("entered", "name", seen.alias("seen"))))).alias("stages"),
        F.array_sort(F.collect_list(of("substep", F.struct("name", F.coalesce("last.status", F.lit("pending")).alias("status"))))).alias("parts"),
        F.max_by("last.ids", of("failed", seen)).alias("ids"))
    last = F.col("now.last")
    flat = runs.select("run_id", "ts", "stages", "parts", "ids", F.col("now.name").alias("stage"), F.coalesce(last["status"], F.lit("running")).alias("status"),
                       last["current"].alias("current"), last["total"].alias("total"), last["error"].alias("error"))
    done = F.filter("stages", lambda s: (s["name"] != F.col("stage")) | (F.col("status") == "completed") | F.exists(
        F.col("stages"), lambda o: (o["name"] != s["name"]) & (o["seen"] > s["entered"])))
    percent = F.when(F.col("status") == "completed", 100.0).when(F.col("total") > 0, F.round(F.col("current") / F.col("total") * 100, 1)).otherwise(0.0)
    return flat.select("run_id", "stage", "status", F.coalesce(percent, F.lit(0.0)).alias("percent"), F.transform(done, lambda s: s["name"]).alias("stages_completed"),
                       F.map_from_entries("parts").alias("substeps"), F.size(F.coalesce("ids", F.array())).alias("partial_failed"),
                       F.coalesce("ids", F.array().cast("array<string>")).alias("partial_failed_ids"),
                       F.when(F.col("status") == "failed", F.col("error")).alias("error"), "ts")


def close_silent(states: DataFrame, now, silence: str = "10 minutes") -> DataFrame:
    """Runs still running after a silence count as failed, with the text of a lost process."""
    late = (F.col("status") == "running") & (F.col("ts") < now - F.expr(f"INTERVAL {silence}"))
    return states.withColumns({"status": F.when(late, "failed").otherwise(F.col("status")),
                               "error": F.when(late, fixed.LOST_RUN).otherwise(F.col("error"))})


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Facts of an Arrow batch reduced to one row per run, kind and name: when first seen, and the newest values."""
    for frame in frames:
        if len(frame):
            group = ["run_id", "kind", "name"]
            rows = frame.sort_values(["ms", "event_id"], kind="stable")
            rows["first_ms"] = rows.groupby(group, sort=False)["ms"].transform("min")
            yield rows.groupby(group, sort=False).tail(1)[["run_id", "kind", "name", "first_ms", "ms", "event_id", "status", "current", "total", "error", "ids", "ts"]]


def _given(value):
    """NULL instead of pandas' signs for a missing value."""
    return None if value is None or isinstance(value, float) and value != value else value


class RunFold(StatefulProcessor):
    """State per run: its newest stage event, maps of stages and sub-steps, the failed ids, and one event-time timer.

    A sub-step or stage is one entry of a map, so an event rewrites its own entry and not the state of the run.
    A run that is still running when its timer expires fails; its state goes.
    """

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "stage string, status string, percent double, error string, ms long, event_id long")
        self.heard = handle.getValueState("heard", "ms long")
        self.failed = handle.getValueState("failed", "ms long, event_id long, ids array<string>")
        self.stages = handle.getMapState("stages", "name string", "first_ms long, last_ms long")
        self.substeps = handle.getMapState("substeps", "name string", "ms long, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read once and an entry is written once, however many rows speak of it: each call crosses to the JVM."""
        facts = [fact for frame in rows for fact in zip(*(frame[c].tolist() for c in FOLDED))]
        facts.sort(key=lambda f: (f[3], f[4]))
        held = self._held()
        now, heard, failed, stages, substeps = held["now"], held["heard"], held["failed"], held["stages"], held["substeps"]
        new_stages, new_substeps, before = set(), set(), (now, failed)
        for kind, name, first_ms, ms, event, status, current, total, error, ids in facts:
            first_ms, ms, event = int(first_ms), int(ms), int(event)
            newer = lambda held, at: held is None or (ms, event) >= (held[at], held[at + 1])
            heard = ms if heard is None else max(heard, ms)
            if kind == "stage":
                first, last = stages.get(name, (ms, ms))
                stages[name] = (min(first, first_ms), max(last, ms))
                new_stages.add(name)
                if newer(now, 4):
                    status, current, total = _given(status) or "running", _given(current), _given(total)
                    percent = 100.0 if status == "completed" else round(float(current) / float(total) * 100, 1) if total and total > 0 and current is not None else 0.0
                    now = (name, status, percent, _given(error) if status == "failed" else None, ms, event)
            elif kind == "substep":
                if newer(substeps.get(name), 0):
                    substeps[name] = (ms, event, _given(status) or "pending")
                    new_substeps.add(name)
            elif newer(failed, 0):
                failed = (ms, event, [str(i) for i in ids])
        for name in new_stages:
            self.stages.updateValue((name,), stages[name])
        for name in new_substeps:
            self.substeps.updateValue((name,), substeps[name])
        for state, value, old in ((self.now, now, before[0]), (self.failed, failed, before[1])):
            if value is not old:
                state.update(value)
        self.heard.update((heard,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(heard, timerValues.getCurrentWatermarkInMs()) + self.silence)
        yield self._state(key[0], {"now": now, "heard": heard, "failed": failed, "stages": stages, "substeps": substeps})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        status = held["now"][1] if held["now"] else "running"
        if status == "running":
            yield self._state(key[0], held, lost=True)
        for state in (self.now, self.heard, self.failed, self.stages, self.substeps):
            state.clear()

    def _held(self) -> dict:
        """The whole state of a run as plain values."""
        one = lambda state: state.get() if state.exists() else None
        heard = one(self.heard)
        return {"now": one(self.now), "heard": None if heard is None else heard[0], "failed": one(self.failed),
                "stages": {name[0]: (span[0], span[1]) for name, span in self.stages.iterator()},
                "substeps": {name[0]: tuple(value) for name, value in self.substeps.iterator()}}

    def _state(self, run: str, held: dict, lost: bool = False) -> pd.DataFrame:
        stage, status, percent, error = held["now"][:4] if held["now"] else (None, "running", 0.0, None)
        if lost:
            status, error = "failed", fixed.LOST_RUN
        spans = sorted((first, last, name) for name, (first, last) in held["stages"].items())
        done = [s for first, _, s in spans if s != stage or status == "completed" or any(o != s and last > first for _, last, o in spans)]
        parts = {name: value[2] for name, value in held["substeps"].items()}
        ids = list(held["failed"][2]) if held["failed"] else []
        return pd.DataFrame({"run_id": [run], "stage": [stage], "status": [status], "percent": [float(percent)], "stages_completed": [done],
                             "substeps": [dict(sorted(parts.items()))], "partial_failed": [len(ids)], "partial_failed_ids": [ids],
                             "error": [error], "ms": [held["heard"]]})

    def close(self) -> None:
        pass


def state_stream(events: DataFrame, silence_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """:func:`run_states` as a stream, with time-outs. A run's newest row is its state.

    Facts are reduced where they are read, so a busy run sends few rows to its state. Map states need
    the RocksDB store, which is set for streams that the session starts from now on; a stream
    that was started before keeps the store its log names.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spread = facts(events).mapInPandas(_combine, FACT)
    states = spread.withWatermark("ts", late).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunFold(silence_ms), outputStructType=STATE, outputMode="Update", timeMode="EventTime")
    return states.select("*", F.timestamp_millis("ms").alias("ts")).drop("ms")
