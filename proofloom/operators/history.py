"""Append logs: edits, versions, runs, prompt versions, assistant use, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import empty_source_tags
from ..session import top_n


# --- edits -------------------------------------------------------------------------

def checked_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that may be saved, and those blocked for empty source tags."""
    marked = edits.withColumn("empty_tags", empty_source_tags(F.coalesce("content", F.lit(""))))
    return marked.filter("empty_tags = 0").drop("empty_tags"), marked.filter("empty_tags > 0")


def current_edits(log: DataFrame, keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """Latest content and status per chapter, folded from one event log.

    Content events carry content, status events only a status. One partial
    aggregation: no chapter's history is gathered.
    """
    at = F.struct("ts", "event_id")
    has = F.col("content").isNotNull()
    return log.groupBy(*keys).agg(
        F.coalesce(F.max_by("content", F.when(has, at)), F.lit("")).alias("content"),
        F.coalesce(F.max_by("word_count", F.when(has, at)), F.lit(0)).alias("word_count"),
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), at)), F.lit("generated")).alias("status"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def versions(log: DataFrame, keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """Content events as versions, newest first within a chapter."""
    return log.filter(F.col("content").isNotNull()).select(
        *keys, F.col("event_id").alias("version_id"), "content", "word_count", "ts",
    ).orderBy(*keys, F.desc("version_id"))


def nth_version(log: DataFrame, n: int, keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """The ``n``-th newest version of every chapter."""
    rows = log.filter(F.col("content").isNotNull())
    return top_n(rows, keys, [F.desc("event_id")], n, "nth").filter(F.col("nth") == n)


def revert(log: DataFrame, wanted: DataFrame, event_id: Column, ts: Column,
           keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """Log with an old version appended as a new one: wanted(project, chapter, version_id).

    A version of another chapter or project changes nothing.
    """
    old = log.filter(F.col("content").isNotNull()).join(
        wanted.withColumnRenamed("version_id", "event_id"), [*keys, "event_id"], "left_semi")
    again = old.withColumns({"event_id": event_id, "ts": ts, "status": F.lit(None).cast("string")})
    return log.unionByName(again)


def delete_project(tables: dict[str, DataFrame], project: str,
                   key: str = "project_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without one project, and the number of rows each loses."""
    kept, lost = {}, None
    for name, frame in tables.items():
        mine = F.coalesce(F.col(key) == project, F.lit(False))
        kept[name] = frame.filter(~mine)
        row = frame.agg(F.count_if(mine).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        lost = row if lost is None else lost.unionByName(row)
    return kept, lost


# --- runs ----------------------------------------------------------------------------

def runs_of_project(runs: DataFrame, project: str, limit: int = 20, config: str = "config",
                    path: str = "$.project") -> DataFrame:
    """Newest runs of a project named in a JSON column; none named is ``default``."""
    name = F.get_json_object(F.col(config), path)
    mine = (name == project) | (F.lit(project == "default") & name.isNull())
    return runs.filter(mine).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def latest_fields(events: DataFrame, keys: list[str], kept: list[str], cleared: list[str] = [], names: str = "cleared") -> DataFrame:
    """Newest value per field of an update log (ts, event_id), one row per key.

    NULL in ``kept`` fields says nothing. ``cleared`` fields say nothing by NULL either, unless the
    array column ``names`` of the event names the field: then NULL is its new value.
    """
    at = F.struct("ts", "event_id")
    emptied = F.coalesce(F.col(names), F.array()) if names in events.columns else F.array().cast("array<string>")
    said = lambda c: F.col(c).isNotNull() | F.array_contains(emptied, c) if c in cleared else F.col(c).isNotNull()
    value = lambda c: F.when(F.array_contains(emptied, c), None).otherwise(F.col(c)) if c in cleared else F.col(c)
    return events.groupBy(*keys).agg(*[F.max_by(value(c), F.when(said(c), at)).alias(c) for c in [*kept, *cleared]])


def step_states(events: DataFrame, keys: list[str] = ["run_id", "step_name"]) -> DataFrame:
    """Latest status, start, end, process, exit code, error and warning per step; fields that the log lacks are left out."""
    has = lambda fields: [c for c in fields if c in events.columns]
    return latest_fields(events, keys, has(["status", "started_at", "completed_at"]), has(["error", "pid", "warning", "exit_code"]))


def run_records(events: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """Latest status, start, end, retries (0 at first), current step and error per run."""
    rows = latest_fields(events, keys, ["status", "started_at", "completed_at", "retry_count"], ["current_step", "error"])
    return rows.withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))


# --- prompt versions --------------------------------------------------------------------

def active_prompts(events: DataFrame, keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """The one active prompt version of every chapter: the last activated."""
    at = F.when(F.col("activated_at").isNotNull(), F.struct("activated_at", "version_id"))
    found = events.groupBy(*keys).agg(F.max_by(
        F.struct("version_id", "version_name", "system_prompt", "user_prompt"), at).alias("v"))
    return found.filter(F.col("v").isNotNull()).select(*keys, "v.*")


def new_prompt_version(wanted: DataFrame, active: DataFrame, system_default: str, user_default: str,
                       keys: list[str] = ["project_id", "chapter_id"]) -> DataFrame:
    """New versions that start from the active prompt, else from the default one."""
    base = active.select(*keys, "system_prompt", "user_prompt")
    return wanted.join(base, keys, "left").withColumns({
        "system_prompt": F.coalesce("system_prompt", F.lit(system_default)),
        "user_prompt": F.coalesce("user_prompt", F.lit(user_default)),
        "activated_at": F.lit(None).cast("timestamp")})


def deletable_versions(wanted: DataFrame, active: DataFrame,
                       keys: list[str] = ["project_id", "chapter_id"]) -> tuple[DataFrame, DataFrame]:
    """Versions that may be deleted, and active ones that may not."""
    hold = active.select(*keys, "version_id")
    on = [*keys, "version_id"]
    return wanted.join(hold, on, "left_anti"), wanted.join(hold, on, "left_semi")


def assistant_log(log: DataFrame, accepts: DataFrame) -> DataFrame:
    """Assistant calls with their latest accept flag, newest first per chapter."""
    last = accepts.groupBy("id").agg(F.max_by("accepted", "ts").alias("accepted"))
    return log.join(last, "id", "left").orderBy("project_id", "chapter_id", F.desc("id"))


# --- diffs ---------------------------------------------------------------------------------

def retrieval_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Leaves whose set of chunks changed, stayed, or is new.

    Set equality is counted on (leaf, chunk) keys, so no leaf's set is gathered.
    """
    now = current.select("leaf_id", "chunk_id").distinct().withColumn("now", F.lit(1))
    old = previous.select("leaf_id", "chunk_id").distinct().withColumn("old", F.lit(1))
    rows = now.join(old, ["leaf_id", "chunk_id"], "full").groupBy("leaf_id").agg(
        F.count("now").alias("n_now"), F.count("old").alias("n_old"),
        F.count_if(F.col("now").isNotNull() & F.col("old").isNotNull()).alias("shared"))
    same = (F.col("n_now") == F.col("n_old")) & (F.col("shared") == F.col("n_now"))
    change = F.when(F.col("n_old") == 0, "added").when(same, "unchanged").otherwise("changed")
    return rows.filter("n_now > 0").select("leaf_id", change.alias("change"))


def changed_with_edits(diff: DataFrame, edits: DataFrame) -> DataFrame:
    """Changed leaves and whether somebody edited them."""
    edited = edits.select("leaf_id").distinct().withColumn("has_edit", F.lit(True))
    return diff.filter(F.col("change") == "changed").join(edited, "leaf_id", "left").withColumn(
        "has_edit", F.coalesce("has_edit", F.lit(False)))
