import datetime as dt

from pyspark.sql import functions as F

from proofloom.streaming import ingest, progress

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run_id string, event_id long, ts timestamp, stage string, status string, current int, total int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_progress_batch_and_stream(spark, tmp_path):
    events = [("full", 1, at(0), "load", "running", 1, 2), ("full", 2, at(1), "rank", "running", 1, 4), ("full", 3, at(2), "rank", "completed", 4, 4),
              ("quiet", 4, at(0), "load", "running", 1, 3), ("bad", 5, at(3), "load", "failed", 0, 0), ("late", 6, at(600), "load", "running", 1, 2)]
    df = spark.createDataFrame(events, SCHEMA)
    got = {r.run_id: (r.stage, r.status, r.percent, r.stages_completed) for r in progress.progress(df).collect()}
    assert got["full"] == ("rank", "completed", 100.0, ["load", "rank"]) and got["quiet"] == ("load", "running", 33.3, [])
    closed = {r.run_id: r.status for r in progress.close_silent(progress.progress(df), F.lit(at(600))).collect()}
    assert closed == {"full": "completed", "quiet": "failed", "bad": "failed", "late": "running"}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    progress.states_to_table(progress.progress_stream(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    last = {r.run_id: r for r in progress.latest_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert {k: r.status for k, r in last.items()} == closed
    assert last["full"].stages_completed == ["load", "rank"]


def test_ingest_only_takes_new_content(spark, tmp_path):
    docs = "id long, text string"
    calls = []

    def process(rows):
        calls.append(rows.count())
        return rows.select("content_key", "id", "text")

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], docs).write.parquet(str(tmp_path / "in/1"))
    def run():
        stream = ingest.read_documents(spark, str(tmp_path / "in/*"), docs)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "log"), process).awaitTermination()
    run()
    spark.createDataFrame([(4, "b"), (5, "c")], docs).write.parquet(str(tmp_path / "in/2"))
    run()
    run()
    assert calls == [2, 1]
    assert sorted(r.text for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_a_stage_entered_again_stays_finished(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    stages = {"aba": "ABA", "abab": "ABAB", "ab": "AB", "a": "AA"}
    rows = [(run, i, t0 + timedelta(minutes=i), s, "running", 1, 10) for run, order in stages.items() for i, s in enumerate(order)]
    df = spark.createDataFrame(rows, "run_id string, event_id long, ts timestamp, stage string, status string, current int, total int")
    want = {"aba": ["A", "B"], "abab": ["A", "B"], "ab": ["A"], "a": []}
    assert {r.run_id: r.stages_completed for r in progress.progress(df).collect()} == want


def test_ingest_keeps_every_path_and_replaces_changed_files(spark, tmp_path):
    docs = "path string, text string"
    cut = lambda rows: rows.select("content_key", F.explode(F.split("text", " ")).alias("word"))
    out = str(tmp_path / "out")
    for n, rows in enumerate([[("p1", "a b"), ("p2", "a b"), ("p3", "c")], [("p3", "a b"), ("p4", "d e")]]):
        spark.createDataFrame(rows, docs).write.parquet(str(tmp_path / f"in/{n}"))
        stream = ingest.read_documents(spark, str(tmp_path / "in/*"), docs)
        ingest.ingest(stream, out, str(tmp_path / "log"), cut, path="path").awaitTermination()
    got = sorted((r.path, r.word) for r in ingest.current(spark, out, "path").collect())
    assert got == [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p3", "a"), ("p3", "b"), ("p4", "d"), ("p4", "e")]
    assert spark.read.option("basePath", out).parquet(out).count() == 5


def test_ingest_of_several_outputs_reads_its_prefixes_and_retires_old_rows(spark, tmp_path):
    docs = "path string, text string"
    out = str(tmp_path / "out")
    process = lambda rows: {"whole": rows.select("content_key", "text"), "words": rows.select("content_key", F.explode(F.split("text", " ")).alias("word"))}
    for n, rows in enumerate([[("p1", "a b"), ("p2", "c")], [("p2", "a b"), ("p3", "d")], [("p3", "d")]]):
        spark.createDataFrame(rows, docs).write.parquet(str(tmp_path / f"in/{n}"))
        for again in (False, True):  # a replay with nothing new changes nothing
            stream = ingest.read_documents(spark, str(tmp_path / "in/*"), docs)
            ingest.ingest(stream, out, str(tmp_path / "log"), process, path="path").awaitTermination()
    words = lambda df: sorted((r["path"], r["word"]) for r in df.collect())
    assert words(ingest.current(spark, out, "path", name="words")) == [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p3", "d")]
    assert [r["text"] for r in ingest.retired(spark, out, "path", name="whole").collect()] == ["c"]
    assert ingest.output(spark, out, "whole").count() == 3
    keyed = ingest.new_content(spark.createDataFrame([("p", "d")], docs), None)
    plan = ingest.seen_keys(keyed, out, "none")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and f"[{keyed.first()['content_key'][:ingest.PREFIX]}]" in plan.replace("(", "[").replace(")", "]")


RUN_EVENTS = SCHEMA + ", error string, substep string, substep_status string, failed_ids array<string>"


def _run_events():
    none = (None,) * 4
    return [
        ("full", 1, at(0), "load", "running", 1, 2, *none), ("full", 2, at(1), None, None, None, None, None, "c1", "running", None),
        ("full", 3, at(2), None, None, None, None, None, "c2", None, ["x", "y"]), ("full", 4, at(3), "rank", "running", 1, 3, None, "c1", "done", None),
        ("full", 5, at(4), "rank", "completed", 3, 3, *none), ("full", 6, at(5), None, None, None, None, None, "c2", "error", ["y"]),
        ("full", 6, at(5), None, None, None, None, None, "c2", "error", ["y"]),
        ("bad", 7, at(3), "load", "failed", 0, 0, "no disk", None, None, []), ("quiet", 8, at(1), "load", "running", 1, 3, *none),
        ("quiet", 9, at(2), None, None, None, None, None, "c9", "running", None), ("parts", 10, at(4), None, None, None, None, None, "c1", "done", None),
        ("again", 11, at(590), "a", "running", None, 4, *none), ("again", 12, at(591), "b", "running", 9, None, *none), ("again", 13, at(592), "a", "running", 1, 4, *none),
        ("late", 14, at(600), "load", "running", 1, 2, *none), ("mute", 15, at(600), None, None, None, None, *none)]


def _shown(rows):
    return {r.run_id: (r.stage, r.status, r.percent, r.stages_completed, r.substeps, r.partial_failed, r.partial_failed_ids, r.error, r.ts) for r in rows}


def test_run_states_batch_and_stream_with_substeps_and_partial_failures(spark, tmp_path):
    from proofloom.streaming import run_states as R

    lost = "Process exited unexpectedly"
    want = {
        "full": ("rank", "completed", 100.0, ["load", "rank"], {"c1": "done", "c2": "error"}, 1, ["y"], None, at(5)),
        "bad": ("load", "failed", 0.0, [], {}, 0, [], "no disk", at(3)), "quiet": ("load", "failed", 33.3, [], {"c9": "running"}, 0, [], lost, at(2)),
        "parts": (None, "failed", 0.0, [], {"c1": "done"}, 0, [], lost, at(4)), "again": ("a", "running", 25.0, ["a", "b"], {}, 0, [], None, at(592)),
        "late": ("load", "running", 50.0, [], {}, 0, [], None, at(600))}
    df = spark.createDataFrame(_run_events(), RUN_EVENTS)
    assert _shown(R.close_silent(R.run_states(df), F.lit(at(600)), "20 minutes").collect()) == want
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run(out=out, log=log):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
        progress.states_to_table(R.state_stream(stream), out, log).awaitTermination()
        return _shown(progress.latest_states(spark.read.parquet(out)).collect())

    # two arrivals: state carries over, and what came before is not read again
    df.filter("run_id = 'full' AND event_id <= 3").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    assert run()["full"][:7] == ("load", "running", 50.0, [], {"c1": "running", "c2": "pending"}, 2, ["x", "y"])
    df.filter("run_id = 'full' AND event_id > 3").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    assert run() == run() == {"full": want["full"]}  # a restart without news changes nothing
    df.write.parquet(str(tmp_path / "all/1"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "all/*"))
    progress.states_to_table(R.state_stream(stream), str(tmp_path / "out3"), str(tmp_path / "log3")).awaitTermination()
    assert _shown(progress.latest_states(spark.read.parquet(str(tmp_path / "out3"))).collect()) == want


def test_run_states_of_an_empty_table_and_of_plain_step_events(spark):
    from proofloom.streaming import run_states as R

    assert R.run_states(spark.createDataFrame([], RUN_EVENTS)).count() == 0
    plain = spark.createDataFrame([("a", 1, at(0), "load", "running", 1, 2), ("a", 2, at(1), "rank", "failed", 1, 2)], SCHEMA)
    assert _shown(R.run_states(plain).collect()) == {"a": ("rank", "failed", 50.0, ["load"], {}, 0, [], None, at(1))}


def test_run_state_is_read_and_written_once_per_batch():
    import pandas as pd

    from proofloom.streaming.run_states import FOLDED, RunFold

    calls = []

    class Held:
        def __init__(self): self.value, self.map = None, {}
        def exists(self): return self.value is not None
        def get(self): return self.value
        def update(self, value): calls.append("update"); self.value = value
        def iterator(self): calls.append("iterator"); return iter(self.map.items())
        def updateValue(self, name, value): calls.append("updateValue"); self.map[name] = value

    class Handle:
        getValueState = getMapState = lambda self, *a: Held()
        listTimers = lambda self: iter([])
        registerTimer = deleteTimer = lambda self, t: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    fold = RunFold(1000)
    fold.init(Handle())
    facts = [("stage", "ab"[i % 2], i, i, i, "running", i, 200, None, None) for i in range(100)] + [("substep", "c", i, i, i, None, None, None, None, None) for i in range(100)]
    for part in (facts[::2], facts[1::2]):
        out = next(iter(fold.handleInputRows(("r",), iter([pd.DataFrame(part, columns=FOLDED)]), Clock()))).iloc[0]
    assert (out.stage, out.percent, out.stages_completed, out.substeps, out.ms) == ("b", 49.5, ["a", "b"], {"c": "pending"}, 99)
    assert len(calls) <= 14
