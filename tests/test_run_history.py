import hashlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from orderledger.operators.run_history import (
    last_results,
    latest_runs,
    result_for,
    run_ids,
    run_manifest,
    assign_runs,
    run_parameters,
    run_starts,
    run_statuses,
    stages_not_run,
    unknown_statuses,
    upstream_outputs,
    with_durations,
    with_exit_status,
    with_result_defaults,
    with_runs,
)
from orderledger.plans import write_manifests
from orderledger.sources import read_json_documents, write_json_documents

T0 = datetime(2026, 6, 1, 12)
SCHEMA = (
    "pipeline string, run_id string, seq bigint, name string, status string, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, outputs string, stderr string, return_code int, source string"
)


def result(run, seq, name, status="succeeded", seconds=1.5, outputs="{}", stderr="", code=0, source=None):
    start = T0 + timedelta(minutes=seq)
    return ("p", run, seq, name, status, start, start + timedelta(seconds=seconds), outputs, stderr, code, source)


def frame(spark, rows, registry=None):
    results = spark.createDataFrame(rows, SCHEMA)
    if registry is not None:
        registry = spark.createDataFrame(registry, "pipeline string, run_id string, run_started_at timestamp_ntz")
    return with_runs(results, registry)


def test_durations_exit_codes_and_defaults(spark):
    results = frame(
        spark,
        [
            result("r", 1, "a", "pending"),
            result("r", 2, "b", seconds=-5, code=2, stderr=" boom "),
            result("r", 3, "c", "failed", code=1, stderr=" \n", source="x"),
        ],
    )
    rows = with_durations(results).orderBy("seq").collect()
    assert [r.duration_seconds for r in rows] == [1.5, 0.0, 1.5]
    rows = with_exit_status(results).orderBy("seq").collect()
    assert [(r.status, r.error) for r in rows] == [
        ("succeeded", None), ("failed", "boom"), ("failed", "Subprocess returned a non-zero exit code."),
    ]
    rows = with_result_defaults(results, F.concat(F.lit("src_"), "name")).orderBy("seq").collect()
    assert [(r.status, r.source) for r in rows] == [
        ("succeeded", "src_a"), ("succeeded", "src_b"), ("failed", "x"),
    ]


def test_run_ids_equal_the_python_digest(spark):
    times = [datetime(2026, 6, 19, 16, 45, 43, 313000), datetime(2026, 6, 19, 16, 45, 43), datetime(2026, 1, 1, 0, 0, 0, 7)]
    runs = spark.createDataFrame([("p", "python", t) for t in times], "name string, backend string, at timestamp_ntz")
    zoned = runs.withColumn("at", F.expr("cast(at as timestamp)"))
    for frame_ in (runs, zoned):
        got = {r.at: r for r in run_ids(frame_, "name", "backend", "at").select(F.col("at").cast("timestamp_ntz").alias("at"), "hash", "run_id").collect()}
        for t in times:
            utc = t.replace(tzinfo=timezone.utc)
            digest = hashlib.sha256(f"p:python:{utc.isoformat()}".encode()).hexdigest()
            assert got[t].hash == digest
            assert got[t].run_id == f"{utc:%Y-%m-%d_%H%M%S}_{digest[:8]}"


def test_run_ids_do_not_depend_on_the_session_zone(spark):
    runs = spark.sql("select 'p' name, 'python' backend, timestamp'2026-06-19 16:45:43Z' at")
    [utc] = run_ids(runs, "name", "backend", "at").collect()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        [tokyo] = run_ids(runs, "name", "backend", "at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc.run_id == tokyo.run_id and utc.run_id.startswith("2026-06-19_164543_")


def test_parameters_later_wins(spark):
    configs = spark.createDataFrame(
        [("p", "r", "given", None, {"reason": "x", "k": "1"}, {"k": "2", "backend": "other"})],
        "pipeline string, run_id string, name string, backend string, metadata map<string,string>, extra map<string,string>",
    )
    assert {r.key: r.value for r in run_parameters(configs).collect()} == {
        "name": "given", "backend": "other", "work_dir": None, "log_dir": "logs", "data_dir": "data",
        "allow_subprocess_fallback": "true", "python_executable": None, "reason": "x", "k": "2",
    }


def test_chained_steps_leave_ordered_records(spark):
    results = frame(
        spark,
        [result("r", 1, "first_stage", outputs="alpha"), result("r", 2, "second_stage", outputs="alpha-beta")],
    )
    [run] = run_statuses(results).collect()
    assert (run.status, run.succeeded, run.stages) == ("succeeded", True, 2)
    manifest = run_manifest(results).orderBy("place").collect()
    assert [r.name for r in manifest] == ["first_stage", "second_stage"]
    assert {r.name: r.outputs for r in manifest if r["last"]} == {"first_stage": "alpha", "second_stage": "alpha-beta"}


def test_manifest_keeps_every_result_and_marks_the_last(spark):
    results = frame(spark, [result("r", i, f"s{i % 3}", outputs=str(i)) for i in range(7)] + [result("q", 9, "s0")])
    manifest = run_manifest(results)
    rows = manifest.where("run_id = 'r'").orderBy("place").collect()
    assert [(r.place, r.name) for r in rows] == [(i, f"s{i % 3}") for i in range(7)]
    assert {r.name: r.outputs for r in rows if r["last"]} == {"s0": "6", "s1": "4", "s2": "5"}
    assert [r.name for r in manifest.where("run_id = 'q'").collect()] == ["s0"]


def test_picks(spark):
    results = frame(spark, [result("r", 1, "a", outputs="1"), result("r", 2, "a", "failed", outputs="2"), result("q", 3, "b")])
    assert {(r.run_id, r.name): r.outputs for r in last_results(results).collect()} == {("r", "a"): "2", ("q", "b"): "{}"}
    assert [(r.run_id, r.outputs) for r in result_for(results, "a").collect()] == [("r", "1")]
    [latest] = latest_runs(run_statuses(results)).collect()
    assert (latest.run_id, latest.status) == ("q", "succeeded")


def test_upstream_and_stages_never_reached(spark):
    results = frame(spark, [result("r", 1, "a", outputs="x"), result("r", 2, "b", "failed"), result("q", 3, "a"), result("q", 4, "b")])
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "c", "b"), ("p", "b", "z")], "pipeline string, name string, dependency string")
    got = {(r.run_id, r.name, r.dependency): r.upstream_outputs for r in upstream_outputs(edges, results).collect()}
    assert got == {("r", "b", "a"): "x", ("r", "b", "z"): None, ("q", "b", "a"): "{}", ("q", "b", "z"): None}
    planned = spark.createDataFrame([("p", n) for n in "abc"], "pipeline string, name string")
    assert [(r.run_id, r.name) for r in stages_not_run(planned, results).collect()] == [("r", "c")]


def test_unknown_statuses(spark):
    results = frame(spark, [result("r", 1, "a"), result("r", 2, "b", "odd"), result("r", 3, "c", None)])
    assert {r.name for r in unknown_statuses(results).collect()} == {"b", "c"}


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_runs_of_one_id_are_told_apart_by_their_start(spark):
    registry = [("p", "r", _at(10)), ("p", "r", _at(20)), ("p", "x", _at(5)), ("p", "y", _at(6))]
    rows = [result("r", 2, "a"), result("r", 10, "a", "failed"), result("r", 19, "b"), result("r", 20, "a"), result("r", 5000, "b")]
    results = frame(spark, rows, registry)
    assert {r.seq: r.run_started_at for r in results.collect()} == {2: _at(2), 10: _at(10), 19: _at(10), 20: _at(20), 5000: _at(20)}
    raw = spark.createDataFrame(rows, SCHEMA)
    starts = run_starts(spark.createDataFrame(registry, "pipeline string, run_id string, run_started_at timestamp_ntz"), raw)
    ended = spark.createDataFrame(
        [("p", "x", _at(7), "failed"), ("p", "r", _at(25), "succeeded")], "pipeline string, run_id string, ended_at timestamp_ntz, status string"
    )
    runs = run_statuses(results, starts, assign_runs(ended, starts, ["ended_at"]))
    got = {(r.run_id, r.run_started_at): (r.status, r.stages) for r in runs.collect()}
    assert got == {
        ("r", _at(2)): ("succeeded", 1), ("r", _at(10)): ("failed", 2), ("r", _at(20)): ("succeeded", 2),
        ("x", _at(5)): ("failed", 0), ("y", _at(6)): ("running", 0),
    }
    [latest] = latest_runs(runs).collect()
    assert (latest.run_id, latest.run_started_at, latest.status) == ("r", _at(20), "succeeded")
    assert {(r.run_started_at, r.outputs) for r in result_for(results, "b").collect()} == {(_at(10), "{}"), (_at(20), "{}")}
    planned = spark.createDataFrame([("p", n) for n in "abc"], "pipeline string, name string")
    missed = {(r.run_id, r.run_started_at, r.name) for r in stages_not_run(planned, results, runs).collect()}
    assert missed == {("r", _at(10), "c"), *((i, t, n) for i, t in (("x", _at(5)), ("y", _at(6))) for n in "abc")}


def test_assignment_does_not_depend_on_the_chunks(spark):
    registry = [("p", "r", _at(m)) for m in range(0, 3000, 170)]
    rows = [result("r", m, "a") for m in range(1, 3000, 13)]
    starts = run_starts(
        spark.createDataFrame(registry, "pipeline string, run_id string, run_started_at timestamp_ntz"), spark.createDataFrame(rows, SCHEMA)
    )
    for seconds in (60, 3_600, 10**7):
        got = assign_runs(spark.createDataFrame(rows, SCHEMA), starts, ["started_at"], seconds)
        assert all(r.run_started_at == _at(r.seq // 170 * 170) for r in got.collect())


def test_records_without_a_time_or_start(spark):
    untimed = ("p", "r", 1, "a", "succeeded", None, None, "{}", "", 0, None)
    lost = ("p", "q", 2, "a", "succeeded", None, None, "{}", "", 0, None)
    got = {r.seq: r.run_started_at for r in frame(spark, [untimed, lost, result("r", 5, "b")], [("p", "r", _at(4))]).collect()}
    assert got == {1: _at(4), 2: datetime(1970, 1, 1), 5: _at(4)}
    assert frame(spark, []).count() == 0


def test_latest_run_hashes(spark):
    plan = latest_runs(run_statuses(frame(spark, [result("r", 1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_results_take_their_stage_s_name_and_metadata_may_be_no_map(spark):
    results = frame(spark, [result("r", 1, "other", "pending")]).withColumn("stage", F.lit("a"))
    [row] = with_result_defaults(results, F.col("stage"), F.col("stage")).collect()
    assert (row.name, row.source, row.status) == ("a", "a", "succeeded")
    configs = spark.createDataFrame([("p", "r", "note", {"k": "1"})], "pipeline string, run_id string, metadata string, extra map<string,string>")
    got = {r.key: r.value for r in run_parameters(configs).collect()}
    assert (got["metadata"], got["k"], got["log_dir"]) == ("note", "1", "logs")


def test_manifest_documents_of_0_1_and_5000_stages(spark, tmp_path):
    """One shape for every length, lists whole and in order, in the folder the document names."""
    names = [f"s{i % 1200}" for i in range(5000)]
    rows = [("p", "long", i, name, str(i)) for i, name in enumerate(names)] + [("p", "one", 0, "a", "x")]
    start = T0.isoformat(sep=" ")
    results = spark.createDataFrame(rows, "pipeline string, run_id string, seq bigint, name string, outputs string")
    results = results.withColumn("run_started_at", F.lit(start))
    runs = spark.createDataFrame([("p", r, start, s) for r, s in (("long", "failed"), ("one", "succeeded"), ("none", None))], "pipeline string, run_id string, run_started_at string, status string")
    parameters = runs.where("run_id = 'none'").select("pipeline", "run_id", "run_started_at", F.lit("k").alias("key"), F.lit("v").alias("value"))
    for _ in range(2):  # The second run replaces what the first one left.
        path = write_manifests(results, runs, str(tmp_path / "out"), parameters)
    part = "struct<folder: string, rows: bigint>"
    schema = f"run_id string, status string, stages_run {part}, outputs {part}, parameters {part}"
    documents = {r.run_id: r for r in read_json_documents(spark, path, "document", schema).collect()}
    counts = {k: (d.status, d.stages_run.rows, d.outputs.rows, d.parameters.rows) for k, d in documents.items()}
    assert counts == {"long": ("failed", 5000, 1200, 0), "one": ("succeeded", 1, 1, 0), "none": (None, 0, 0, 1)}
    lines = spark.read.schema("document string, place bigint, name string").json(documents["long"].stages_run.folder)
    own = lines.where(F.col("document") == documents["long"].document).orderBy("place").collect()
    assert [(r.place, r.name) for r in own] == list(enumerate(names))
    outputs = read_json_documents(spark, path, "outputs", "name string, outputs string").where(F.col("document") == documents["long"].document)
    assert {r.name: r.outputs for r in outputs.collect()} == {name: str(i) for i, name in enumerate(names)}


def test_documents_keep_null_keys_apart_and_refuse_taken_names(spark, tmp_path):
    scalars = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "x string, y string")
    path = write_json_documents(scalars, str(tmp_path / "out"), ["x", "y"], {})
    assert read_json_documents(spark, path, "document", "x string, y string").select("document").distinct().count() == 3
    with pytest.raises(ValueError, match="shard"):
        write_json_documents(scalars.withColumnRenamed("y", "shard"), path, ["x"], {})
