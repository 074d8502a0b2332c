import random
from datetime import datetime, timedelta

from orderledger.operators.log_history import (
    attribute_events,
    failed_runs,
    log_stage_durations,
    run_wall_times,
)
from orderledger.sources import parse_log_lines, read_log_lines, unparsed_lines

# Two runs at once, a log that begins in the middle of a run, and one id used twice.
LOG = """\
2031-03-04 08:00:00,500 Pipeline completed | {"run_id": "old", "name": "etl", "stages": 4}
2031-03-04 08:10:00,000 Pipeline started | {"run_id": "east", "name": "etl"}
2031-03-04 08:10:01,000 Stage started | {"stage": "load", "source": "C:\\\\etl\\\\load.py", "mode": "subprocess"}
2031-03-04 08:10:02,250 Stage finished | {"stage": "load", "status": "succeeded", "mode": "subprocess"}
2031-03-04 08:11:00,000 Pipeline started | {"run_id": "west", "name": "etl"}
2031-03-04 08:11:05,000 Stage started | {"stage": "x | {y}", "mode": "callable"}
torn lin
2031-03-04 08:12:00,000 Pipeline failed | {"run_id": "east", "name": "etl", "error": "no disk"}
2031-03-04 08:12:30,000 Pipeline completed | {"run_id": "west", "name": "etl", "stages": 1}
2031-03-04 08:20:00,000 Pipeline started | {"run_id": "east", "name": "etl"}
2031-03-04 08:21:00,001 Pipeline completed | {"run_id": "east", "name": "etl", "stages": 0}
2031-03-04 08:22:00,000 words without attributes
"""


def test_a_log_file_end_to_end(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text(LOG, encoding="utf-8")
    lines = read_log_lines(spark, str(path))
    assert [r.line_no for r in unparsed_lines(lines).collect()] == [7]
    events = parse_log_lines(lines, zone="Europe/Madrid").cache()
    by_line = {r.line_no: r for r in events.collect()}
    assert len(by_line) == 11
    assert by_line[1].ts == datetime(2031, 3, 4, 7, 0, 0, 500000)
    assert by_line[3].source == "C:\\etl\\load.py" and by_line[9].stages == "1"
    assert by_line[6].stage == "x | {y}" and by_line[6].message == "Stage started"
    assert by_line[12].message == "words without attributes" and by_line[12].run_id is None

    attributed = attribute_events(events).cache()
    at = lambda hour, minute: datetime(2031, 3, 4, hour, minute)
    runs = {r.line_no: (r.run_id, r.run_started_at) for r in attributed.collect()}
    east, west, again = ("east", at(7, 10)), ("west", at(7, 11)), ("east", at(7, 20))
    assert runs == {1: ("old", None), 2: east, 3: east, 4: east, 5: west, 6: west, 8: east, 9: west, 10: again, 11: again}

    durations = {(r.run_id, r.stage): r.duration_seconds for r in log_stage_durations(attributed).collect()}
    assert durations == {("east", "load"): 1.25, ("west", "x | {y}"): None}
    walls = {(r.run_id, r.run_started_at): (r.wall_seconds, r.stages_logged) for r in run_wall_times(attributed).collect()}
    assert walls == {("old", None): (None, 4), east: (120.0, None), west: (90.0, 1), again: (60.001, 0)}
    [failed] = failed_runs(attributed).collect()
    assert (failed.run_id, failed.run_started_at, failed.error) == (*east, "no disk")


def test_attribution_equals_a_plain_look_back(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for log, lines in {"hot": 3000, "small": 40}.items():
        at, run, start = datetime(2026, 1, 1), None, None
        numbers = sorted(rng.sample(range(10**6), lines))
        for line in numbers:
            at += rng.choice([timedelta(0), timedelta(0), timedelta(milliseconds=1), timedelta(minutes=25)])
            message = rng.choice(["Pipeline started", *["Stage started"] * 20])
            own = f"r{line}" if message == "Pipeline started" else None
            if own:
                run, start = own, at
            rows.append((log, line, at, message, own))
            expected[log, line] = (run, start)
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "log_file string, line_no bigint, ts timestamp_ntz, message string, run_id string")
    for size in (1, 20_000, 10**7):
        got = {(r.log_file, r.line_no): (r.run_id, r.run_started_at) for r in attribute_events(events, size).collect()}
        assert got == expected


def test_a_hot_id_looks_back_across_chunks(spark):
    rng = random.Random(5)
    rows, expected, starts = [], {}, {}
    at = datetime(2026, 1, 1)
    for line in sorted(rng.sample(range(10**6), 2000)):
        at += timedelta(milliseconds=rng.choice([-3, 0, 7]))
        own = rng.choice(["hot", "hot", "rare", "never"])
        started = own != "never" and rng.random() < (0.02 if own == "hot" else 0.2)
        ts = None if rng.random() < 0.05 else at
        if started and ts:
            starts[own] = ts
        rows.append(("log", line, ts, "Pipeline started" if started else "Pipeline failed", own))
        expected[line] = (own, starts.get(own))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "log_file string, line_no bigint, ts timestamp_ntz, message string, run_id string")
    for size in (1, 5_000, 10**7):
        got = {r.line_no: (r.run_id, r.run_started_at) for r in attribute_events(events, size).collect()}
        assert got == expected
