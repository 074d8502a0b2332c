"""Runs and stages from event logs.

Starts, failures and completions name their run. Stage events name none: a stage
event belongs to the last run started before it in its log. One log may hold much of all events, so that look-back never
runs over a whole log in one task (see ``attribute_events``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds_between

# The messages written while a run is on.
RUN_MESSAGES = (
    "Pipeline started",
    "Executing stage",
    "Stage started",
    "Stage finished",
    "Pipeline failed",
    "Pipeline completed",
)
_STARTED, _EXECUTING, _STAGE_STARTED, _STAGE_FINISHED, _FAILED, _COMPLETED = RUN_MESSAGES

LOG_RUN = ("log_file", "run_id", "run_started_at")

# Lines of one log that share a window.
_CHUNK_LINES = 100_000


def attribute_events(events: DataFrame, chunk_lines: int = _CHUNK_LINES) -> DataFrame:
    """Give each event of a run the run_id and start of the run it belongs to.

    An event that names its run keeps that id, and takes the last start of the id
    at or before it in the log, null if there is none (a log that begins in the
    middle of a run). Other events take id and start of the last run started.
    Messages from outside a run are left out. Runs are told apart by id and
    start, as one id can be used again. Order is line order: log times are
    local, so they tie and can step back, while lines are written in turn.

    A log is cut into chunks of ``chunk_lines`` line numbers. A look back runs inside
    each chunk, over all lines for the unnamed events and by id for the named ones; what a
    chunk hands on is one narrow row per log, and one per log and id it names. So no
    task sorts a whole log, even where one id is in all of it. ``events`` is read six
    times, four of them for a few narrow columns: give it a stored table, not text still
    to be parsed.
    """
    started = F.col("message") == _STARTED
    marked = events.where(F.col("message").isin(*RUN_MESSAGES)).withColumn(
        "_chunk", F.floor(F.col("line_no") / chunk_lines)
    )
    chunk = ["log_file", "_chunk"]
    earlier = Window.partitionBy("log_file").orderBy("_chunk")
    carried = (
        marked.groupBy(*chunk)
        .agg(F.max(F.when(started, F.col("line_no"))).alias("_start"))
        .select(
            *chunk,
            F.last("_start", ignorenulls=True)
            .over(earlier.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_start_line"),
        )
    )
    run = F.struct("run_id", F.col("ts").alias("run_started_at"))
    starts = marked.where(started).select(
        "log_file", F.col("line_no").alias("_start_line"), run.alias("_earlier")
    )
    before = carried.join(starts, ["log_file", "_start_line"]).select(*chunk, "_earlier")
    so_far = F.last(F.when(started, run), ignorenulls=True).over(
        Window.partitionBy(*chunk)
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = [c for c in events.columns if c != "run_id"]
    named = F.col("run_id").isNotNull()
    by_id = [*chunk, "run_id"]
    start_line = F.when(started & F.col("ts").isNotNull(), F.col("line_no"))
    handed_on = (
        marked.where(named)
        .groupBy(*by_id)
        .agg(F.max_by("ts", start_line).alias("_start"))
        .select(
            *by_id,
            F.last("_start", ignorenulls=True)
            .over(
                Window.partitionBy("log_file", "run_id")
                .orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1)
            )
            .alias("_before"),
        )
        .where(F.col("_before").isNotNull())
    )
    own_start = F.last(F.when(started, F.col("ts")), ignorenulls=True).over(
        Window.partitionBy(*by_id)
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    own = (
        marked.where(named)
        .withColumn("_own", own_start)
        .join(handed_on, by_id, "left")
        .select(*kept, "run_id", F.coalesce("_own", "_before").alias("run_started_at"))
    )
    others = (
        marked.withColumn("_latest", so_far)
        .where(~named)
        .join(before, chunk, "left")
        .withColumn("_run", F.coalesce("_latest", "_earlier"))
        .select(*kept, "_run.run_id", "_run.run_started_at")
    )
    return own.unionByName(others)


def log_stage_durations(attributed: DataFrame) -> DataFrame:
    """Start, finish and seconds per stage of a run; unfinished stages keep null."""
    message = F.col("message")
    times = (
        attributed.where(message.isin(_STAGE_STARTED, _STAGE_FINISHED))
        .groupBy(*LOG_RUN, "stage")
        .agg(
            F.min(F.when(message == _STAGE_STARTED, F.col("ts"))).alias("started_at"),
            F.max(F.when(message == _STAGE_FINISHED, F.col("ts"))).alias("finished_at"),
        )
    )
    return times.withColumn("duration_seconds", seconds_between("started_at", "finished_at"))


def run_wall_times(attributed: DataFrame) -> DataFrame:
    """Per run: when it ended, its wall seconds, finished stages, and the stage count it logged."""
    message = F.col("message")
    ended = F.when(message.isin(_FAILED, _COMPLETED), F.col("ts"))
    runs = (
        attributed.where(F.col("run_id").isNotNull())
        .groupBy(*LOG_RUN)
        .agg(
            F.max(ended).alias("completed_at"),
            F.count(F.when(message == _STAGE_FINISHED, F.lit(1))).alias("stages_finished"),
            F.max(
                F.when(message == _COMPLETED, F.col("stages").try_cast("bigint"))
            ).alias("stages_logged"),
        )
    )
    return runs.withColumn("wall_seconds", seconds_between("run_started_at", "completed_at"))


def failed_runs(attributed: DataFrame) -> DataFrame:
    """The failure events: run, name, time and error."""
    return attributed.where(F.col("message") == _FAILED).select(
        *LOG_RUN, "line_no", F.col("ts").alias("failed_at"), "name", "error"
    )
