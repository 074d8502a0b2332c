"""Run records as tables: results, statuses, ids, parameters and manifests.

A result table has ``pipeline``, ``run_id``, ``seq`` (order of recording),
``name``, ``status``, ``started_at``, ``finished_at``, ``outputs``, ``stderr``,
``return_code`` and ``source``. An id may be used by several runs, one after
another, so a run is known by its start as well: ``with_runs`` adds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import merge_maps, seconds_between, strip
from ..sources.numbering import position_in_group

ID = ("pipeline", "run_id")
RUN = (*ID, "run_started_at")

# The states a stage and a run can be in.
STAGE_STATUSES = ("pending", "running", "succeeded", "failed", "skipped")
RUN_STATUSES = ("pending", "running", "succeeded", "failed")

# Fixed value: the error text of a failed process that wrote none.
_NO_STDERR = "Subprocess returned a non-zero exit code."

# The known parameters and their defaults.
PARAMETER_DEFAULTS = {
    "name": None,
    "backend": "python",
    "work_dir": None,
    "log_dir": "logs",
    "data_dir": "data",
    "allow_subprocess_fallback": "true",
    "python_executable": None,
}


def with_durations(results: DataFrame) -> DataFrame:
    """Add duration_seconds, never below 0."""
    return results.withColumn("duration_seconds", seconds_between("started_at", "finished_at"))


def with_succeeded(records: DataFrame) -> DataFrame:
    """Add succeeded, from the status of stages or runs."""
    return records.withColumn("succeeded", F.col("status") == "succeeded")


def with_exit_status(results: DataFrame) -> DataFrame:
    """Set status and error from return_code and stderr."""
    clean = F.col("return_code") == 0
    text = F.coalesce(F.nullif(strip("stderr"), F.lit("")), F.lit(_NO_STDERR))
    return results.withColumns(
        {
            "status": F.when(clean, "succeeded").otherwise("failed"),
            "error": F.when(~clean, text),
        }
    )


def with_result_defaults(results: DataFrame, source: Column, name: Column | None = None) -> DataFrame:
    """Fill an unset source and read a pending result as succeeded; a result is named as its
    stage, ``name``, whatever name it gives itself."""
    named = {} if name is None else {"name": name}
    return results.withColumns(
        named
        | {
            "source": F.coalesce("source", source),
            "status": F.when(F.col("status") == "pending", "succeeded").otherwise(F.col("status")),
        }
    )


def run_ids(runs: DataFrame, name: str, backend: str, at: str) -> DataFrame:
    """Add hash, short_hash and run_id from name, backend and the UTC time ``at``.

    ``at`` without a zone is taken as UTC. The hashed text has the time in ISO
    form, with microseconds only when there are any.
    """
    if runs.schema[at].dataType.typeName() == "timestamp":
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(at).cast("timestamp_ntz"))
    else:
        utc = F.col(at)
    text = utc.cast("string")
    day, time, fraction = F.left(text, F.lit(10)), F.substring(text, 12, 8), F.substring(text, 21, 6)
    micros = F.when(fraction == "", "").otherwise(
        F.concat(F.lit("."), F.rpad(fraction, 6, "0"))
    )
    iso = F.concat(day, F.lit("T"), time, micros, F.lit("+00:00"))
    digest = F.sha2(F.concat_ws(":", F.col(name), F.col(backend), iso), 256)
    stamp = F.concat(day, F.lit("_"), F.replace(time, F.lit(":"), F.lit("")))
    return (
        runs.withColumn("hash", digest)
        .withColumn("short_hash", F.left("hash", F.lit(8)))
        .withColumn("run_id", F.concat(stamp, F.lit("_"), "short_hash"))
    )


def run_parameters(configs: DataFrame, keep: Sequence[str] = ID) -> DataFrame:
    """Known parameters, metadata and extra keys as (…, key, value); the later wins.

    ``configs`` has the known parameters it sets as columns, and the maps
    ``metadata`` and ``extra``. A known key without a value gets its default. A
    ``metadata`` that is no map is the value of a key of that name.
    """
    metadata = F.col("metadata")
    if configs.schema["metadata"].dataType.typeName() != "map":
        metadata = F.create_map(F.lit("metadata"), metadata.cast("string"))
    known = []
    for key, default in PARAMETER_DEFAULTS.items():
        given = F.col(key).cast("string") if key in configs.columns else F.lit(None).cast("string")
        known += [F.lit(key), F.coalesce(given, F.lit(default))]
    merged = merge_maps(F.create_map(*known), merge_maps(metadata, F.col("extra")))
    return configs.select(*keep, F.explode(merged).alias("key", "value"))


def run_starts(registry: DataFrame | None, results: DataFrame) -> DataFrame:
    """Every run as (pipeline, run_id, run_started_at), once.

    These are the runs of ``registry``, and one for the results of an id that
    are recorded before its first known start: that run began with the first
    of them. Results without any time begin at the epoch.
    """
    began = F.coalesce(F.min(F.coalesce("started_at", "finished_at")), F.lit(0).cast("timestamp"))
    kind = results.schema["started_at"].dataType
    seen = results.groupBy(*ID).agg(began.cast(kind).alias("first"))
    if registry is None:
        return seen.withColumnRenamed("first", "run_started_at")
    known = registry.select(*RUN).where(F.col("run_started_at").isNotNull()).distinct()
    starts = known.groupBy(*ID).agg(F.min("run_started_at").alias("known"))
    early = seen.join(starts, [*ID], "left").where(F.col("known").isNull() | (F.col("first") < F.col("known")))
    return known.union(early.select(*ID, "first"))


def assign_runs(records: DataFrame, starts: DataFrame, at: Sequence[str], chunk_seconds: int = 86_400) -> DataFrame:
    """Add run_started_at: the start of the run of a record's id that began last before it.

    ``at`` are the columns of a record's time, the first that is set counts; a
    start at the same time is before it. A record without a time belongs to the
    first run of its id, one of an id without a start to none (null).

    Records and starts meet in chunks of time, so an id that holds much of the
    table is cut up; one row per chunk and id carries the last start onwards.
    """
    time, when = F.coalesce(*at), F.col("_at")
    chunk = F.floor(F.unix_seconds(when.cast("timestamp")) / chunk_seconds).alias("_chunk")
    kind = starts.schema["run_started_at"].dataType
    asked = records.select(*ID, F.struct("*").alias("_record"), time.cast(kind).alias("_at"), F.lit(None).cast(kind).alias("_start"))
    first = starts.groupBy(*ID).agg(F.min("run_started_at").alias("_first"))
    nothing = F.lit(None).cast(asked.schema["_record"].dataType).alias("_record")
    began = starts.select(*ID, nothing, F.col("run_started_at").alias("_at"), F.col("run_started_at").alias("_start"))
    both = asked.union(began).select("*", chunk)
    key = [*ID, "_chunk"]
    before = Window.partitionBy(*ID).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*key).agg(F.max("_start").alias("_start"))
    carried = carried.select(*key, F.max("_start").over(before).alias("_carried"))
    # Rows of one time stand together in the frame, so a start counts for a record of its time.
    within = Window.partitionBy(*key).orderBy("_at")
    met = both.select(*key, "_record", "_at", F.max("_start").over(within).alias("_within"))
    found = met.where(F.col("_record").isNotNull()).join(carried, key, "left").join(first, [*ID], "left")
    return found.select(
        "_record.*", F.coalesce(F.when(when.isNotNull(), F.coalesce("_within", "_carried")), "_first").alias("run_started_at")
    )


def with_runs(results: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Results with the start of their run; ``registry`` has pipeline, run_id and run_started_at
    of the runs known to have begun."""
    return assign_runs(results, run_starts(registry, results), ["started_at", "finished_at"])


def last_results(results: DataFrame) -> DataFrame:
    """The last recorded result per run and stage name.

    Only the numbers are aggregated, by hashing; whole rows would have to be sorted.
    """
    last = results.groupBy(*RUN, "name").agg(F.max("seq").alias("seq"))
    return results.join(last, [*RUN, "name", "seq"], "left_semi")


def result_for(results: DataFrame, stage: str) -> DataFrame:
    """The first result of the named stage in each run; runs without one have no row."""
    of_stage = results.where(F.col("name") == stage)
    first = of_stage.groupBy(*RUN).agg(F.min("seq").alias("seq"))
    return of_stage.join(first, [*RUN, "seq"], "left_semi")


def recorded_paths(results: DataFrame, runs: DataFrame, stage: str, field: str, default: str) -> DataFrame:
    """RUN and path for every row of ``runs``: ``field`` of the JSON outputs of the stage's last
    result in the run; the default where there is no such result, or it names no path."""
    last = last_results(results.where(F.col("name") == stage))
    named = last.select(*RUN, F.nullif(F.get_json_object("outputs", f"$.{field}"), F.lit("")).alias("path"))
    return runs.select(*RUN).join(named, [*RUN], "left").withColumn("path", F.coalesce("path", F.lit(default)))


def run_statuses(results: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """One row per run: failed if any stage failed, else succeeded; with its time span.

    ``starts`` adds the runs that have no result, ``ends`` (RUN, ended_at, status)
    what a log or a scheduler says about the end of runs: a run that is said to
    have failed has failed; one without results has the status said, else it is
    running.
    """
    failed = F.max((F.col("status") == "failed").cast("int")) == 1
    runs = results.groupBy(*RUN).agg(
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("completed_at"),
        F.count(F.lit(1)).alias("stages"),
    )
    if starts is not None:
        runs = runs.join(starts.select(*RUN), [*RUN], "full_outer")
    if ends is not None:
        said = ends.groupBy(*RUN).agg(
            F.max("ended_at").alias("_ended"),
            F.when(failed, "failed").when(F.count(F.when(F.col("status") == "succeeded", 1)) > 0, "succeeded").alias("_said"),
        )
        runs = runs.join(said, [*RUN], "full_outer").withColumns(
            {
                "status": F.when(F.col("_said") == "failed", "failed").otherwise(F.coalesce("status", "_said")),
                "completed_at": F.coalesce(F.greatest("completed_at", "_ended"), "_ended"),
            }
        )
    runs = runs.select(
        *RUN,
        F.coalesce("status", F.lit("running")).alias("status"),
        F.coalesce("started_at", "run_started_at").alias("started_at"),
        "completed_at",
        F.coalesce("stages", F.lit(0).cast("long")).alias("stages"),
    )
    return with_succeeded(runs)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run started last in each pipeline; of equal starts the greatest run_id.

    Times are aggregated by hashing; only runs that tie for the last are put in order.
    """
    last = runs.groupBy("pipeline").agg(F.max("run_started_at").alias("run_started_at"))
    tied = runs.join(last, ["pipeline", "run_started_at"], "left_semi")
    order = Window.partitionBy("pipeline").orderBy(F.desc("run_id"))
    return tied.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).select(*runs.columns)


def run_manifest(results: DataFrame) -> DataFrame:
    """The stages of each run in order: (pipeline, run_id, run_started_at, place, name, outputs).

    The long form of a manifest's ``stages_run`` list, whole for a run of any
    length. ``last`` marks the rows of its ``outputs`` map, which keeps the last
    result of a name.
    """
    latest = results.groupBy(*RUN, "name").agg(F.max("seq").alias("_latest"))
    placed = position_in_group(
        results.select(*RUN, "seq", "name", "outputs"), list(RUN), ["seq"], "place"
    )
    return placed.join(latest, [*RUN, "name"]).select(
        *RUN, "place", "name", "outputs", (F.col("seq") == F.col("_latest")).alias("last")
    )


def upstream_outputs(edges: DataFrame, results: DataFrame) -> DataFrame:
    """What each executed stage finds recorded for its dependencies; null if nothing.

    ``edges`` has pipeline, name and dependency. Rows start from results, so
    their number is results times dependencies of one stage.
    """
    last = last_results(results)
    asked = last.select(*RUN, "name").join(edges, ["pipeline", "name"])
    upstream = last.select(
        *RUN,
        F.col("name").alias("dependency"),
        F.col("status").alias("upstream_status"),
        F.col("outputs").alias("upstream_outputs"),
    )
    return asked.join(upstream, [*RUN, "dependency"], "left").select(
        *RUN, "name", "dependency", "upstream_status", "upstream_outputs"
    )


def stages_not_run(planned: DataFrame, results: DataFrame, runs: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """Planned stages (pipeline, name) that a run which ended badly or not at all never reached.

    ``runs`` are run statuses; those that failed or are running count, by default
    the failed ones among the results. A run meets each planned stage once: the
    rows are the run's own results plus the rows returned. A pipeline with many
    runs is cut up by ``salts``, in each of which its planned stages stand once.
    """
    runs = run_statuses(results) if runs is None else runs
    short = runs.where(F.col("status").isin("failed", "running")).select(*RUN)
    short = short.withColumn("_salt", F.pmod(F.xxhash64(*RUN), F.lit(salts)).cast("int"))
    copies = planned.select("pipeline", "name").distinct()
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        short.join(copies, ["pipeline", "_salt"])
        .join(results.select(*RUN, "name"), [*RUN, "name"], "left_anti")
        .select(*RUN, "name")
    )


def unknown_statuses(records: DataFrame, allowed: Sequence[str] = STAGE_STATUSES) -> DataFrame:
    """Records whose status is none of the allowed values."""
    known = F.coalesce(F.col("status").isin(*allowed), F.lit(False))
    return records.where(~known)
