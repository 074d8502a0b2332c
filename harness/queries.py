"""One query per operator, each over whole tables, with flat result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderledger.functions import append_names, positive_number, title_case
from orderledger.operators import (
    cleaning,
    log_history,
    reports,
    rules,
    run_history,
    stage_graph,
)
from orderledger.plans import (
    retail_frames,
    run_retail,
    write_manifests,
    write_sales_summary,
    write_validation_report,
)
from orderledger.sources import (
    CLEAN_COLUMNS,
    REGION_COLUMNS,
    REQUIRED_COLUMNS,
    number_files,
    parse_log_lines,
    position_in_group,
    read_clean_orders,
    read_json_documents,
    read_numbered_orders,
    read_raw_orders,
    read_recorded,
    scratch_path,
    stage_table,
    write_csv,
)

from . import staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _text_time(df: DataFrame, *columns: str) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss.SSS"
    return df.withColumns({c: F.date_format(c, form) for c in columns})


# --- raw orders: scans, scalar functions, rules, cleaning ---------------------------------


@query
def q_scan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two column orders, some records of which have line breaks inside quotes."""
    path = scratch_path(spark, "scan-orders")
    rows = staging.raw_orders(spark, sf_dir)
    key = F.col("order_id").cast("bigint")
    broken = F.when(key % 31 == 0, F.concat("customer_name", F.lit('\n "second" line,')))
    rows = rows.withColumn("customer_name", F.coalesce(broken, "customer_name"))
    write_csv(rows.where(key % 2 == 0), f"{path}/first", REQUIRED_COLUMNS)
    write_csv(rows.where(key % 2 == 1), f"{path}/second", REQUIRED_COLUMNS[::-1])
    return read_raw_orders(spark, [f"{path}/first", f"{path}/second"]).select(
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in REQUIRED_COLUMNS]
    )


@query
def q_record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written in key order: a record's number has to follow from the keys before it."""
    path = scratch_path(spark, "record-numbers")
    key = F.col("order_id").cast("bigint")
    write_csv(staging.raw_orders(spark, sf_dir).sortWithinPartitions(key), path, REQUIRED_COLUMNS)
    numbered = read_numbered_orders(spark, path).select("source_file", "row_number", key.alias("key"))
    placed = position_in_group(numbered, ["source_file"], ["key"], "place", start=2)
    wrong = F.col("place") != F.col("row_number")
    return placed.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(wrong, F.lit(1))).alias("misnumbered"))


@query
def q_blank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.blank_counts(staging.raw_orders(spark, sf_dir))


@query
def q_positive_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.raw_orders(spark, sf_dir).select(
        "order_id",
        positive_number("quantity").alias("quantity"),
        positive_number("unit_price").alias("unit_price"),
    )


@query
def q_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("customer_name", "region", "product")
    return staging.raw_orders(spark, sf_dir).select(
        "order_id", *[title_case(c).alias(c) for c in columns]
    )


@query
def q_row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.order_issues(staging.raw_orders(spark, sf_dir))


@query
def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = rules.region_profile(staging.raw_orders(spark, sf_dir))
    return rules.validation_report(profile)


@query
def q_unique_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unique_regions(rules.region_profile(staging.raw_orders(spark, sf_dir)))


@query
def q_clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_orders(staging.raw_orders(spark, sf_dir))
    return _doubles(clean, "unit_price", "order_value")


@query
def q_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rejected_orders(staging.raw_orders(spark, sf_dir))


@query
def q_clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_orders(staging.raw_orders(spark, sf_dir))
    return _doubles(reports.clean_summary(clean), "total_revenue", "average_order_value")


@query
def q_clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_values(cleaning.clean_orders(staging.raw_orders(spark, sf_dir)))


@query
def q_orders_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_orders(staging.raw_orders(spark, sf_dir), keep=["row_number"])
    ordered = reports.orders_by_date(clean, "row_number")
    return ordered.select("order_date", "row_number", "order_id", "region")


@query
def q_sink_clean_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_orders(staging.raw_orders(spark, sf_dir))
    path = write_csv(clean, scratch_path(spark, "clean-csv"), CLEAN_COLUMNS)
    return _doubles(read_clean_orders(spark, path), "unit_price", "order_value")


@query
def q_sink_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = retail_frames(staging.raw_orders(spark, sf_dir))
    path = write_validation_report(frames, sf_dir, scratch_path(spark, "report"))
    document = spark.read.json(path + "/document", multiLine=True)
    listed = spark.read.schema("message string").json(path + "/issues").agg(F.count(F.lit(1))).scalar()
    regions = spark.read.schema("region string").json(path + "/unique_regions")
    return document.select(
        "record_count",
        "issue_count",
        listed.alias("listed_issues"),
        "passed",
        "first_order_date",
        "last_order_date",
        regions.agg(F.array_join(F.array_sort(F.collect_list("region")), "|")).scalar().alias("unique_regions"),
    )


@query
def q_validate_clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from CSV to written outputs, read back in long form."""
    raw_path = scratch_path(spark, "chain-raw")
    write_csv(staging.raw_orders(spark, sf_dir), raw_path, REQUIRED_COLUMNS)
    paths = run_retail(spark, raw_path, scratch_path(spark, "chain"))

    def scalars(path: str, *names: str) -> DataFrame:
        document = spark.read.json(paths[path] + "/document", multiLine=True)
        values = document.select(*[F.col(n).cast("double").alias(n) for n in names])
        return values.unpivot([], list(names), "item", "value")

    regions = spark.read.csv(paths["region_breakdown_path"], header=True)
    return (
        scalars("report_path", "record_count", "issue_count")
        .union(scalars("clean_summary_path", "row_count", "average_order_value"))
        .union(scalars("summary_path", "total_orders", "total_revenue"))
        .union(
            regions.select(
                F.concat(F.lit("revenue "), F.coalesce("region", F.lit(""))),
                F.col("revenue").cast("double"),
            )
        )
    )


# --- sales: grouped reports ----------------------------------------------------------------


@query
def q_revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = reports.sales_by(staging.sales(spark, sf_dir), "region")
    return _doubles(grouped.select("region", "revenue"), "revenue")


@query
def q_orders_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = reports.sales_by(staging.sales(spark, sf_dir), "region")
    return grouped.select("region", "orders")


@query
def q_units_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = staging.sales(spark, sf_dir)
    units = F.col("units").cast("bigint").alias("units")
    return reports.sales_by(clean, "product").select("product", units)


@query
def q_revenue_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = staging.sales(spark, sf_dir)
    return _doubles(reports.sales_by(clean, "product").select("product", "revenue"), "revenue")


@query
def q_sales_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    breakdown = reports.sales_breakdown(staging.sales(spark, sf_dir), "order_id")
    columns = ["dimension", "key", "orders", F.col("units").cast("bigint").alias("units"), "revenue"]
    return _doubles(breakdown.select(*columns), "revenue")


@query
def q_sales_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = reports.sales_totals(staging.sales(spark, sf_dir))
    totals = totals.withColumn("total_units", F.col("total_units").cast("bigint"))
    return _doubles(totals, "total_revenue")


@query
def q_sales_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    breakdown = reports.sales_breakdown(staging.sales(spark, sf_dir), "order_id")
    return _doubles(reports.summary_row(breakdown), "total_revenue")


@query
def q_sales_summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's four maps as (field, key, value)."""
    long = reports.sales_summary_long(
        reports.sales_breakdown(staging.sales(spark, sf_dir), "order_id")
    ).where(F.col("dimension") != "total")
    values = long.select(
        "dimension", "key", *[F.col(m).cast("double").alias(m) for m in ("orders", "units", "revenue")]
    ).unpivot(["dimension", "key"], ["orders", "units", "revenue"], "measure", "value")
    field = F.concat("measure", F.lit("_by_"), "dimension")
    kept = ["revenue_by_region", "orders_by_region", "units_by_product", "revenue_by_product"]
    return values.select(field.alias("field"), "key", "value").where(F.col("field").isin(kept))


@query
def q_top_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = staging.sales(spark, sf_dir)
    grouped = reports.sales_by(clean, "region", "order_id")
    return _doubles(reports.top_key(grouped, "region"), "revenue")


@query
def q_top_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = staging.sales(spark, sf_dir)
    grouped = reports.sales_by(clean, "product", "order_id")
    return _doubles(reports.top_key(grouped, "product"), "revenue")


@query
def q_top_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of equal value in three folders of files: each region's first product, and the top
    product of all, are told by date, file and record."""
    path = scratch_path(spark, "tied-orders")
    key = F.col("order_id").cast("bigint")
    tied = staging.raw_orders(spark, sf_dir).withColumns(
        {
            "product": F.concat(F.lit("item "), "order_id"),
            "quantity": F.lit("1"),
            "unit_price": F.lit("5.00"),
            "order_date": F.concat(F.left("order_date", F.lit(5)), F.lit("01-01")),
        }
    )
    for part in range(3):
        rows = tied.where(key % 3 == 2 - part).repartitionByRange(key).sortWithinPartitions(key)
        write_csv(rows, f"{path}/{part}", REQUIRED_COLUMNS)
    raw = stage_table(read_numbered_orders(spark, [f"{path}/{part}" for part in range(3)]), "tied-orders")
    place = ["file_number", "row_number"]
    clean = cleaning.clean_orders(number_files(raw), keep=place)
    grouped = reports.sales_by(clean, "product", "row_number", "file_number")
    top = reports.top_key(grouped, "product").select(F.lit("all").alias("region"), "product")
    seen = reports.first_seen("order_date", "row_number", "file_number")
    first = clean.groupBy("region").agg(F.min(seen).alias("seen"))
    rows = clean.select("region", "product", seen.alias("seen"))
    return rows.join(first, ["region", "seen"], "left_semi").select("region", "product").union(top)


@query
def q_region_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = reports.sales_by(staging.sales(spark, sf_dir), "region")
    path = scratch_path(spark, "region-csv")
    write_csv(reports.region_breakdown(grouped), path, REGION_COLUMNS)
    back = spark.read.csv(path, header=True)
    return back.select(
        "region", F.col("orders").cast("bigint").alias("orders"), F.col("revenue").cast("double").alias("revenue")
    )


@query
def q_sink_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    breakdown = reports.sales_breakdown(staging.sales(spark, sf_dir), "order_id")
    path = write_sales_summary(stage_table(breakdown, "breakdown"), scratch_path(spark, "summary"))
    schema = (
        "total_orders bigint, total_revenue decimal(38,2), top_region string, top_product string, "
        "first_order_date string, last_order_date string"
    )
    document = spark.read.schema(schema).json(path + "/document", multiLine=True)
    units = spark.read.schema("product string, units bigint").json(path + "/units_by_product")
    revenues = spark.read.schema("region string, revenue decimal(38,2)").json(path + "/revenue_by_region")
    document = document.join(units, F.col("top_product") == units["product"], "left")
    document = document.join(revenues, F.col("top_region") == revenues["region"], "left")
    return document.select(
        "total_orders",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        "top_region",
        "top_product",
        "first_order_date",
        "last_order_date",
        units.agg(F.count(F.lit(1))).scalar().alias("products"),
        F.col("units").alias("top_product_units"),
        F.col("revenue").cast("double").alias("top_region_revenue"),
    )


# --- stage tables ----------------------------------------------------------------------------


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.normalized_stages(staging.stages(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.place_stages(stage_graph.orderable_stages(_stages(spark, sf_dir)))


@query
def q_dep_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).select(
        "pipeline_id", "position", "name", F.array_join("dependencies", ",").alias("dependencies")
    )


@query
def q_dep_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.array(F.lit(" audit "), F.concat(F.lit("stage_"), (F.col("i") - 3).cast("string")))
    return staging.stages(spark, sf_dir).select(
        "pipeline_id",
        "position",
        F.array_join(append_names(F.col("dependencies"), more), ",").alias("dependencies"),
    )


@query
def q_dep_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = staging.stages(spark, sf_dir).select(
        "pipeline_id", "i", "name", F.concat(F.lit("/jobs/"), "name", F.lit(".v1.py")).alias("path")
    )
    own = F.concat(F.lit("stage_"), F.col("i").cast("string"))
    form, path = F.col("i") % 5, F.concat(F.lit("/jobs/"), own, F.lit(".v1.py"))
    key = (
        F.when(form == 0, own)
        .when(form == 1, F.concat(own, F.lit(".v1.py")))
        .when(form == 2, F.concat(own, F.lit(".v1")))
        .when(form == 3, path)
        .otherwise(F.concat(F.lit("unused_"), own))
    )
    named = stages.select("pipeline_id", key.alias("key"), F.array(F.concat(F.lit("dep_"), own)).alias("dependencies"))
    # A second key that only counts when no earlier form is there.
    by_path = stages.where(form != 3).select(
        "pipeline_id", path.alias("key"), F.array(F.concat(F.lit("late_"), own)).alias("dependencies")
    )
    found = stage_graph.lookup_dependencies(stages, named.union(by_path))
    return found.withColumn("dependencies", F.array_join("dependencies", ","))


@query
def q_duplicate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.duplicate_stages(_stages(spark, sf_dir))


@query
def q_missing_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = stage_graph.missing_dependencies(_stages(spark, sf_dir))
    return missing.select("pipeline_id", "position", "name", "dependency", "message")


@query
def q_dep_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.stage_levels(_placed(spark, sf_dir))


@query
def q_topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.topological_order(_placed(spark, sf_dir))


@query
def q_cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.unresolved_stages(_placed(spark, sf_dir))


@query
def q_graph_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.graph_verdicts(_stages(spark, sf_dir))


@query
def q_graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.graph_findings(_stages(spark, sf_dir))


@query
def q_stage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, i = F.col("pipeline_id"), F.col("i")
    stages = staging.stages(spark, sf_dir).select(
        "pipeline_id",
        "position",
        F.when((graph + i) % 11 == 0, " ").otherwise(F.col("name")).alias("name"),
        F.when((graph + i) % 3 != 0, "job.py").alias("source"),
    )
    return stage_graph.stage_issues(stages)


@query
def q_run_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_graph.stage_inputs(_stages(spark, sf_dir))


# --- stage results -----------------------------------------------------------------------------


@query
def q_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = run_history.with_durations(staging.stage_results(spark, sf_dir))
    return results.select("run_id", "seq", "name", "duration_seconds")


@query
def q_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = staging.stage_results(spark, sf_dir).select(
        "seq", "pipeline", F.lit("python").alias("backend"), "started_at"
    )
    ids = run_history.run_ids(runs, "pipeline", "backend", "started_at")
    return ids.select("seq", "run_id", "hash", "short_hash")


@query
def q_exit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = run_history.with_exit_status(staging.stage_results(spark, sf_dir))
    return results.select("seq", "return_code", "status", "error")


@query
def q_result_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which some give themselves another name than their stage's."""
    results = staging.stage_results(spark, sf_dir).withColumn("stage", F.col("name"))
    named = results.withColumn("name", F.when(F.col("seq") % 9 == 0, "other").otherwise(F.col("name")))
    source = F.concat(F.lit("default_"), "stage")
    return run_history.with_result_defaults(named, source, F.col("stage")).select("seq", "name", "source", "status")


@query
def q_run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_history.run_parameters(staging.run_configs(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = staging.run_registry(spark, sf_dir)
    return run_history.with_runs(staging.stage_results(spark, sf_dir), registry)


def _statuses(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    starts = run_history.run_starts(staging.run_registry(spark, sf_dir), staging.stage_results(spark, sf_dir))
    ends = run_history.assign_runs(staging.run_ends(spark, sf_dir), starts, ["ended_at"])
    return run_history.run_statuses(results, starts, ends)


@query
def q_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of reused ids, told apart by their start, and runs without a result."""
    runs = _statuses(spark, sf_dir, _results(spark, sf_dir))
    return _text_time(runs, "run_started_at", "started_at", "completed_at")


@query
def q_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(run_history.run_manifest(_results(spark, sf_dir)), "run_started_at")


@query
def q_sink_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all runs, written and read back: a row for each stage a run lists, and
    one for a run that lists none."""
    results = stage_table(_results(spark, sf_dir), "run-results")
    runs = _text_time(_statuses(spark, sf_dir, results), "run_started_at").drop("started_at", "completed_at")
    results = _text_time(results, "run_started_at")
    path = write_manifests(results, runs, scratch_path(spark, "manifests"), digits=1)
    part = "struct<folder: string, rows: bigint>"
    fields = f"pipeline string, run_id string, run_started_at string, status string, stages_run {part}, outputs {part}"
    documents = read_json_documents(spark, path, "document", fields).select(
        "document", *run_history.RUN, "status",
        F.col("stages_run.rows").alias("stages_listed"), F.col("outputs.rows").alias("outputs_listed"),
    )
    listed = read_json_documents(spark, path, "stages_run", "place bigint, name string").drop("shard")
    last = read_json_documents(spark, path, "outputs", "name string, outputs string").drop("shard")
    joined = documents.join(listed, "document", "left").join(last, ["document", "name"], "left")
    return joined.drop("document")


@query
def q_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = run_history.latest_runs(_statuses(spark, sf_dir, _results(spark, sf_dir)))
    return _text_time(latest, "run_started_at").select("pipeline", "run_id", "run_started_at", "status", "stages")


@query
def q_result_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = run_history.result_for(_results(spark, sf_dir), "stage_3")
    return _text_time(first, "run_started_at").select("pipeline", "run_id", "run_started_at", "seq", "status", "outputs")


@query
def q_results_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = run_history.last_results(_results(spark, sf_dir))
    columns = ("pipeline", "run_id", "run_started_at", "name", "seq", "status", "outputs")
    return _text_time(last, "run_started_at").select(*columns)


@query
def q_upstream_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = stage_table(_results(spark, sf_dir), "run-results")
    number = F.substring("name", 7, 10).cast("int")
    edges = (
        results.select("pipeline", "name")
        .distinct()
        .select("pipeline", "name", F.explode(F.array(number - 1, number - 2)).alias("upstream"))
        .where(F.col("upstream") >= 0)
        .select("pipeline", "name", F.concat(F.lit("stage_"), F.col("upstream").cast("string")).alias("dependency"))
    )
    return _text_time(run_history.upstream_outputs(edges, results), "run_started_at")


@query
def q_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every run takes in from its upstream stage: the rows at the path that it recorded.

    All orders stand in five folders; runs record four of them, and the fifth is the default.
    """
    folder = scratch_path(spark, "handoff")
    raw = stage_table(staging.raw_orders(spark, sf_dir), "handoff-orders")
    for part in range(5):
        write_csv(raw.where(F.col("order_id").cast("bigint") % 5 == part), f"{folder}/part {part}", REQUIRED_COLUMNS)
    place = F.concat(F.lit(f"{folder}/part "), (F.col("seq") % 5).cast("string"))
    outputs = F.when(F.col("seq") % 5 != 4, F.to_json(F.struct(place.alias("raw_path")))).otherwise("{}")
    results = stage_table(_results(spark, sf_dir).withColumn("outputs", outputs), "handoff-results")
    runs = results.select(*run_history.RUN).distinct()
    paths = stage_table(run_history.recorded_paths(results, runs, "stage_1", "raw_path", f"{folder}/part 4"), "handoff-paths")
    totals = read_recorded(paths).groupBy("path").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("order_id").cast("bigint")).alias("id_sum")
    )
    taken = paths.join(totals, "path", "left")
    columns = (*run_history.RUN, F.right("path", F.lit(6)).alias("part"), "records", "id_sum")
    return _text_time(taken.select(*columns), "run_started_at")


@query
def q_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned stages that failed runs, and runs that recorded nothing, did not reach."""
    results = stage_table(_results(spark, sf_dir), "run-results")
    names = F.explode(F.array(*[F.lit(f"stage_{i}") for i in range(6)]))
    planned = results.select("pipeline").distinct().select("pipeline", names.alias("name"))
    missed = run_history.stages_not_run(planned, results, _statuses(spark, sf_dir, results))
    return _text_time(missed, "run_started_at")


# --- event logs ----------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log_lines(staging.log_lines(spark, sf_dir))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parsed once into a stored table, which the look back then reads.
    events = stage_table(_events(spark, sf_dir), "log-events")
    return log_history.attribute_events(events)


@query
def q_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["log_file", "line_no", "ts", "message", "run_id", "name", "stage", "mode", "status", "stages", "error"]
    return _text_time(_events(spark, sf_dir).select(*columns), "ts")


@query
def q_log_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributed = _attributed(spark, sf_dir)
    columns = ["log_file", "line_no", "message", "run_id", "run_started_at"]
    return _text_time(attributed.select(*columns), "run_started_at")


@query
def q_log_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributed = _attributed(spark, sf_dir)
    durations = log_history.log_stage_durations(attributed)
    return durations.select("log_file", "run_id", "stage", "duration_seconds")


@query
def q_run_wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributed = _attributed(spark, sf_dir)
    runs = log_history.run_wall_times(attributed)
    return runs.select("log_file", "run_id", "wall_seconds", "stages_finished", "stages_logged")


@query
def q_failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributed = _attributed(spark, sf_dir)
    failed = log_history.failed_runs(attributed)
    return failed.select("log_file", "line_no", "run_id", "name", "error")
