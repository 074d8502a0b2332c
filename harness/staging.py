"""The library's input tables, derived by Spark from the test tables.

Each frame covers its whole source tables; the CASE expressions seed dirt, they
do not choose rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(number: Column, values: dict[int, Column | None], otherwise: Column) -> Column:
    chosen = otherwise
    for value, result in values.items():
        result = F.lit(None).cast("string") if result is None else result
        chosen = F.when(number == value, result).otherwise(chosen)
    return chosen


def _customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "r_name")
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text orders with seeded blanks, padding, words and odd numbers."""
    key = F.col("o_orderkey")
    number = (key % 50 + 1).cast("string")
    text = F.lit
    return (
        table(spark, sf_dir, "orders")
        .join(_customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            (key + 2).alias("row_number"),
            key.cast("string").alias("order_id"),
            F.when(key % 23 == 0, "   ").otherwise(F.col("c_name")).alias("customer_name"),
            F.when(key % 29 == 0, F.lit(None).cast("string"))
            .when(key % 5 == 0, F.concat(text(" "), F.lower("r_name"), text(" ")))
            .otherwise(F.col("r_name"))
            .alias("region"),
            F.col("o_orderpriority").alias("product"),
            _choice(
                key % 13,
                {
                    0: text(""),
                    1: text("  "),
                    2: text("-1"),
                    3: text("0"),
                    4: text("abc"),
                    5: text("nan"),
                    6: text("2.5"),
                    7: F.concat(text(" "), number, text(" ")),
                },
                number,
            ).alias("quantity"),
            _choice(
                key % 17,
                {0: text(""), 1: text("0"), 2: text("-3.5")},
                F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
            ).alias("unit_price"),
            F.when(key % 19 == 0, "")
            .otherwise(F.col("o_orderdate").cast("date").cast("string"))
            .alias("order_date"),
        )
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean sales table: every lineitem with its order, customer, region and part."""
    quantity = F.col("l_quantity").cast("bigint")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("r_name").alias("region"),
            F.col("p_name").alias("product"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            quantity.alias("quantity"),
            price.alias("unit_price"),
            (quantity * price).cast("decimal(18,2)").alias("order_value"),
        )
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stages per graph; some graphs with a double name, an unknown dependency or a cycle."""
    graph = F.floor(F.col("p_partkey") / 10).cast("bigint")
    stage = (F.col("p_partkey") % 10).cast("int")
    numbered = table(spark, sf_dir, "part").select(graph.alias("pipeline_id"), stage.alias("i"))
    graph, i, text = F.col("pipeline_id"), F.col("i"), F.lit

    def named(number: Column) -> Column:
        return F.concat(text("stage_"), number.cast("string"))

    base = (
        F.when(i == 0, "")
        .when(i <= 2, " stage_0 ")
        .otherwise(
            F.concat(named(i - 2), text(", "), named(i - 3), text(",,"), named(i - 2))
        )
    )
    ghost = F.when((graph % 7 == 2) & (i == 9), ",ghost").otherwise("")
    cycle = F.when((graph % 7 == 5) & (i == 2), ",stage_6").otherwise("")
    return numbered.select(
        "pipeline_id",
        "i",
        F.when(graph % 2 == 1, 9 - i).otherwise(i).alias("position"),
        F.when((graph % 7 == 3) & (i == 5), "stage_4").otherwise(named(i)).alias("name"),
        F.split(F.concat(base, ghost, cycle), ",").alias("dependencies"),
    )


def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage result per event; names repeat within a run."""
    event, failed = F.col("event_id"), F.col("event_type") == "error"
    name = F.concat(F.lit("stage_"), (event % 6).cast("string"))
    seconds = F.when(event % 50 == 0, -5).otherwise(F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"),
        event.alias("seq"),
        name.alias("name"),
        F.when(failed, "failed")
        .when(F.col("event_type") == "signup", "pending")
        .otherwise("succeeded")
        .alias("status"),
        F.col("ts").alias("started_at"),
        F.timestamp_add("SECOND", seconds, F.col("ts")).alias("finished_at"),
        F.when(failed, (1 + event % 3).cast("int")).otherwise(0).alias("return_code"),
        F.when(failed & (event % 2 == 0), " boom ").otherwise("").alias("stderr"),
        F.when(event % 4 != 0, F.concat(F.lit("src_"), (event % 6).cast("string"))).alias("source"),
        F.col("props").alias("outputs"),
    )


def run_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs known to have begun: an id begins anew at every seventh event, so it has many runs;
    some events begin a run of their own that records no result."""
    event = F.col("event_id")
    pipeline = F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline")
    own = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    lone = F.concat(F.lit("x"), event.cast("string"))
    events = table(spark, sf_dir, "events")
    again = events.where(event % 7 == 0).select(pipeline, own.alias("run_id"), F.col("ts").alias("run_started_at"))
    alone = events.where(event % 97 == 0).select(pipeline, lone.alias("run_id"), F.col("ts").alias("run_started_at"))
    return again.union(alone)


def run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about the end of runs without results, five seconds after their start."""
    event = F.col("event_id")
    said = F.when(event % 2 == 0, "failed").when(event % 3 == 0, "succeeded")
    return (
        table(spark, sf_dir, "events")
        .where((event % 97 == 0) & said.isNotNull())
        .select(
            F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"),
            F.concat(F.lit("x"), event.cast("string")).alias("run_id"),
            F.timestamp_add("SECOND", F.lit(5), F.col("ts")).alias("ended_at"),
            said.alias("status"),
        )
    )


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run configuration per event, with keys set in several places."""
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("pipeline"),
        F.concat(F.lit("e"), event).alias("run_id"),
        F.concat(F.lit("n"), user).alias("name"),
        F.when(F.col("event_id") % 3 != 0, "spark").alias("backend"),
        F.create_map(F.lit("kind"), "event_type", F.lit("owner"), F.concat(F.lit("u"), user)).alias(
            "metadata"
        ),
        F.create_map(
            F.lit("owner"),
            F.concat(F.lit("x"), event),
            F.when(F.col("event_id") % 2 == 0, "log_dir").otherwise("reason"),
            F.col("props"),
        ).alias("extra"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event; a user is a log file.

    Five ids are used again and again; ends name another run than the last one started, or
    one whose start the log does not hold.
    """
    event, text = F.col("event_id"), F.lit
    user = F.col("user_id").cast("string")
    stage = F.concat(text("stage_"), (event % 3).cast("string"))
    body = (
        F.when(
            F.col("event_type") == "signup",
            F.concat(
                text('Pipeline started | {"name": "p'), user, text('", "run_id": "r'),
                (event % 5).cast("string"), text('"}'),
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(text('Stage started | {"mode": "callable", "stage": "'), stage, text('"}')),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                text('Stage finished | {"mode": "callable", "stage": "'), stage,
                text('", "status": "succeeded"}'),
            ),
        )
        .when(
            F.col("event_type") == "error",
            F.concat(
                text('Pipeline failed | {"error": "boom", "name": "p'), user, text('", "run_id": "r'),
                ((event + 1) % 6).cast("string"), text('"}'),
            ),
        )
        .otherwise(
            F.concat(
                text('Pipeline completed | {"name": "p'), user, text('", "run_id": "r'),
                ((event + 2) % 6).cast("string"), text('", "stages": 3}'),
            )
        )
    )
    return table(spark, sf_dir, "events").select(
        F.concat(text("w"), user).alias("log_file"),
        event.alias("line_no"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), text(" "), body).alias("value"),
    )
