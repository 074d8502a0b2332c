"""Dependency checks and ordering over stage tables, many graphs at once.

A stage table has ``pipeline_id``, ``position`` (place in the list, unique per
graph), ``name`` and ``dependencies array<string>``. Results are tables, one row
per finding; nothing of them is gathered.
"""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import is_blank, normalize_names, strip
from ..sources.numbering import position_in_group
from ..sources.shared import scratch_path, stage_table
from .rules import Rule, row_issues

GRAPH = "pipeline_id"

# The verdicts' message texts.
_MESSAGES = {
    "duplicate": "Duplicate stage names are not allowed: ",
    "missing": "Unknown stage dependencies: ",
    "cycle": "Stage graph contains a cycle or unresolved dependencies: ",
}


def normalized_stages(stages: DataFrame) -> DataFrame:
    """Names stripped, dependency lists normalised; a lone text is a list of one."""
    dependencies = F.col("dependencies")
    if stages.schema["dependencies"].dataType.typeName() == "string":
        dependencies = F.when(dependencies.isNotNull(), F.array(dependencies))
    return stages.withColumns(
        {"name": strip("name"), "dependencies": normalize_names(dependencies)}
    )


def dependency_edges(stages: DataFrame) -> DataFrame:
    """One row per dependency of normalised stages, in list order."""
    return stages.select(
        GRAPH, "position", "name", F.posexplode("dependencies").alias("dependency_order", "dependency")
    )


def stage_inputs(stages: DataFrame) -> DataFrame:
    """Each stage with its dependencies in list order; stages without any keep one null row."""
    return stages.select(
        GRAPH,
        "name",
        F.posexplode_outer("dependencies").alias("dependency_order", "dependency"),
    )


def stage_issues(stages: DataFrame) -> DataFrame:
    """Definition checks: blank names, and named stages without a source."""
    # The message texts.
    text = F.concat(F.lit("Stage '"), strip("name"), F.lit("' does not define a source."))
    rules = [
        Rule("name", "named", "Stage name cannot be empty.", is_blank("name")),
        Rule("source", "sourced", "source", ~is_blank("name") & F.col("source").isNull()),
    ]
    found = row_issues(stages, rules, (GRAPH, "position", "name"))
    message = F.when(F.col("rule") == "sourced", text).otherwise(F.col("message"))
    return found.select(GRAPH, "position", "rule_order", "rule", message.alias("message"))


def duplicate_stages(stages: DataFrame) -> DataFrame:
    """(pipeline_id, name, copies) for the names a graph has more than once."""
    copies = stages.groupBy(GRAPH, "name").agg(F.count(F.lit(1)).alias("copies"))
    return copies.where(F.col("copies") > 1)


def missing_dependencies(stages: DataFrame) -> DataFrame:
    """The edges whose dependency is no stage of the graph, as ``stage -> dependency``."""
    names = stages.select(GRAPH, F.col("name").alias("dependency"))
    unknown = dependency_edges(stages).join(names, [GRAPH, "dependency"], "left_anti")
    text = F.concat("name", F.lit(" -> "), "dependency")
    return unknown.withColumn("message", text)


def orderable_stages(stages: DataFrame) -> DataFrame:
    """The stages of graphs with neither duplicate names nor unknown dependencies."""
    bad = duplicate_stages(stages).select(GRAPH).union(missing_dependencies(stages).select(GRAPH))
    return stages.join(bad.distinct(), GRAPH, "left_anti")


def place_stages(stages: DataFrame) -> DataFrame:
    """Add ``level`` to the stages of orderable graphs: the longest path from a stage without
    dependencies; null if the stage is on or behind a cycle.

    Waiting edges say that a stage's level is at least that of the dependency plus the
    edge's length. In a round the edges to a finished stage become a number, and the edges
    to a stage that waits for one stage only pass it by, taking its number and the length
    of its edge along. So lengths double and a chain of n stages ends in about log2(n)
    rounds; each round reads and stores the edges still waiting. An edge as long as a graph
    has stages has been round a cycle and is not passed any more.
    """
    spark = stages.sparkSession
    keys = [GRAPH, "name"]
    kind = "bigint"
    edges = dependency_edges(stages).select(*keys, "dependency", F.lit(1).cast(kind).alias("value"))
    roots = stages.select(*keys, F.lit(None).cast("string").alias("dependency"), F.lit(0).cast(kind).alias("value"))
    done = F.lit(False).alias("done")
    largest = stages.groupBy(GRAPH).count().agg(F.max("count")).first()[0] or 0

    folder = scratch_path(spark, "stage-rounds")
    waiting = stage_table(roots.union(edges).select("*", done), "stage-edges")
    schema, level = waiting.schema, 0
    while True:
        path = posixpath.join(folder, f"round={level}")
        counted = Observation()
        _one_round(waiting, largest).observe(
            counted, F.count(F.when(F.col("done"), 1)).alias("freed"), F.count(F.when(F.col("moved") > 0, 1)).alias("moved")
        ).drop("moved").write.parquet(path)
        waiting = spark.read.schema(schema).parquet(path).where(~F.col("done"))
        if not counted.get["freed"] and not counted.get["moved"]:
            break
        level += 1
    rounds = spark.read.schema(schema).parquet(*[posixpath.join(folder, f"round={k}") for k in range(level + 1)])
    solved = rounds.where("done").select(*keys, F.col("value").cast("int").alias("level"))
    return stages.select(*keys, "position", "dependencies").join(solved, keys, "left")


def _one_round(waiting: DataFrame, largest: int) -> DataFrame:
    """Rows of the next round: (pipeline_id, name, dependency, value, done, moved).

    A row without a dependency says that the level is ``value`` at least, one with
    ``done`` that it is ``value``.
    """
    keys = [GRAPH, "name"]
    here = F.col("dependency").isNotNull()
    state = waiting.groupBy(*keys).agg(
        F.count("dependency").alias("unmet"), F.coalesce(F.max(F.when(~here, F.col("value"))), F.lit(0)).alias("least")
    )
    edges = waiting.where(here).select(*keys, "dependency", "value")
    free = state.where("unmet = 0").select(
        GRAPH, F.col("name").alias("via"), "least", F.lit(None).cast("string").alias("next"), F.lit(None).cast("bigint").alias("length")
    )
    single = state.where("unmet = 1").join(edges.where(F.col("value") < largest), keys)
    # The stage that a single one waits for may finish in this round; then both levels are known.
    ahead = free.select(GRAPH, F.col("via").alias("dependency"), F.col("least").alias("known"))
    single = single.join(ahead, [GRAPH, "dependency"], "left").select(
        GRAPH,
        F.col("name").alias("via"),
        F.greatest("least", F.col("known") + F.col("value")).alias("least"),
        F.when(F.col("known").isNull(), F.col("dependency")),
        F.when(F.col("known").isNull(), F.col("value")),
    )
    passed = free.union(single)
    reached = edges.withColumnRenamed("dependency", "via").join(passed, [GRAPH, "via"], "left")
    nowhere, moved = F.lit(None).cast("string"), F.lit(1)
    number = F.struct(nowhere.alias("dependency"), (F.col("least") + F.col("value")).alias("value"), moved.alias("moved"))
    longer = F.struct(F.col("next").alias("dependency"), (F.col("length") + F.col("value")).alias("value"), moved.alias("moved"))
    same = F.struct(F.col("via").alias("dependency"), F.col("value").alias("value"), F.lit(0).alias("moved"))
    rows = F.when(F.col("least").isNull(), F.array(same)).when(F.col("next").isNull(), F.array(number)).otherwise(F.array(number, longer))
    onward = reached.select(*keys, F.inline(rows))
    own = state.where("unmet > 0").select(*keys, nowhere.alias("dependency"), F.col("least").alias("value"), F.lit(0).alias("moved"))
    merged = onward.union(own).groupBy(*keys, "dependency").agg(F.max("value").alias("value"), F.max("moved").alias("moved"))
    finished = state.where("unmet = 0").select(
        *keys, nowhere.alias("dependency"), F.col("least").alias("value"), F.lit(True).alias("done"), F.lit(0).alias("moved")
    )
    return merged.select(*keys, "dependency", "value", F.lit(False).alias("done"), "moved").union(finished)


def unresolved_stages(placed: DataFrame) -> DataFrame:
    """The stages on or behind a cycle."""
    return placed.where(F.col("level").isNull()).select(GRAPH, "name", "position")


def stage_levels(placed: DataFrame) -> DataFrame:
    """(pipeline_id, name, level) of the stages that have one."""
    return placed.where(F.col("level").isNotNull()).select(GRAPH, "name", "level")


def topological_order(placed: DataFrame, most: int = 8) -> DataFrame:
    """(pipeline_id, name, level, place) for graphs without a cycle, places from 0.

    The order is that of a first-in-first-out ready list: by level, then by the place of
    the dependency placed last, then by position. Only levels with several stages need an
    order of their own. A stage's key there is that of its last dependency, if the level
    below has several stages too, and its position; a key of ``most`` numbers is replaced
    by its place, so keys stay short however deep a graph is.
    """
    whole = placed.join(unresolved_stages(placed).select(GRAPH).distinct(), GRAPH, "left_anti")
    wide = whole.groupBy(GRAPH, "level").count().where("count > 1").select(GRAPH, "level")
    wide = stage_table(wide, "wide-levels")
    below = wide.select(GRAPH, (F.col("level") + 1).alias("level"), F.lit(True).alias("after_wide"))
    known = wide.join(below, [GRAPH, "level"], "left")
    nodes = whole.join(known, [GRAPH, "level"]).select(GRAPH, "name", "level", "position", "dependencies", "after_wide")
    nodes = stage_table(nodes.repartitionByRange("level").sortWithinPartitions("level"), "wide-stages")
    spark, folder = placed.sparkSession, scratch_path(placed.sparkSession, "stage-keys")
    levels = sorted(r[0] for r in wide.select("level").distinct().collect())
    schema = f"{GRAPH} {placed.schema[GRAPH].dataType.simpleString()}, name string, key array<bigint>"
    length, keys, last = 0, None, None
    for level in levels:
        here = nodes.where(F.col("level") == level)
        own = F.array(F.col("position").cast("bigint"))
        if keys is None or last != level - 1:
            found, length = here.select(GRAPH, "name", own.alias("key")), 1
        else:
            asked = here.where("after_wide").select(GRAPH, "name", F.explode("dependencies").alias("dependency"))
            met = asked.join(keys.select(GRAPH, F.col("name").alias("dependency"), "key"), [GRAPH, "dependency"])
            met = met.groupBy(GRAPH, "name").agg(F.max("key").alias("key"))
            before = F.coalesce(F.col("key"), F.array().cast("array<bigint>"))
            found = here.join(met, [GRAPH, "name"], "left").select(GRAPH, "name", F.concat(before, own).alias("key"))
            length += 1
        if length >= most:
            found = position_in_group(found, [GRAPH], ["key"], "place").select(GRAPH, "name", F.array("place").alias("key"))
            length = 1
        path = posixpath.join(folder, f"level={level}")
        found.write.parquet(path)
        keys, last = spark.read.schema(schema).parquet(path), level
    if levels:
        ranked = spark.read.schema(schema).parquet(*[posixpath.join(folder, f"level={k}") for k in levels])
        whole = whole.join(ranked, [GRAPH, "name"], "left")
    else:
        whole = whole.withColumn("key", F.array().cast("array<bigint>"))
    ordered = position_in_group(whole.select(GRAPH, "name", "level", "key"), [GRAPH], ["level", "key"], "place")
    return ordered.select(GRAPH, "name", "level", "place")


def graph_findings(stages: DataFrame) -> DataFrame:
    """Every broken rule: (pipeline_id, rule, place, dependency_order, text).

    ``rule`` is duplicate, missing or cycle; within a rule the texts are in the
    order of (place, dependency_order, text). ``opening`` words the rule.
    """
    zero = F.lit(0)
    findings = reduce(
        DataFrame.unionByName,
        [
            duplicate_stages(stages).select(
                GRAPH, F.lit("duplicate").alias("rule"), zero.alias("place"), zero.alias("dependency_order"),
                F.col("name").alias("text"),
            ),
            missing_dependencies(stages).select(
                GRAPH, F.lit("missing").alias("rule"), F.col("position").cast("int").alias("place"),
                F.col("dependency_order").cast("int").alias("dependency_order"), F.col("message").alias("text"),
            ),
            unresolved_stages(place_stages(orderable_stages(stages))).select(
                GRAPH, F.lit("cycle").alias("rule"), F.col("position").cast("int").alias("place"),
                zero.alias("dependency_order"), F.col("name").alias("text"),
            ),
        ],
    )
    return stage_table(findings, "stage-findings")


def graph_verdicts(stages: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per graph: the first broken rule (duplicate, missing, cycle) or ``ok``.

    ``problems`` counts the findings of that rule and ``message`` opens their
    list; ``graph_findings`` has them all.
    """
    findings = graph_findings(stages) if findings is None else findings

    def problems(rule: str) -> Column:
        return F.count(F.when(F.col("rule") == rule, F.lit(1)))

    counts = findings.groupBy(GRAPH).agg(*[problems(rule).alias(rule) for rule in _MESSAGES])
    verdict = F.coalesce(*[F.when(F.col(rule) > 0, F.lit(rule)) for rule in _MESSAGES])
    number = F.coalesce(*[F.when(F.col(rule) > 0, F.col(rule)) for rule in _MESSAGES])
    opening = F.coalesce(*[F.when(F.col(rule) > 0, F.lit(text)) for rule, text in _MESSAGES.items()])
    broken = counts.select(
        GRAPH, verdict.alias("rule"), number.alias("problems"), F.rtrim(opening).alias("message")
    )
    return (
        stages.select(GRAPH)
        .distinct()
        .join(broken, GRAPH, "left")
        .select(
            GRAPH,
            F.coalesce("rule", F.lit("ok")).alias("verdict"),
            F.coalesce("problems", F.lit(0)).alias("problems"),
            "message",
        )
    )


def lookup_dependencies(stages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Dependencies from a mapping keyed by name, file name, stem or path: first match wins.

    ``stages`` has pipeline_id, name and path; ``mapping`` has pipeline_id, key
    and dependencies, one row per key. No match gives an empty list.
    """
    file_name = F.element_at(F.split("path", "/"), -1)
    # Everything before the last dot, unless that dot is the first character.
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]+$", "")
    posix = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    candidates = F.array("name", file_name, stem, "path", posix)
    asked = stages.select(
        GRAPH, "name", F.posexplode(F.array_distinct(candidates)).alias("rank", "key")
    )
    found = asked.join(mapping, [GRAPH, "key"])
    first = found.groupBy(GRAPH, "name").agg(F.min_by("dependencies", "rank").alias("dependencies"))
    empty = F.array().cast("array<string>")
    return (
        stages.select(GRAPH, "name")
        .join(first, [GRAPH, "name"], "left")
        .select(GRAPH, "name", F.coalesce("dependencies", empty).alias("dependencies"))
    )
