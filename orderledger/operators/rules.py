"""Declarative row rules: issues by row, counts, and the validation report.

Every rule is one boolean expression, so checking is a narrow pass. The issue
list stays a table, one row per issue.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_blank, is_positive, strip, title_case
from ..sources.orders import REQUIRED_COLUMNS


@dataclass(frozen=True)
class Rule:
    """``fails`` is true, never null, for the rows that break the rule."""

    column: str
    name: str
    message: str
    fails: Column


def required(column: str) -> Rule:
    return Rule(column, "required", f"missing {column}", is_blank(column))


def positive(column: str) -> Rule:
    return Rule(column, "positive", f"{column} must be positive", ~is_positive(column))


def order_rules() -> list[Rule]:
    """The rules of the raw order table, in the order their issues are listed."""
    return [*map(required, REQUIRED_COLUMNS), positive("quantity"), positive("unit_price")]


def row_issues(
    df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("row_number",)
) -> DataFrame:
    """One row per issue: the ``keep`` columns, rule_order, column_name, rule, message.

    Unsorted; order by (row_number, rule_order) when rendering.
    """
    found = F.array(
        *[
            F.when(
                rule.fails,
                F.struct(
                    F.lit(order).alias("rule_order"),
                    F.lit(rule.column).alias("column_name"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.message).alias("message"),
                ),
            )
            for order, rule in enumerate(rules)
        ]
    )
    # Unpacking all slots and dropping the empty ones stays in generated code,
    # which array_compact() would leave.
    slots = df.select(*keep, F.explode(found).alias("_issue"))
    return slots.where(F.col("_issue").isNotNull()).select(*keep, "_issue.*")


def order_issues(orders: DataFrame) -> DataFrame:
    """Issues of numbered raw orders, with the text ``row N: ...``."""
    keep = [c for c in ("source_file", "row_number") if c in orders.columns]
    text = F.concat(F.lit("row "), F.col("row_number"), F.lit(": "), F.col("message"))
    return row_issues(orders, order_rules(), keep).withColumn("message", text)


def issue_count(rules: Sequence[Rule]) -> Column:
    """How many of the rules a row breaks."""
    return reduce(add, [rule.fails.cast("int") for rule in rules])


def region_profile(orders: DataFrame) -> DataFrame:
    """Counts and date range per title-cased region (null for blank regions).

    The one scan behind the validation report: partial sums per region leave
    every task small whatever a region's share of the rows.
    """
    dated = F.when(~is_blank("order_date"), strip("order_date"))
    named = F.when(~is_blank("region"), title_case("region"))
    # min() of text cannot be hashed and would sort every row; counts per region
    # and date can, and leave few rows for it.
    by_date = (
        orders.select(
            named.alias("region"),
            dated.alias("order_date"),
            issue_count(order_rules()).alias("issues"),
        )
        .groupBy("region", "order_date")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("issues").alias("issues"))
    )
    return by_date.groupBy("region").agg(
        F.sum("records").alias("record_count"),
        F.sum("issues").alias("issue_count"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )


def validation_report(profile: DataFrame) -> DataFrame:
    """One row: record_count, issue_count, passed, first and last order date.

    Dates are compared as stripped text, blanks skipped; the flag is advisory.
    """
    return profile.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        F.coalesce(F.sum("issue_count"), F.lit(0)).alias("issue_count"),
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
    ).select(
        "record_count",
        "issue_count",
        (F.col("issue_count") == 0).alias("passed"),
        "first_order_date",
        "last_order_date",
    )


def unique_regions(profile: DataFrame) -> DataFrame:
    """The distinct title-cased regions, one per row."""
    return profile.where(F.col("region").isNotNull()).select("region")


def blank_counts(orders: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Blank values per column: (column_name, blanks)."""
    counts = orders.agg(
        *[F.count(F.when(is_blank(c), F.lit(1))).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column_name", "blanks")
