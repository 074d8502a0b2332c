"""Grouped revenue reports over the clean table.

All sums are exact decimals, partial sums come before the shuffle, and nothing
is gathered per group, so a region or product with a third of the rows costs
no more than another.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVENUE = "decimal(38,2)"
#: Sums of 64-bit quantities do not fit 64 bits.
UNITS = "decimal(38,0)"

_FIRST_DAY = "0001-01-01"
_ORDINAL_BITS = 41
_FILE_BITS = 31


def first_seen(order_date: str = "order_date", ordinal: str | None = None, file: str | None = None) -> Column:
    """Place of a row in a stable sort by date, as one number that hashes cheaply.

    ``ordinal`` is the row's place in its file (below 2**41); without it rows
    of one day share a place. ``file`` is the place of its file (below 2**31), for
    rows of several files; the number is then a wide decimal, not a bigint, and
    the ordinal may be any bigint from 0.
    """
    day = F.date_diff(order_date, F.lit(_FIRST_DAY).cast("date")).cast("bigint")
    if file is not None:
        high = F.shiftleft(day, _FILE_BITS) + F.col(file).cast("bigint")
        number = F.lit(0).cast("bigint") if ordinal is None else F.col(ordinal)
        # At most 17 digits, then the 19 of a bigint.
        wide = high.cast("decimal(17,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)")
        return (wide.cast("decimal(38,0)") + number.cast("decimal(19,0)")).cast("decimal(38,0)")
    place = F.shiftleft(day, _ORDINAL_BITS)
    if ordinal is None:
        return place
    fits = F.col(ordinal).between(0, (1 << _ORDINAL_BITS) - 1)
    number = F.when(fits, F.col(ordinal)).otherwise(
        F.raise_error(F.lit("ordinal does not fit 41 bits")).cast("bigint")
    )
    return place + number


def _measures(ordinal: str | None, file: str | None = None) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("quantity").cast("decimal(19,0)")).cast(UNITS).alias("units"),
        F.sum("order_value").cast(REVENUE).alias("revenue"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.min(first_seen("order_date", ordinal, file)).alias("first_seen"),
    ]


def sales_by(clean: DataFrame, key: str, ordinal: str | None = None, file: str | None = None) -> DataFrame:
    """One row per key: orders, units, revenue, date range, first_seen.

    Select what is needed; unused sums are dropped from the plan.
    """
    return clean.groupBy(key).agg(*_measures(ordinal, file))


def sales_totals(clean: DataFrame) -> DataFrame:
    """One row: total_orders, total_units, total_revenue, first and last order date."""
    return clean.agg(*_measures(None)).select(
        F.col("orders").alias("total_orders"),
        F.coalesce("units", F.lit(0).cast(UNITS)).alias("total_units"),
        F.coalesce("revenue", F.lit(0).cast(REVENUE)).alias("total_revenue"),
        "first_order_date",
        "last_order_date",
    )


def sales_breakdown(clean: DataFrame, ordinal: str | None = None, file: str | None = None) -> DataFrame:
    """Region, product and total rows of one scan: (dimension, key, orders, ...).

    Rows are first summed per (region, product); the grouping sets then expand
    those sums instead of the rows.
    """
    cells = clean.groupBy("region", "product").agg(*_measures(ordinal, file))
    level = F.grouping_id()
    sets = cells.groupingSets(
        [[F.col("region")], [F.col("product")], []], F.col("region"), F.col("product")
    ).agg(
        F.sum("orders").alias("orders"),
        F.sum("units").cast(UNITS).alias("units"),
        F.sum("revenue").cast(REVENUE).alias("revenue"),
        F.min("first_order_date").alias("first_order_date"),
        F.max("last_order_date").alias("last_order_date"),
        F.min("first_seen").alias("first_seen"),
        level.alias("level"),
    )
    # grouping_id: 1 = product rolled up, 2 = region rolled up, 3 = both.
    dimension = (
        F.when(F.col("level") == 1, "region").when(F.col("level") == 2, "product").otherwise("total")
    )
    key = F.when(F.col("level") == 1, F.col("region")).when(F.col("level") == 2, F.col("product"))
    zero = F.lit(0)
    return sets.select(
        dimension.alias("dimension"),
        key.alias("key"),
        F.coalesce("orders", zero).alias("orders"),
        F.coalesce("units", zero.cast(UNITS)).alias("units"),
        F.coalesce("revenue", zero.cast(REVENUE)).alias("revenue"),
        "first_order_date",
        "last_order_date",
        "first_seen",
    )


def dimension_rows(breakdown: DataFrame, dimension: str) -> DataFrame:
    """The breakdown's rows of one dimension, the key named after it."""
    rows = breakdown.where(F.col("dimension") == dimension)
    return rows.drop("dimension").withColumnRenamed("key", dimension)


def top_key(grouped: DataFrame, key: str) -> DataFrame:
    """The key with the highest revenue, or no row: ties go to the first seen, then by name."""
    order = [F.desc("revenue"), F.asc("first_seen"), F.asc(key)]
    return grouped.orderBy(*order).select(key, "revenue").limit(1)


def region_breakdown(grouped: DataFrame) -> DataFrame:
    """(region, orders, revenue) in region order."""
    return grouped.select("region", "orders", "revenue").orderBy("region")


def orders_by_date(clean: DataFrame, ordinal: str = "order_id") -> DataFrame:
    """The clean rows in date order, equal dates in file order."""
    return clean.orderBy("order_date", ordinal)


def _with_average(totals: DataFrame) -> DataFrame:
    # Whole cents, rounded half up by one integer division: a decimal quotient is rounded already.
    average = F.expr(
        """cast(sign(total_revenue) * ((2 * cast(abs(total_revenue) * 100 AS decimal(37,0)) + row_count)
        div (2 * row_count)) AS decimal(20,0)) / cast(100 AS decimal(3,0))"""
    ).cast("decimal(18,2)")
    return totals.withColumn(
        "average_order_value",
        F.when(F.col("row_count") > 0, average).otherwise(F.lit(0).cast("decimal(18,2)")),
    )


def clean_summary(clean: DataFrame) -> DataFrame:
    """One row: row_count, total_revenue, average_order_value (0 when empty)."""
    totals = clean.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("order_value").cast(REVENUE), F.lit(0).cast(REVENUE)).alias("total_revenue"),
    )
    return _with_average(totals)


def clean_summary_of(breakdown: DataFrame) -> DataFrame:
    """The same row from the breakdown's total."""
    total = breakdown.where(F.col("dimension") == "total")
    return _with_average(
        total.agg(
            F.coalesce(F.max("orders"), F.lit(0)).alias("row_count"),
            F.coalesce(F.max("revenue"), F.lit(0).cast(REVENUE)).alias("total_revenue"),
        )
    )


def summary_row(breakdown: DataFrame) -> DataFrame:
    """One row of totals and tops from the breakdown; tops and dates are null when empty."""

    def top(dimension: str) -> Column:
        # The breakdown has a row per key, so a struct here is cheap.
        ranked = F.struct((-F.col("revenue")).alias("r"), "first_seen", "key")
        return F.min(F.when(F.col("dimension") == dimension, ranked))["key"]

    def total(measure: str) -> Column:
        return F.max(F.when(F.col("dimension") == "total", F.col(measure)))

    return breakdown.agg(
        F.coalesce(total("orders"), F.lit(0)).alias("total_orders"),
        F.coalesce(total("revenue"), F.lit(0).cast(REVENUE)).alias("total_revenue"),
        top("region").alias("top_region"),
        top("product").alias("top_product"),
        total("first_order_date").alias("first_order_date"),
        total("last_order_date").alias("last_order_date"),
    )


def sales_summary_long(breakdown: DataFrame) -> DataFrame:
    """The summary in long form: (dimension, key, orders, units, revenue)."""
    return breakdown.select("dimension", "key", "orders", "units", "revenue")


def distinct_values(clean: DataFrame, columns: Sequence[str] = ("region", "product")) -> DataFrame:
    """Distinct values per column as (column_name, value)."""
    pairs = clean.select(*columns).distinct().unpivot([], list(columns), "column_name", "value")
    return pairs.distinct()
