"""Raw text orders to the typed clean table, and the rows that do not parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decimal_amount, iso_date, money_product, strip, title_case, whole_number
from ..sources.orders import CLEAN_COLUMNS

# In the order the checks apply: column, what a value has to be.
_PARSED = {
    "quantity": "a whole number",
    "unit_price": "a decimal amount",
    "order_date": "an ISO date",
    "order_value": "within decimal(18,2)",
}


def _text(c: Column) -> Column:
    """Blank text is '' whether it came as null, empty or whitespace: one key when grouped."""
    return F.coalesce(c, F.lit(""))


def _with_parsed(orders: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns plus the parsed ones, each value parsed once per row.

    A filter on plain projected columns would be pushed below the projection and
    parse everything a second time; columns that come out of inline() stay where
    they are.
    """
    quantity, unit_price = whole_number("quantity"), decimal_amount("unit_price")
    parsed = F.struct(
        iso_date("order_date").alias("_order_date"),
        quantity.alias("_quantity"),
        unit_price.alias("_unit_price"),
    )
    value = money_product(F.col("_quantity"), F.col("_unit_price"))
    return orders.select(*keep, F.inline(F.array(parsed))).withColumn("_order_value", value)


def _fails() -> Column:
    # The value is null whenever quantity or price is.
    return F.col("_order_date").isNull() | F.col("_order_value").isNull()


def clean_orders(orders: DataFrame, strict: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The clean table, with ``keep`` columns of the raw one in front.

    Rows whose quantity, price or date does not parse are left to
    ``rejected_orders``; ``strict`` makes the first of them an error. There is
    no sign or blank test here: that is what the rules are for.
    """
    text = ("order_id", "customer_name", "region", "product")
    parsed = _with_parsed(orders, [*dict.fromkeys((*keep, *text))])
    if strict:
        for column, form in _PARSED.items():
            kind = parsed.schema[f"_{column}"].dataType
            error = F.raise_error(F.lit(f"{column} is not {form}")).cast(kind)
            parsed = parsed.withColumn(f"_{column}", F.coalesce(f"_{column}", error))
    else:
        parsed = parsed.where(~_fails())
    clean = {
        "order_id": _text(strip("order_id")),
        **{c: _text(title_case(c)) for c in text[1:]},
        **{c: F.col(f"_{c}") for c in _PARSED},
    }
    kept = [c for c in keep if c not in CLEAN_COLUMNS]
    return parsed.select(*kept, *[clean[c].alias(c) for c in CLEAN_COLUMNS])


def rejected_orders(orders: DataFrame) -> DataFrame:
    """The raw rows that do not parse, as they came, with the first reason."""
    first_failure = F.coalesce(
        *[
            F.when(F.col(f"_{column}").isNull(), F.lit(f"{column} is not {form}"))
            for column, form in _PARSED.items()
        ]
    )
    failed = _with_parsed(orders, orders.columns).where(_fails())
    return failed.select(*orders.columns, first_failure.alias("reason"))
