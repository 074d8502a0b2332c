"""Number parsing with Python's text forms and Spark's exact decimals.

Spark's casts take forms the data rules do not allow (``1.5d``, hexadecimal)
and refuse one they do (``1_000``), so the text form is tested first. Money is
``decimal(18,2)`` rounded half up: sums do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MONEY = "decimal(18,2)"

# Fixed patterns: the text forms int() and float() accept (ASCII digits), NaN
# apart. NaN is not positive, and Spark orders it above every number.
_DIGITS = r"\d+(?:_\d+)*"
INT_TEXT = rf"^[+-]?{_DIGITS}$"
FINITE_TEXT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_HUGE_EXPONENT = r"[eE][+-]?0*[1-9]\d{3,}$"
FLOAT_TEXT = rf"{FINITE_TEXT}|^[+-]?(?i:inf|infinity)$"


def _parsed(c: Column | str, form: str, data_type: str) -> Column:
    # Only text of the right form reaches try_cast(): a failing one is slow, as
    # it builds an error first.
    text = strip(c)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(form), digits.try_cast(data_type))


def positive_number(c: Column | str) -> Column:
    """The number as double, or null when it is unparsable, NaN or not above 0."""
    value = _parsed(c, FLOAT_TEXT, "double")
    return F.when(value > 0, value)


def is_positive(c: Column | str) -> Column:
    """Whether there is a positive number; never null."""
    return F.coalesce(_parsed(c, FLOAT_TEXT, "double") > 0, F.lit(False))


def whole_number(c: Column | str) -> Column:
    """The integer as bigint, or null; ``2.5`` and values beyond 64 bits are null."""
    return _parsed(c, INT_TEXT, "bigint")


def decimal_amount(c: Column | str) -> Column:
    """The amount as decimal(18,2), or null; NaN and infinity have no decimal.

    A cast writes an exponent out in digits, so one of four digits or more never reaches it:
    such an amount is 0.00 if the exponent is negative, else null.
    """
    text = strip(c)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    huge = digits.rlike(_HUGE_EXPONENT)
    value = F.when(~huge, digits.try_cast(MONEY)).when(digits.rlike("[eE]-"), F.lit(0).cast(MONEY))
    return F.when(text.rlike(FINITE_TEXT), value)


def money_product(quantity: Column, unit_price: Column) -> Column:
    """quantity * unit_price, exact; null when it does not fit decimal(18,2)."""
    return (quantity * unit_price).try_cast(MONEY)
