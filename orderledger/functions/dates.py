"""Dates and time spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed pattern: YYYY-MM-DD with year 1 or later.
ISO_DATE_TEXT = r"^(?!0000)\d{4}-\d{2}-\d{2}$"


def iso_date(c: Column | str) -> Column:
    """The date, or null unless the stripped text is a real YYYY-MM-DD date."""
    text = strip(c)
    return F.when(text.rlike(ISO_DATE_TEXT), text.try_cast("date"))


def seconds_between(start: Column | str, finish: Column | str) -> Column:
    """Seconds from start to finish, never below 0; null while either is null."""
    start, finish = [F.col(c) if isinstance(c, str) else c for c in (start, finish)]
    micros = F.timestamp_diff("MICROSECOND", start, finish)
    # greatest() would read a null as 0.
    return F.when(micros < 0, F.lit(0.0)).otherwise(micros / F.lit(1e6))
