"""The run log: lines of ``<local time> <message> | <JSON attributes>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import FILE_COLUMN, number_file_records

# The line form and the attributes the log carries. ``stages`` is
# a list in one message and a number in another, so it is kept as text.
LINE_FORM = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} "
ATTRIBUTES = (
    "run_id string, name string, stage string, mode string, status string, "
    "source string, stages string, id string, return_code int, error string"
)

_TIME_LENGTH = len("2026-01-01 00:00:00,000")
_SEPARATOR = " | {"


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan log files as (log_file, line_no, value), lines numbered from 1 per file."""
    numbered = number_file_records(spark.read.text(path), "line_no", start=1)
    return numbered.withColumnRenamed(FILE_COLUMN, "log_file")


def parse_log_lines(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events of the well-formed lines: log_file, line_no, ts, message, attributes.

    Log times are local to the writer; ``zone`` says where that was, and ``ts``
    is the same moment in UTC (null for a time no calendar has).
    ``unparsed_lines`` has the other lines.
    """
    rest = F.col("_rest")
    cut = F.locate(_SEPARATOR, rest)
    # The attributes run from the first separator to the closing brace at the end.
    has_attributes = (cut > 0) & F.endswith(rest, F.lit("}"))
    written = F.replace(F.substring("value", 1, _TIME_LENGTH), F.lit(","), F.lit("."))
    local = written.try_cast("timestamp_ntz")
    ts = local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return (
        lines.where(_well_formed())
        .select(
            "log_file",
            "line_no",
            ts.alias("ts"),
            F.substr("value", F.lit(_TIME_LENGTH + 2)).alias("_rest"),
        )
        .select(
            "log_file",
            "line_no",
            "ts",
            F.when(has_attributes, F.substr(rest, F.lit(1), cut - 1))
            .otherwise(rest)
            .alias("message"),
            F.from_json(
                F.when(has_attributes, F.substr(rest, cut + F.lit(len(_SEPARATOR) - 1))),
                ATTRIBUTES,
            ).alias("_attributes"),
        )
        .select("log_file", "line_no", "ts", "message", "_attributes.*")
    )


def _well_formed() -> Column:
    return F.coalesce(F.col("value").rlike(LINE_FORM), F.lit(False))


def unparsed_lines(lines: DataFrame) -> DataFrame:
    """The lines parse_log_lines() leaves out."""
    return lines.where(~_well_formed())
