"""CSV scans and sinks of the order tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import FILE_COLUMN, number_file_records
from .records import csv_records, file_outlines, parse_records

# The raw columns in rule order.
REQUIRED_COLUMNS = (
    "order_id",
    "customer_name",
    "region",
    "product",
    "quantity",
    "unit_price",
    "order_date",
)

# The clean file's column order and types.
CLEAN_COLUMNS = (
    "order_id",
    "customer_name",
    "region",
    "product",
    "order_date",
    "quantity",
    "unit_price",
    "order_value",
)
_CLEAN_TYPES = {
    "order_date": "date",
    "quantity": "bigint",
    "unit_price": "decimal(18,2)",
    "order_value": "decimal(18,2)",
}

# The region breakdown's column order.
REGION_COLUMNS = ("region", "orders", "revenue")


def has_multiline_records(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """True if some line leaves a quote open, so that a record may span lines.

    Stops at the first such line. When every line has an even number of quotes,
    each line is a whole record and the files can be split.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(list(path) if not isinstance(path, str) else path)
    return not lines.where(quotes % 2 == 1).limit(1).isEmpty()


def _csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> DataFrame:
    # Columns are found by header name: no schema is given, and a file whose
    # header differs from the first one's is an error instead of a silent shift.
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(list(path) if not isinstance(path, str) else path)
    )


def with_required_columns(df: DataFrame) -> DataFrame:
    """Add each absent required column as null text."""
    present = {name.lower() for name in df.columns}
    absent = {c: F.lit(None).cast("string") for c in REQUIRED_COLUMNS if c not in present}
    return df.withColumns(absent) if absent else df


def read_raw_orders(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """Scan raw order files, every column text, absent required columns null.

    One pass over the text first finds the files' headers and open quotes. Files
    are then scanned together by header, so columns are found by name in each,
    and files with line breaks inside quotes are read in splits all the same
    (``csv_records``). A caller who knows that all files have one header saves
    the pass: with ``multi_line=False`` if no record has a line break, or with
    ``multi_line=True``, which reads each file whole in one task.
    """
    if multi_line is not None:
        return with_required_columns(_csv(spark, path, multi_line))
    scans = _scans(spark, path, numbered=False)
    return with_required_columns(reduce(_union, scans))


def read_numbered_orders(spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None) -> DataFrame:
    """``read_raw_orders`` with source_file and row_number, the header being record 1."""
    if multi_line is not None:
        return with_required_columns(number_file_records(_csv(spark, path, multi_line)))
    return with_required_columns(reduce(_union, _scans(spark, path, numbered=True)))


def _union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def _scans(spark: SparkSession, path: str | Sequence[str], numbered: bool) -> list[DataFrame]:
    """A scan for each header, and one more if some of its files have line breaks in quotes."""
    paths = [path] if isinstance(path, str) else list(path)
    groups: dict[tuple[str, bool], list[str]] = {}
    for file, header, broken in file_outlines(spark, paths):
        groups.setdefault((header, broken), []).append(file)
    scans = []
    for (header, broken), files in sorted(groups.items()):
        if broken:
            rows = parse_records(csv_records(spark, files), header)
            scans.append(rows if numbered else rows.drop(FILE_COLUMN, "row_number"))
        else:
            rows = _csv(spark, paths if len(groups) == 1 else files, False)
            scans.append(number_file_records(rows) if numbered else rows)
    if scans:
        return scans
    rows = _csv(spark, paths, False)
    return [number_file_records(rows) if numbered else rows]


def read_clean_orders(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False
) -> DataFrame:
    """Scan a clean-orders file back into its types; a value that does not fit is an error."""
    raw = _csv(spark, path, multi_line)
    typed = {c: F.col(c).cast(kind) for c, kind in _CLEAN_TYPES.items()}
    blank = F.lit("")
    return raw.select(*[typed.get(c, F.coalesce(c, blank)).alias(c) for c in CLEAN_COLUMNS])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """Write ``columns`` in order with a header, a folder of part files in the frame's order.

    What an earlier run left at the path is replaced.
    """
    (
        df.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path
