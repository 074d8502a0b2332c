"""CSV records that span lines, from files that are still read in splits.

A quote is open behind a line if the quotes up to there are odd in number. Each split of a
file counts its quotes on its own; a running parity over one row per split then says which
splits begin inside a quote, and so which lines begin a record. Only the lines of records
that span several are gathered, each record by itself.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import FILE_COLUMN
from .shared import stage_table

#: Lines of a record from which on a stray quote is assumed, and reported.
MOST_LINES = 10_000
_RECORD, _MARK = "_record", "_mark"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(list(paths))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return text.select(
        F.col("_metadata.file_path").alias(FILE_COLUMN),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias(_MARK),
        "value",
        (quotes % 2).cast("int").alias("_odd"),
    )


def file_outlines(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, bool]]:
    """(file, header line, whether some line leaves a quote open) of every file that has a line.

    One pass over the text; one row per file reaches the driver.
    """
    first = F.when(F.col("_block") == 0, F.struct(_MARK, "value"))
    found = _lines(spark, paths).groupBy(FILE_COLUMN).agg(F.min(first).alias("first"), F.max("_odd").alias("odd"))
    rows = found.select(FILE_COLUMN, "first.value", "odd").collect()
    return [(unquote(f), (v or "").rstrip("\r").removeprefix("﻿"), odd == 1) for f, v, odd in rows]


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_file, row_number, _record): every record's text, numbered from 1 in its file.

    Blank lines between records are left out; line breaks inside quotes stay. A record of more
    than MOST_LINES lines is an error that names it: a quote has been left open.
    """
    split = [FILE_COLUMN, "_block"]
    # A split has a bounded size, so its lines are put in order in one task.
    inside = Window.partitionBy(*split).orderBy(_MARK).rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("_odd").over(inside), F.lit(0)) % 2
    lines = stage_table(_lines(spark, paths).withColumn("_parity", parity.cast("int")), "csv-lines")
    filled = F.trim(F.regexp_replace("value", r"\s", "")) != ""
    starts = [F.count(F.when(filled & (F.col("_parity") == k), 1)).alias(f"_starts{k}") for k in (0, 1)]
    pieces = stage_table(lines.groupBy(*split).agg(F.sum("_odd").alias("_quotes"), *starts), "csv-splits")
    before = Window.partitionBy(FILE_COLUMN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2).cast("int")
    pieces = pieces.withColumn("_open", opened)
    begun = F.when(F.col("_open") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    pieces = pieces.withColumn("_begun", begun).select(
        *split, "_open", F.coalesce(F.sum("_begun").over(before), F.lit(0)).alias("_past")
    )
    begins = filled & ((F.col("_parity") + F.col("_open")) % 2 == 0)
    running = Window.partitionBy(*split).orderBy(_MARK)
    placed = lines.join(pieces, split).withColumn("_begins", begins)
    placed = placed.withColumn(
        "row_number", F.col("_past") + F.sum(F.col("_begins").cast("int")).over(running)
    )
    # Blank lines outside of quotes belong to no record.
    outside = ~filled & ((F.col("_parity") + F.col("_open")) % 2 == 0)
    placed = stage_table(
        placed.where(~outside).select(
            FILE_COLUMN, "row_number", "_block", _MARK, "value", (F.col("_begins") & (F.col("_odd") == 0)).alias("_whole")
        ),
        "csv-placed",
    )
    parts = placed.where(~F.col("_whole"))
    key = [FILE_COLUMN, "row_number"]
    long = parts.groupBy(*key).count().where(F.col("count") > MOST_LINES).limit(1).collect()
    if long:
        raise ValueError(f"record {long[0].row_number} of {long[0][FILE_COLUMN]} has {long[0]['count']} lines: a quote is left open")
    ordered = F.array_sort(F.collect_list(F.struct("_block", _MARK, "value")))
    joined = parts.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
    records = placed.where("_whole").select(*key, "value").union(joined.select(*key, "value"))
    text = F.regexp_replace("value", "\r$", "")
    text = F.when(F.col("row_number") == 1, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return records.select(*key, text.alias(_RECORD))


def parse_records(records: DataFrame, header: str) -> DataFrame:
    """Columns named by the header line, all text, beside source_file and row_number; the header
    record itself is left out."""
    names = next(csv.reader([header]))
    taken: set[str] = set()
    fields = []
    for place, name in enumerate(names):
        # A name that is empty or taken already cannot be asked for.
        name = name if name and name.lower() not in taken else f"_c{place}"
        taken.add(name.lower())
        fields.append(name)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in fields)
    parsed = F.from_csv(_RECORD, schema, {"escape": '"', "multiLine": "true", "lineSep": "\n"})
    rows = records.where("row_number > 1").select(FILE_COLUMN, "row_number", parsed.alias(_RECORD))
    return rows.select(f"{_RECORD}.*", FILE_COLUMN, "row_number")
