"""Record numbers without a global window and without one task per group.

A group's rows lie in a few contiguous pieces (the splits of a file, or the
partitions of a sorted frame). Inside a piece ``monotonically_increasing_id``
counts rows; the only window runs over one row per piece and adds up the sizes
of the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin_partitions, stage_table

FILE_COLUMN = "source_file"

# A piece costs about 250 bytes in a hash table, so this many take 250 MB.
_BROADCAST_PIECES = 1_000_000


def _numbered(
    marked: DataFrame, group: Sequence[str], piece: Sequence[str], name: str, start: int
) -> DataFrame:
    """Number ``marked`` (with ``_mark``) per group, pieces in ``piece`` order."""
    keys = [*group, *piece]
    # Stored, so that their number is known and they are counted only once.
    pieces = stage_table(
        marked.groupBy(*keys).agg(
            F.min("_mark").alias("_first"), F.count(F.lit(1)).alias("_rows")
        ),
        "pieces",
    )
    before = (
        Window.partitionBy(*group).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = pieces.select(
        *[F.col(key).alias(f"_of_{key}") for key in keys],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + F.lit(start)).alias(
            "_shift"
        ),
    )
    if pieces.count() <= _BROADCAST_PIECES:
        shifts = F.broadcast(shifts)
    same = [marked[key].eqNullSafe(shifts[f"_of_{key}"]) for key in keys]
    # A piece the first pass did not see means the input changed underneath.
    shift = F.coalesce("_shift", F.raise_error(F.lit("the input changed while it was numbered")))
    kept = [c for c in marked.columns if c != "_mark" and c not in piece]
    return marked.join(shifts, same, "left").select(
        *[marked[c] for c in kept], (marked["_mark"] + shift).cast("bigint").alias(name)
    )


def number_file_records(df: DataFrame, name: str = "row_number", start: int = 2) -> DataFrame:
    """Add the source file and the record's number in it; the header is line 1.

    ``df`` is a file scan, with nothing but column choices on top. The files are
    read here once for the piece sizes (no columns), and for the rows when used.
    """
    marked = df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE_COLUMN),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.spark_partition_id().alias("_partition"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    return _numbered(marked, [FILE_COLUMN], ["_block", "_length", "_partition"], name, start)


def number_files(df: DataFrame, name: str = "file_number") -> DataFrame:
    """Add the place of a row's source file among all files of ``df`` by path, from 0.

    The only window runs over one row per file. Reads the file names once more: give a stored table.
    """
    files = stage_table(df.select(FILE_COLUMN).distinct(), "files")
    place = (F.row_number().over(Window.orderBy(FILE_COLUMN)) - 1).alias(name)
    placed = files.select(F.col(FILE_COLUMN).alias("_file"), place)
    if files.count() <= _BROADCAST_PIECES:
        placed = F.broadcast(placed)
    joined = df.join(placed, df[FILE_COLUMN].eqNullSafe(placed["_file"]), "left")
    return joined.select(*[df[c] for c in df.columns], name)


def position_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "position",
    start: int = 0,
) -> DataFrame:
    """Number each group's rows by ``order``, whatever the size of a group.

    Range partitioning on (group, order) spreads a hot group over many tasks;
    the sorted partitions are checkpointed so that both passes see the same.
    ``order`` has to tell the rows of a group apart.
    """
    keys = [*[F.col(g) for g in group], *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = pin_partitions(ranged).select(
        "*",
        F.spark_partition_id().alias("_partition"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    return _numbered(marked, group, ["_partition"], name, start)

