"""Where a step finds its input: the path an earlier step recorded, else the default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import FILE_COLUMN
from .orders import read_numbered_orders


def recorded_path(
    results: DataFrame, run_id: str, stage: str, field: str, default: str
) -> str:
    """``field`` of the JSON outputs of the stage's last result in the run, else ``default``."""
    last = (
        results.where((F.col("run_id") == run_id) & (F.col("name") == stage))
        .orderBy(F.desc("seq"))
        .select(F.get_json_object("outputs", f"$.{field}").alias("path"))
        .limit(1)
        .collect()
    )
    return (last[0]["path"] if last else None) or default


def _one_slash(path: Column) -> Column:
    """The path with one slash after its scheme, as both file:/a and file:///a are written, and none at its end."""
    return F.regexp_replace(F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/"), "/+$", "")


def _qualified(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """The paths with scheme and authority, to be read by and, as Spark names files, as URIs."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    full = [path(p).getFileSystem(conf).makeQualified(path(p)) for p in paths]
    return [(p.toString(), p.toUri().toString()) for p in full]


def read_recorded(
    paths: DataFrame, read: Callable[[SparkSession, list[str]], DataFrame] = read_numbered_orders
) -> DataFrame:
    """The rows of all files named in the column ``path``, with the path they were named by.

    A path is a file or a folder of files. However many runs name it, it is read once;
    runs meet its rows, or better their totals, by joining ``paths`` on ``path``. ``read``
    gives the rows of a list of paths with source_file. Null paths are left out, and two
    spellings of one path both get its rows. A path without files is an error, as in any
    scan. Only the distinct paths are listed on the driver, where a scan lists its files too.
    """
    spark = paths.sparkSession
    places = [r[0] for r in paths.where("path is not null").select("path").distinct().orderBy("path").collect()]
    if not places:
        raise ValueError("no path is recorded")
    full = _qualified(spark, places)
    rows = read(spark, list(dict.fromkeys(p for p, _ in full)))
    named = spark.createDataFrame([(p, uri) for p, (_, uri) in zip(places, full)], "path string, _place string")
    named = named.withColumn("_place", _one_slash(F.col("_place")))
    file = _one_slash(F.col(FILE_COLUMN))
    folder = F.regexp_replace(file, "/[^/]*$", "")
    # A name is a file's or a folder's, so a row meets its file by one of the two.
    placed = rows.withColumn("_place", F.explode(F.array(file, folder)))
    return placed.join(named, "_place").drop("_place")
