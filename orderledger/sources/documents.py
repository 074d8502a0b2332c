"""JSON report documents: one row of scalars, and a folder of JSON lines for each list or map.

The document names the folder and the number of rows of each, whatever their
number: a reader meets one shape.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListField:
    """The ``value`` column of ``rows``; every row keeps its ``order`` columns as its place."""

    rows: DataFrame
    value: str
    order: tuple[str, ...]


@dataclass(frozen=True)
class MapField:
    """``key`` to ``value`` of ``rows``."""

    rows: DataFrame
    key: str
    value: str


def write_json_document(
    scalars: DataFrame, path: str, fields: Mapping[str, ListField | MapField] | None = None
) -> str:
    """Write the one-row frame as an indented document, keys in name order, fields beside it.

    What an earlier run left at the path is replaced.
    """
    columns = {name: F.col(name) for name in scalars.columns}
    for name, field in (fields or {}).items():
        if isinstance(field, MapField):
            rows = field.rows.select(field.key, field.value)
        else:
            rows = field.rows.select(*dict.fromkeys((*field.order, field.value)))
        folder = posixpath.join(path, name)
        written = Observation()
        counted = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").json(folder, ignoreNullFields=False)
        columns[name] = F.struct(
            F.lit(folder).alias("folder"), F.lit(written.get["rows"]).alias("rows")
        )
    body = F.struct(*[columns[name].alias(name) for name in sorted(columns)])
    text = F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"})
    document = scalars.select(text.alias("value")).coalesce(1)
    document.write.mode("overwrite").text(posixpath.join(path, "document"))
    return path


DOCUMENT, SHARD = "document", "shard"


def document_id(keys: Sequence[str]) -> Column:
    """The hash that names the document of a key, null parts included."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def write_json_documents(
    scalars: DataFrame, path: str, keys: Sequence[str], fields: Mapping[str, ListField | MapField], digits: int = 2
) -> str:
    """Write a document for every row of ``scalars``, which ``keys`` tell apart, all in one job a part.

    A document is one JSON line below ``path``/document, and the rows of its fields are JSON
    lines below ``path``/field, in their order; the document names the folder and the number of
    its rows, 0 if it has none. Each part is laid out in folders by the first ``digits`` hex
    digits of the document's hash, so a reader of one document opens one folder of each.
    Rows are dealt by range of (document, place): a document of any length is written
    by many tasks. Frames are read up to three times, so give stored ones. Columns named
    ``document`` and ``shard`` are not taken.
    """
    taken = {DOCUMENT, SHARD} & {*scalars.columns, *(c for f in fields.values() for c in f.rows.columns)}
    if taken:
        raise ValueError(f"the names {sorted(taken)} are used by the layout")
    shard = F.left(DOCUMENT, F.lit(digits)).alias(SHARD)
    documents = scalars.withColumn(DOCUMENT, document_id(keys))
    for name, field in fields.items():
        if isinstance(field, MapField):
            order, columns = (field.key,), (field.key, field.value)
        else:
            order, columns = field.order, tuple(dict.fromkeys((*field.order, field.value)))
        rows = field.rows.select(document_id(keys).alias(DOCUMENT), *columns)
        counted = rows.groupBy(DOCUMENT).agg(F.count(F.lit(1)).alias("_rows"))
        folder = posixpath.join(path, name)
        _write_shards(rows.select("*", shard), folder, order)
        place = F.concat(F.lit(f"{folder}/{SHARD}="), F.left(DOCUMENT, F.lit(digits))).alias("folder")
        about = F.struct(place, F.coalesce("_rows", F.lit(0)).cast("bigint").alias("rows"))
        documents = documents.join(counted, DOCUMENT, "left").withColumn(name, about).drop("_rows")
    _write_shards(documents.select("*", shard), posixpath.join(path, "document"), ())
    return path


def _write_shards(rows: DataFrame, folder: str, order: Sequence[str]) -> None:
    keys = [SHARD, DOCUMENT, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.write.mode("overwrite").partitionBy(SHARD).json(folder, ignoreNullFields=False)


def read_json_documents(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """The lines of all documents' ``part`` (``document`` or a field) with their document's hash.

    Fields of ``schema`` that a line doesn't have are null. A filter on ``shard`` reads only that folder.
    """
    return spark.read.schema(f"{DOCUMENT} string, {schema}, {SHARD} string").json(posixpath.join(path, part))
