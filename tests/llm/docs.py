"""Small document frames that hold the awkward cases, for all tests of this folder."""

from __future__ import annotations

import zlib

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Column names that operators use inside; they must not clash with a reader's own columns.
EXTRA = ("score", "ids", "piece", "words", "hash", "value", "key")


def frame(spark, rows, extra=False):
    """rows: (doc_id, text[, lang]). `extra` adds columns with clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
    df = spark.createDataFrame(full, DOCUMENT)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("x") for name in EXTRA})
    return df


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def rows(df):
    return [r.asDict() for r in df.collect()]
