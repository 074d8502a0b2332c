"""Importance resampling towards a target distribution, by hashed word runs.

The distinct words of a batch of texts, each with a delimiter on both sides, are the patterns
of an Aho-Corasick automaton; every pattern carries the CRC-32 and the length of its word. One
scan over the texts emits the payloads in order. The CRC of a run of words follows from the
payloads of neighbours, as CRCs compose, so no run is ever spelt out. Its remainder is the
feature's bucket, in which target and raw corpus are counted and documents are scored. The
buckets of every document are stored, so that its text is scanned once for both.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_table
from .words import text_slices

BUCKETS, LONGEST, LEAST_WORDS, SHARE_PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text whose words make up one automaton.
SLICE_BYTES = 3_000_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
# A-Z to a-z, digits, small letters and bytes beyond ASCII as they are, the rest to a blank.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def _zero_tables() -> list[np.ndarray]:
    """Tables by which a CRC passes 2^k zero bytes, k from 0: one row of 256 for each of its bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    values = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one, *((values << np.uint32(8 * (k - 1))) for k in (1, 2, 3))])]
    for _ in range(31):
        last = tables[-1]
        tables.append(np.stack([_pass(last, row) for row in last]))
    return tables


def _pass(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


_ZEROS = _zero_tables()


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and the bytes in B."""
    moved = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        moved[at] = _pass(_ZEROS[k], moved[at])
    return moved ^ right


class Payloads(NamedTuple):
    """CRC-32 and bytes of the words of several texts one after another, and whose they are."""

    crc: np.ndarray
    length: np.ndarray
    row: np.ndarray


def scan(texts: list[str | None]) -> Payloads:
    """Words of the texts, found by an automaton over their distinct delimiter-bounded words."""
    spelt = [(t or "").encode("utf-8").translate(_TO_WORDS) for t in texts]
    joined = b" " + b" ".join(spelt) + b" "
    words = list(set(joined.split()))
    if not words:
        nothing = np.zeros(0, np.int64)
        return Payloads(nothing.astype(np.uint32), nothing, nothing)
    automaton = ahocorasick.Automaton()
    for k, word in enumerate(words):
        automaton.add_word(f" {word.decode('latin-1')} ", k)
    automaton.make_automaton()
    found = automaton.iter(joined.decode("latin-1"))
    pairs = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    # The delimiter that ends a text's last word stands right behind the text.
    ends = np.cumsum([len(s) + 1 for s in spelt])
    return Payloads(crc[pairs[:, 1]], length[pairs[:, 1]], np.searchsorted(ends, pairs[:, 0], "left"))


def features(payloads: Payloads, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to `longest` neighbouring words of a text."""
    crc, row = payloads.crc, payloads.row
    blank = np.uint32(zlib.crc32(b" "))
    found = [(crc % buckets, row)]
    for size in range(2, longest + 1):
        n = max(0, len(payloads.crc) - size + 1)
        one = np.ones(n, np.int64)
        last, length = payloads.crc[size - 1 :], payloads.length[size - 1 :]
        crc = compose(compose(crc[:n], np.full(n, blank), one), last, length)
        inside = payloads.row[:n] == payloads.row[size - 1 :]
        found.append((crc[inside] % buckets, payloads.row[:n][inside]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


_ENCODED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())]
)


def _width(buckets: int) -> np.dtype:
    """The smallest unsigned type that holds every bucket."""
    return np.min_scalar_type(max(0, buckets - 1)).newbyteorder("<")


def encode(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every whole text, as bytes."""
    width = _width(buckets)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            payloads = scan(batch.column(1).to_pylist())
            bucket, row = features(payloads, longest, buckets)
            if longest > 1:
                bucket = bucket[np.argsort(row, kind="stable")]
            found = bucket.astype(width).tobytes()
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows)) * width.itemsize
            bounds = zip([0, *ends[:-1].tolist()], ends.tolist())
            parts = pa.array([found[start:end] for start, end in bounds], pa.binary())
            words = pa.array(np.bincount(payloads.row, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), words, parts], _ENCODED.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(spell, _ENCODED)


def bucket_counts(encoded: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of `encode`; each task sends its sums, and no more than
    one row per bucket reaches the driver."""
    width = _width(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches, 0, SLICE_BYTES):
            bucket = np.frombuffer(b"".join(batch.column(0).to_pylist()), width)
            total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counted = encoded.select("buckets").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of the B buckets."""
    b = len(raw)
    both, aimed = int(raw.sum()) + b, int(target.sum()) + b
    return np.array(
        [math.floor(1000 * math.log((t + 1) * both / ((s + 1) * aimed))) for s, t in zip(raw.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise times 1000, floored, from a hash of the id; a null id reads as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])


def weigh(encoded: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain) and score of every row of `encode`."""
    width = _width(len(gain))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2, SLICE_BYTES):
            ids, words, parts = batch.columns
            bucket = np.frombuffer(b"".join(parts.to_pylist()), width)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            n = pc.binary_length(parts).to_numpy().astype(np.int64) // width.itemsize
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            score = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, words, *map(pa.array, (n, weight, score))], _SCORED.fieldNames())

    return encoded.select("doc_id", "n_words", "buckets").mapInArrow(rate, _SCORED)


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = SHARE_PERCENT) -> DataFrame:
    """Add the rank of the drawn documents: the highest scores, ties to the smaller doc_id.

    Scores are whole numbers, so a count of each, a bounded table, says where the draw ends
    and how many documents stand before each score; only ties are put in order, score by
    score. Equal rows are one row with a number until they are listed again.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    counted = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted(((r[0], r[1]) for r in counted.collect()), reverse=True)
    total = sum(n for _, n in counts) * percent // 100
    offsets, before = [], 0
    for score, n in counts:
        if before >= total:
            break
        offsets.append((score, before))
        before += n
    undrawn = F.lit(None).cast("long").alias("rank")
    columns = ("doc_id", "n_features", "weight", "score")
    if not offsets:
        return scored.select(*columns, undrawn)
    last = offsets[-1][0]
    ahead = spark.createDataFrame(offsets, "score long, ahead long")
    rows = scored.where(able & (F.col("score") >= last)).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    ties = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    passed = F.col("ahead") + F.sum("copies").over(ties.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    placed = rows.join(F.broadcast(ahead), "score").withColumn("passed", passed)
    places = F.sequence(F.col("passed") + 1, F.col("passed") + F.col("copies"))
    placed = placed.select(*columns, F.explode(places).alias("place"))
    drawn = placed.select(*columns, F.when(F.col("place") <= total, F.col("place")).alias("rank"))
    return drawn.union(scored.where(~able | (F.col("score") < last)).select(*columns, undrawn))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = SHARE_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Draw `percent` of the documents towards the texts of `target`; all documents are returned
    with n_features, weight, score and rank (null if not drawn).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A null or
    empty text has no words, weight 0, and is never drawn. Ties go to the smaller doc_id, a
    null one last; repeated rows follow each other. With an empty target all gains come from
    the raw corpus alone; an empty table gives no rows. Other columns are not read.
    """
    encoded = stage_table(encode(docs, longest, buckets), "buckets")
    aimed = encode(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(encoded, buckets), bucket_counts(aimed, buckets))
    return draw(stage_table(weigh(encoded, gain, seed), "importance"), least_words, percent)
