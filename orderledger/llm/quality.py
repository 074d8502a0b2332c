"""Quality rules: counted base rules, then a likelihood ratio of hashed n-grams.

Two multinomials over hashed word and word-pair buckets, one of all trusted documents and one
of the whole raw corpus, give every document the mean log ratio of its n-grams. A document
whose mean lies below a threshold taken from all labelled documents is dropped; nothing is
drawn at random.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_table
from .words import WordBatch, join_hash, mix, split_words, text_slices, windows, word_batch

BUCKETS = 1 << 14
#: Documents that `labelled_sample` gives at most; `assess` takes all labelled ones.
FIT_ROWS = 20_000
#: Share of the trusted documents that the threshold may cost.
TRUSTED_LOSS = 0.005
#: Parts that the rows of one id are dealt over when labels are joined to texts.
PARTS = 8
#: Cells that a step of 1 in the ratio is cut into while the threshold is sought; any number gives the same one.
CELLS = 4096

_BLANKS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_BLANK_BYTES = str.maketrans("", "", _BLANKS)


def _buckets(batch: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word and every pair of neighbouring words."""
    pairs, at = windows(batch, 2)
    singles = mix(batch.hashes)
    values = np.concatenate([singles, join_hash(pairs, np.uint64(2))])
    rows = np.concatenate([batch.row, batch.row[at]])
    return (values >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), rows


def _repeated_words(batch: WordBatch) -> np.ndarray:
    """For each document its words that lie in a 3-word window found twice or more in it."""
    value, at = windows(batch, 3)
    rows = batch.row[at]
    key = join_hash(value, rows.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begins = at[order[twice]]
    covered = np.zeros(len(batch.hashes), bool)
    for k in range(3):
        covered[begins + k] = True
    return np.bincount(batch.row[covered], minlength=len(batch.counts))


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """counts: raw and target counts by bucket. Add-one smoothed log ratio, target over raw."""
    smoothed = counts + 1.0
    shares = smoothed / smoothed.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def _mean_ratio(batch: WordBatch, ratios: np.ndarray) -> np.ndarray:
    bucket, rows = _buckets(batch)
    n = len(batch.counts)
    total = np.bincount(rows, weights=ratios[bucket], minlength=n)
    size = np.bincount(rows, minlength=n)
    return total / np.maximum(size, 1)


def labelled_sample(labels: DataFrame, value: int, rows: int = FIT_ROWS) -> frozenset[int]:
    """Ids of at most `rows` documents of that quality, those whose hashed id is smallest."""
    chosen = (
        labels.where((F.col("quality") == value) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return frozenset(r[0] for r in chosen.collect())


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and good (quality 1, or else 0) of every labelled document, one row each; an id
    with both labels is good."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))


def ngram_counts(docs: DataFrame, trusted: DataFrame | Collection[int]) -> np.ndarray:
    """Raw and trusted counts by bucket over all documents; two rows of BUCKETS numbers.

    `trusted` holds distinct ids, in a column doc_id if it is a frame. Every task adds up its
    own documents first, so a task sends one row per bucket.
    """
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(i,) for i in trusted], "doc_id long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in text_slices(batches):
            wanted = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            words = word_batch([split_words(t.as_py()) for t in batch.column(1)])
            bucket, rows = _buckets(words)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[wanted[rows]], minlength=BUCKETS)
        used = np.flatnonzero(total[0])
        columns = [pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "raw", "target"])

    # Trusted ids grow with the corpus, so they are merged with the documents at any size. Every
    # id stands in each part, and documents are dealt over the parts, so rows of one id part too.
    every = F.explode(F.array(*map(F.lit, range(PARTS))))
    wanted = trusted.select("doc_id", every.alias("part"), F.lit(True).alias("wanted")).hint("merge")
    dealt = docs.select("doc_id", "text", (F.monotonically_increasing_id() % PARTS).cast("int").alias("part"))
    marked = dealt.join(wanted, ["doc_id", "part"], "left").select("wanted", "text")
    parts = marked.mapInArrow(count, "bucket long, raw long, target long")
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, BUCKETS), np.int64)
    for bucket, raw, target in sums.collect():  # BUCKETS rows at most
        counts[:, bucket] = raw, target
    return counts


SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType())]
)


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The base counts and the mean log ratio of every document, without a shuffle."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            words = word_batch([split_words(t) for t in texts])
            n = words.counts
            chars = [len(t) - sum(map(t.count, _BLANKS)) for t in texts]
            symbols = [sum(map(t.count, _SYMBOLS)) for t in texts]
            lines = [_duplicate_lines(t) for t in texts]
            repeated = _repeated_words(words)
            failed = (n < 50) | (100 * repeated > 50 * n)
            columns = [n, chars, symbols, lines, repeated]
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)]
            arrays += [pa.array(failed), pa.array(_mean_ratio(words, ratios))]
            yield pa.RecordBatch.from_arrays(arrays, SCORED.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(rate, SCORED)


def threshold(scored: DataFrame, marks: DataFrame) -> float:
    """The ratio that parts the distrusted from the trusted documents best.

    Among all trusted documents that pass the base rules, the one is found that, as the
    lowest one kept, gives the best sum of both rates and costs at most TRUSTED_LOSS of them;
    of equals the lowest. The cut lies halfway to the next distrusted document below it.
    With no trusted documents nothing is dropped by ratio.

    Counts by cell, a bounded table, say how many documents lie below each cell; inside a
    cell its own rows tell.
    """
    spark = scored.sparkSession
    seen = scored.where(~F.col("base_failed")).select("doc_id", "ratio").join(marks, "doc_id")
    counts = seen.groupBy("ratio").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = stage_table(counts.withColumn("cell", F.floor(F.col("ratio") * CELLS)), "ratios")
    cells = sorted(counts.groupBy("cell").agg(F.sum("good"), F.sum("bad")).collect())
    n_good, n_bad = (sum(c[k] for c in cells) for k in (1, 2))
    if not n_good:
        return float("-inf")
    most = int(TRUSTED_LOSS * n_good)
    below, good, bad = [], 0, 0
    for cell, here_good, here_bad in cells:
        if good <= most:
            below.append((cell, good, bad))
        good, bad = good + here_good, bad + here_bad
    starts = spark.createDataFrame(below, "cell long, good_below long, bad_below long")
    inside = Window.partitionBy("cell").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.col("good_below") + F.coalesce(F.sum("good").over(inside), F.lit(0))
    caught = F.col("bad_below") + F.coalesce(F.sum("bad").over(inside), F.lit(0))
    cuts = counts.join(F.broadcast(starts), "cell").select("ratio", "good", lost.alias("lost"), caught.alias("caught"))
    gain = F.col("caught") / F.lit(max(1, n_bad)) - F.col("lost") / F.lit(n_good)
    able = cuts.where((F.col("good") > 0) & (F.col("lost") <= most))
    lowest = able.orderBy(gain.desc(), "ratio").first()["ratio"]
    nearest = counts.where((F.col("bad") > 0) & (F.col("ratio") < lowest)).agg(F.max("ratio")).first()[0]
    return lowest if nearest is None else (lowest + nearest) / 2


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, ratio and verdict of every document.

    A null or empty text has no words and fails the base rules. Null or unknown ids in
    `labels` are passed over. Repeated rows are assessed as they are. Only doc_id and text
    of `docs` and doc_id and quality of `labels` are read.
    """
    marks = labelled(labels)
    ratios = log_ratios(ngram_counts(docs, marks.where("good")))
    scored = stage_table(score(docs, ratios), "quality")
    kept = ~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold(scored, marks)))
    return scored.withColumn("kept", kept)
