"""Language of whole texts by the nearest of several centroids per language.

A text is the unit vector of its hashed character n-grams, weighted by TF-IDF. Each
language has a few centroids found by spherical k-means over a bounded sample of its labelled
documents. The centroid with the highest cosine names the language; a text too far from it
for its length is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import text_slices

DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Labelled documents per language that its centroids are fitted on, about.
FIT_ROWS = 400
#: A text is rejected when its cosine is below this share of the low quantile QUANTILE that the
#: samples, cut to the least length of its bin, show for its centroid; the shortest are not rejected.
REJECTION, QUANTILE = 0.8, 0.01
#: Samples of a bin with which a centroid has a quantile of its own, else its language's holds.
_MEMBERS = 50
UNKNOWN = "und"

_GRAMS = (1, 2, 3)
_BATCH_TEXTS, _BATCH_CHARS = 128, 400_000
#: Lengths, in letters, between which the lowest accepted cosine may differ.
_LENGTHS = np.array([8, 16, 32, 64, 128, 256, 512])


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a blank; for the first plane."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row of DIMENSIONS numbers for each text."""
    sizes = np.array([len(t) + 2 for t in texts])
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _folded()
    codes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (row[1:] != row[:-1])
    codes, row = codes[keep].astype(np.uint64), row[keep]
    counts = np.zeros(len(texts) * DIMENSIONS)
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(_GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        value = (value[:size] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
        if n in _GRAMS:
            inside = row[:size] == row[n - 1 :]
            if n == 1:
                inside &= codes != 32
            bucket = (value[inside] >> np.uint64(40)) % np.uint64(DIMENSIONS)
            place = row[:size][inside] * DIMENSIONS + bucket.astype(np.int64)
            counts += np.bincount(place, minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf, scaled to length 1; a text without n-grams stays zero."""
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    length = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return (weights / np.maximum(length, 1e-12)).astype(np.float32)


def _letters(counts: np.ndarray) -> np.ndarray:
    return counts.sum(axis=1) / len(_GRAMS)


def _beginning(text: str, letters: int) -> str:
    """The text up to where it has about so many letters."""
    seen = 0
    for i, char in enumerate(text):
        seen += char.isalpha()
        if seen >= letters:
            return text[: i + 1]
    return text


def _slices(texts: list[str]) -> Iterator[slice]:
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= _BATCH_TEXTS or chars + len(text) > _BATCH_CHARS):
            yield slice(start, i)
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids; begins with the vector nearest the mean and goes on with the farthest."""
    first = int(np.argmax(vectors @ vectors.mean(axis=0)))
    chosen = [first]
    nearest = vectors @ vectors[first]
    while len(chosen) < min(k, len(vectors)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    centroids = vectors[chosen]
    owner = None
    for _ in range(rounds):
        now = np.argmax(vectors @ centroids.T, axis=1)
        if owner is not None and (now == owner).all():
            break
        owner = now
        for c in range(len(centroids)):
            if (members := vectors[owner == c]).size:
                mean = members.sum(axis=0)
                centroids[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centroids


class LanguageModel(NamedTuple):
    """Languages by centroid, the centroids, the IDF weights and the lowest accepted cosines,
    by centroid and bin of lengths."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    lowest: np.ndarray


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, by dimension, of those that hold it; summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in text_slices(batches, 0):
            texts = [t for t in batch.column(0).to_pylist() if t]
            for part in _slices(texts):
                total[:-1] += (gram_counts(texts[part]) > 0).sum(axis=0)
            total[-1] += len(texts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["dimension", "texts"])

    parts = docs.select("text").mapInArrow(count, "dimension long, texts long")
    found = np.zeros(DIMENSIONS + 1, np.int64)
    for dimension, texts in parts.groupBy("dimension").agg(F.sum("texts")).collect():
        found[dimension] = texts
    return int(found[-1]), found[:-1]


def train(docs: DataFrame) -> LanguageModel:
    """Fit on rows of (text, lang) without nulls; `sample` must be there too, a number from 0 to 1.

    IDF weights come from all of them. Centroids come from about FIT_ROWS documents of each
    language, those with `sample` below FIT_ROWS over the language's count.
    """
    total, frequency = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros((0, len(_LENGTHS) + 1)))
    share = docs.sparkSession.createDataFrame([(k, FIT_ROWS / n) for k, n in counts.items()], "lang string, share double")
    chosen = docs.join(F.broadcast(share), "lang").where("sample < share").select("lang", "text")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("text", kind="stable")
        texts = frame["text"].tolist()
        parts = [gram_counts(texts[part]) for part in _slices(texts)]
        vectors = np.concatenate([unit_vectors(p, idf) for p in parts])
        letters = np.concatenate([_letters(p) for p in parts])
        centroids = spherical_kmeans(vectors, CENTROIDS)
        lowest = np.zeros((len(centroids), len(_LENGTHS) + 1))
        for k, least in enumerate(_LENGTHS, 1):
            pieces = [cut for t, n in zip(texts, letters) if n >= least and (cut := _beginning(t, least))]
            if not pieces:
                lowest[:, k] = lowest[:, k - 1]
                continue
            cosine = np.concatenate([unit_vectors(gram_counts(pieces[p]), idf) for p in _slices(pieces)]) @ centroids.T
            near, value = cosine.argmax(axis=1), cosine.max(axis=1)
            for c in range(len(centroids)):
                own = value[near == c]
                lowest[c, k] = np.quantile(own if len(own) >= _MEMBERS else value, QUANTILE)
        lang = frame["lang"].iloc[0]
        return pd.DataFrame({"lang": lang, "centroid": list(centroids.astype(float)), "lowest": list(lowest)})

    fitted = chosen.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<double>, lowest array<double>")
    rows = sorted(fitted.collect(), key=lambda r: r[0])  # CENTROIDS rows for each language
    if not rows:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros((0, len(_LENGTHS) + 1)))
    lowest = np.array([r[2] for r in rows])
    return LanguageModel([r[0] for r in rows], np.array([r[1] for r in rows], np.float32), idf, REJECTION * lowest)


def classify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, for each text."""
    language, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rejected = np.ones(len(texts), bool)
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
    plain = [texts[i] for i in known]
    for part in _slices(plain):
        counts = gram_counts(plain[part])
        cosine = unit_vectors(counts, model.idf) @ model.centroids.T
        best = cosine.argmax(axis=1)
        size = np.searchsorted(_LENGTHS, _letters(counts))
        for i, c, s, n in zip(known[part], best, cosine[np.arange(len(best)), best], size):
            language[i], score[i] = model.languages[c], min(1.0, max(0.0, float(s)))
            rejected[i] = score[i] < model.lowest[c, n]
    return language, score, rejected


PREDICTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id mod 5 is not 0, language and text are not null."""
    sample = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return docs.where(usable & ~_held_out(F.col("doc_id"))).select("text", "lang", sample.alias("sample"))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Language, cosine and rejection of every whole text, in one pass without a shuffle.

    A text that is null or has no letter is `und`, with score 0, and rejected. Other texts
    carry their nearest language even if they are rejected. Repeated rows are classified as
    they are; ties go to the language whose name comes first.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            language, score, rejected = classify(batch.column(1).to_pylist(), model)
            columns = [batch.column(0).cast(pa.int64()), pa.array(language, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, PREDICTED.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(name, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of `docs` that are not held out and predict all of them."""
    held_out = F.coalesce(_held_out(F.col("doc_id")), F.lit(False))
    return predict(docs, train(training_rows(docs))).withColumn("held_out", held_out)


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known: neither far from all centroids
    nor without a letter. With no labelled row nothing can be told, and all rows stay."""
    model = train(training_rows(docs))
    if not model.languages:
        return docs
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column):
            rejected = classify(batch.column(column).to_pylist(), model)[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)
