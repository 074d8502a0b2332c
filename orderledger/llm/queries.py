"""One query per operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    anchors,
    backoff_lm,
    importance,
    language,
    matrix_bpe,
    near_duplicates,
    packing,
    prefix_bpe,
    quality,
    secret_scan,
    spelling,
    topk,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and hashed n-gram likelihood ratio of every whole document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document by a string-kernel SVM."""
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others, exactly."""
    whole = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(whole, whole.where("vec_id % 20 = 0"), 20)


ORACLES["op5_threshold_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op6_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by its nearest centroid."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every whole text by prefix dynamic programming, and the text decoded from them."""
    return prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), digests=True)


@query
def op8_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, found by anchors and local parsers."""
    return anchors.personal_data(table(spark, sf_dir, "documents"))


@query
def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under a smoothed bigram automaton."""
    return backoff_lm.score(table(spark, sf_dir, "documents"))


@query
def op10_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of a possible secret, with the forest's score and verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op11_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every whole text by merges in padded matrices, and the bytes decoded from them."""
    return matrix_bpe.encode_decode(table(spark, sf_dir, "documents"), digests=True)


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its more frequent spelling and the root of its group."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and rank in a tenth drawn towards the benchmark's texts."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
