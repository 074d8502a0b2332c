"""Exact top-k by inner product with Fagin's threshold algorithm.

Rows and queries are dealt into blocks of bounded size, and every block of queries meets
every block of rows. In a block of rows each dimension has its list of rows sorted by value.
A query walks down the lists of its dimensions in steps, from the end that its sign favours,
scores the rows it meets for the first time in full, and stops when the sum of what the
lists could still give is below its kth score. The block results, k per query, are merged
by a partial top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 1_024
SCALE = 64


# The ends of a score; the lowest long is left out, as its negative is no long.
_MOST = (1 << 63) - 1


class SortedLists(NamedTuple):
    """A block of integer vectors; by dimension, its rows from the lowest value up, and the values."""

    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    values: np.ndarray
    largest: int


def _largest(numbers: np.ndarray) -> int:
    """The largest absolute value, as a Python integer."""
    return max(int(numbers.max()), -int(numbers.min())) if numbers.size else 0


def _exact_type(bound: int) -> type:
    """The fastest number type that holds all sums of products up to ``bound`` exactly."""
    if bound < 1 << 24:
        return np.float32
    return np.float64 if bound < 1 << 53 else np.int64 if bound <= _MOST else object


def sorted_lists(ids: np.ndarray, vectors: np.ndarray) -> SortedLists:
    """Vectors whose sums of products stay below 2**24 are held in single precision, exactly;
    those that double precision may not hold as integers of 64 bits."""
    largest = _largest(vectors)
    kind = _exact_type(vectors.shape[1] * largest**2)
    vectors = vectors.astype(np.int64 if kind is object else kind, copy=False)
    columns = np.ascontiguousarray(vectors.T)
    order = np.argsort(columns, axis=1, kind="stable").astype(np.int32)
    return SortedLists(ids, vectors, order, np.take_along_axis(columns, order, axis=1), largest)


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(-_MOST, min(int(s), _MOST)) for s in scores], np.int64)
    return scores if scores.dtype == np.int64 else np.rint(scores).astype(np.int64)


def _keep(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def threshold_search(block: SortedLists, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the k best rows but the query's own, and the depth it went to."""
    n = len(block.ids)
    used = np.flatnonzero(query)
    if not len(used):  # every row scores 0
        ids = np.sort(block.ids[block.ids != own])[:k]
        return ids, np.zeros(len(ids), np.int64), 0
    weights = query[used]
    down, up = used[weights > 0], used[weights < 0]
    exact = _exact_type(len(query) * _largest(query) * block.largest)
    vectors, values = block.vectors, block.values
    if exact in (np.int64, object):
        vectors, values = (a.astype(np.int64, copy=False).astype(exact, copy=False) for a in (vectors, values))
    vector = query.astype(exact) if exact is not object else query.astype(np.int64).astype(object)
    seen = np.zeros(n, bool)
    ids, scores = np.zeros(0, block.ids.dtype), np.zeros(0, np.int64)
    depth, step = 0, max(k, n // 256)
    while depth < n:
        until = min(n, depth + step)
        met = np.zeros(n, bool)
        met[block.order[down, n - until : n - depth]] = True
        met[block.order[up, depth:until]] = True
        met &= ~seen
        seen |= met
        if 4 * np.count_nonzero(~seen) < n:  # the lists' rests hold few rows: meet them all
            met |= ~seen
            seen[:] = True
            until = n
        # Products of integers that the number type holds exactly.
        if 4 * np.count_nonzero(met) > n:
            found = (vectors @ vector)[met]
        else:
            found = vectors[met] @ vector
        found, names = _as_long(found), block.ids[met]
        if len(scores) == k:  # equal scores may have the smaller id
            found, names = found[found >= scores[-1]], names[found >= scores[-1]]
        mine = names != own
        ids, scores = _keep(np.concatenate([ids, names[mine]]), np.concatenate([scores, found[mine]]), k)
        last = vector[down] @ values[down, n - until] + vector[up] @ values[up, until - 1]
        depth, step = until, step * 4
        # A row not met yet scores at most `last`; only a kth score above it stops the walk,
        # since a row with an equal score could have the smaller id.
        if len(scores) == k and scores[-1] > max(last, -_MOST):
            break
    return ids, scores, depth


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """A row of 64-bit integers per vector, shorter ones filled with zeros."""
    rows = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(rows, vectors):
        row[: len(vector)] = vector
    return rows


def integer_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and floor(64 * x) of every component; rows whose vector is null, or holds a null or
    non-finite component, or whose id is null, are left out. A component beyond a long is its end."""
    component = F.transform(vector_column, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    broken = F.exists(
        vector_column,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    usable = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~broken
    return df.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), component.alias("vector"))


_HITS = "query_id long, vec_id long, score long"


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows, ties to the smaller id.

    Both frames hold (vec_id, vector) with integer components; a row with the query's own id is
    no candidate. Fewer than k rows come back when there are fewer. Repeated ids count as rows of
    their own. A vector shorter than another counts as ending in zeros.

    Scores are sums of integers, exact at any size: numbers that double precision cannot hold are
    added as integers of 64 bits or, where those could overflow, as Python's. A score beyond a
    long is given as 2**63 - 1 or its negative; such scores tie.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks = max(1, -(-n_rows // ROWS_PER_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    # Every block of the one side is sent to each block of the other.
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = rows.withColumn("r", dealt(row_blocks)).withColumn("q", to_all(query_blocks))
    right = queries.withColumn("q", dealt(query_blocks)).withColumn("r", to_all(row_blocks))

    def search(left_part: pd.DataFrame, right_part: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if left_part.empty or right_part.empty:
            return none
        width = max(left_part["vector"].map(len).max(), right_part["vector"].map(len).max())
        block = sorted_lists(left_part["vec_id"].to_numpy(), _matrix(left_part["vector"], width))
        out = []
        for own, vector in zip(right_part["vec_id"].to_numpy(), _matrix(right_part["vector"], width)):
            ids, scores, _ = threshold_search(block, vector, own, k)
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else none

    met = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(search, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
