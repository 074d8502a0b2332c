import numpy as np
from pyspark.sql import functions as F

from docs import rows
from orderledger.llm import topk


def brute(ids, vectors, queries, k):
    out = set()
    for own, q in queries:
        scored = sorted((-int(v @ q), i) for i, v in zip(ids, vectors) if i != own)
        out |= {(own, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_one_block_with_ties():
    pick = np.random.default_rng(1)
    for n, d, high in ((1, 3, 2), (7, 4, 2), (300, 8, 3), (2000, 16, 40)):
        vectors = pick.integers(-high, high + 1, (n, d)).astype(float)
        ids = pick.permutation(n)
        block = topk.sorted_lists(ids, vectors)
        for own in range(min(n, 20)):
            q = vectors[own] if own else np.zeros(d)
            got = topk.threshold_search(block, q, own, 5)
            expected = sorted((-int(v @ q), i) for i, v in zip(ids, vectors) if i != own)[:5]
            assert list(zip(-got[1], got[0])) == expected


def test_walk_stops_early():
    pick = np.random.default_rng(2)
    vectors = np.zeros((5000, 4))
    vectors[:, 0] = pick.permutation(5000)
    block = topk.sorted_lists(np.arange(5000), vectors)
    assert topk.threshold_search(block, np.array([1.0, 0, 0, 0]), -1, 20)[2] < 500


def test_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 7)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = topk.integer_vectors(df.withColumn("score", F.lit("x")), "vec_id", "embedding")
    got = rows(topk.top_k(whole, whole.where("vec_id % 20 = 0"), 20))
    data = df.select("vec_id", "embedding").collect()
    ids = [r[0] for r in data]
    vectors = np.floor(64 * np.array([r[1] for r in data], float))
    expected = brute(ids, vectors, [(i, v) for i, v in zip(ids, vectors) if i % 20 == 0], 20)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5, 0.5]), (1, None), (2, [nan, 1.0]), (3, [1.0, inf]), (4, [None, 1.0]), (5, [1.0, -1.0]), (6, [0.5, 0.5]), (20, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    whole = topk.integer_vectors(df, "vec_id", "embedding")
    got = rows(topk.top_k(whole, whole.where("vec_id % 20 = 0"), 20))
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [
        (0, 1, 6, 2048), (0, 2, 5, 0), (0, 3, 20, 0), (20, 1, 0, 0), (20, 2, 5, 0), (20, 3, 6, 0)]
    none = whole.limit(0)
    assert topk.top_k(none, none, 20).count() == 0


def test_large_components_are_exact(spark):
    """Scores that double precision, or 64 bits, cannot hold, in one block and in rows of unlike size."""
    high = 2**27 + 1
    near = [[high, 1], [high, 2], [high, 3], [high, 0]]
    pick = np.random.default_rng(4)
    huge = [[int(x) for x in row] for row in pick.integers(-(2**62), 2**62, (40, 5))]
    mixed = huge[:3] + pick.integers(-9, 9, (40, 5)).tolist()
    for vectors, queries in ((near, near), (huge, huge), (mixed, mixed), (mixed[3:], huge)):
        block = topk.sorted_lists(np.arange(len(vectors)), np.array(vectors, np.int64))
        for own, q in enumerate(queries):
            scores = (max(1 - 2**63, min(sum(x * y for x, y in zip(q, v)), 2**63 - 1)) for v in vectors)
            expected = sorted((-s, i) for i, s in enumerate(scores) if i != own)[:3]
            got = topk.threshold_search(block, np.array(q, np.int64), own, 3)
            assert [(-int(s), int(i)) for i, s in zip(got[0], got[1])] == expected
    df = spark.createDataFrame([(i, v) for i, v in enumerate(near)], "vec_id long, vector array<long>")
    got = [(r["vec_id"], r["score"]) for r in rows(topk.top_k(df, df.where("vec_id = 3"), 3).orderBy("rank"))]
    assert got == [(0, high * high), (1, high * high), (2, high * high)]
    got = [(r["vec_id"], r["score"]) for r in rows(topk.top_k(df, df.where("vec_id = 2"), 3).orderBy("rank"))]
    assert got == [(1, high * high + 6), (0, high * high + 3), (3, high * high)]


def test_vectors_of_other_lengths_end_in_zeros(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [5]), (2, []), (3, [0, 1])], "vec_id long, vector array<long>")
    got = [(r["vec_id"], r["score"]) for r in rows(topk.top_k(df, df.where("vec_id = 0"), 9).orderBy("rank"))]
    assert got == [(1, 5), (3, 2), (2, 0)]
