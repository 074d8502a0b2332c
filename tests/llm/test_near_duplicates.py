import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docs import frame, rows
from orderledger.llm import near_duplicates as nd
from orderledger.llm.components import components


def shingles(text):
    words = (text or "").lower().split(" ") if text and "\n" not in text else (text or "").lower().split()
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """(class id, links) of every row, comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and small >= 0.8 * large and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids[root(i)].append(doc)
    return Counter((doc, min(ids[root(i)], default=None) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(docs))


def made(spark, docs, extra=False):
    got = nd.near_duplicates(frame(spark, docs, extra))
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows(got))


def _copies(n, length, changes, seed):
    pick = random.Random(seed)
    words = ["w%d" % pick.randint(0, 5000) for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(pick.randint(0, changes)):
            own[pick.randrange(length)] = "x%d" % pick.randint(0, 10**6)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("blocks", [(2048, 512), (7, 5)])
def test_all_pairs_by_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(nd, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(nd, "CLUSTER_BLOCK", blocks[1])
    texts = _copies(40, 120, 6, 1) + _copies(12, 60, 2, 2) + ["same text with six words here"] * 9
    texts += [f"shared passage of many plain words {'of the same kind ' * 3} and own {i} {i * 7} {i * 11} {i * 13}" for i in range(20)]
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    assert made(spark, docs) == brute(docs)


def test_awkward_rows(spark):
    long_text = " ".join(f"t{i % 997}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  WORDS"), (6, "one"), (7, long_text), (8, long_text + " end"),
            (9, "same words in one row here"), (9, "same words in one row here"), (None, "same words in one row here")]
    assert made(spark, docs, extra=True) == brute([(i, " ".join((t or "").split())) for i, t in docs])
    assert made(spark, []) == Counter()
    assert made(spark, [(1, "only one text of a few words")]) == Counter([(1, 1, 0)])


def test_tables_by_brute_force(spark, sf_documents):
    docs = [(i, " ".join(t.split())) for i, t in sf_documents.select("doc_id", "text").collect()]
    got = nd.near_duplicates(sf_documents)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows(got)) == brute(docs)


def test_pruning_keeps_what_can_reach_the_threshold():
    fewest = nd.least_matches()
    assert all(a <= b for a, b in zip(fewest, fewest[1:])) and fewest[80] < 0.8 * 80
    from math import comb

    # The posterior by numerical integration of the likelihood over a uniform prior.
    grid = np.linspace(0, 1, 200_001)
    for n in (16, 80):
        for m in (fewest[n] - 1, fewest[n]):
            density = comb(n, m) * grid**m * (1 - grid) ** (n - m)
            posterior = density[grid >= 0.8].sum() / density.sum()
            assert (posterior >= nd.TOLERANCE) == (m == fewest[n])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100), (7, 7), (300, 301)] + [(500, k) for k in range(501, 560)]
    got = dict((r["node"], r["component"]) for r in rows(components(spark.createDataFrame(pairs, "src long, dst long"))))
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[102] == 100 and got[559] == 500
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
