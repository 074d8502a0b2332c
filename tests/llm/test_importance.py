import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docs import frame, rows
from orderledger.llm import importance
from orderledger.llm.importance import compose, features, resample, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def _runs(words, longest):
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    """docs: (doc_id, text). Rows of the result as tuples, in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = Counter(), Counter()
    for _, text in docs:
        raw.update(map(bucket, _runs(_words(text), longest)))
    for text in target:
        aim.update(map(bucket, _runs(_words(text), longest)))
    S, U = sum(raw.values()), sum(aim.values())
    out = []
    for doc_id, text in docs:
        words = _words(text)
        gains = [
            math.floor(1000 * math.log((aim[b] + 1) * (S + buckets) / ((raw[b] + 1) * (U + buckets))))
            for b in map(bucket, _runs(words, longest))
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(gains), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows(df)), key=repr)


def test_crcs_compose():
    pick = random.Random(2)
    parts = [(pick.randbytes(pick.randrange(9)), pick.randbytes(pick.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    left, right = (np.array([zlib.crc32(x) for x in side], np.uint32) for side in zip(*parts))
    got = compose(left, right, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_scan_finds_every_word_of_every_text():
    texts = ["", None, "A a-A aa a", "x" * 3000 + " É é z9", "  ", "!?", "日本 語 a"]
    payloads = scan(texts)
    expected = [(zlib.crc32(w.encode()), len(w.encode()), i) for i, t in enumerate(texts) for w in _words(t)]
    assert list(zip(payloads.crc.tolist(), payloads.length.tolist(), payloads.row.tolist())) == expected
    assert len(scan([None, "?!"]).crc) == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_features_equal_spelt_out_runs(longest):
    texts = ["the quick brown fox", "fox", "", "The quick, brown-fox the"]
    bucket, row = features(scan(texts), longest, 997)
    got = sorted(zip(row.tolist(), bucket.tolist()))
    assert got == sorted((i, zlib.crc32(f.encode()) % 997) for i, t in enumerate(texts) for f in _runs(_words(t), longest))


def _docs(n=400):
    pick = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "delta9", "épsilon", "zeta", "日本", "theta", "iota", "kappa"]
    docs = [(i % 350, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]
    return docs + [(None, None), (None, "alpha " * 30), (7, ""), (1 << 40, "alpha, beta " * 500)]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 37), (1, 0), (1, 100)])
def test_draw_equals_brute_force(spark, longest, percent):
    docs = _docs()
    target = ["alpha alpha kappa", None, "", "kappa alpha kappa 日本"]
    got = resample(frame(spark, docs, extra=True), frame(spark, list(enumerate(target))), longest, percent=percent)
    assert result(got) == brute(docs, target, longest, percent=percent)


def test_copies_of_one_document_share_a_rank_range(spark):
    docs = [(5, "alpha beta " * 15)] * 1000 + [(i, "gamma delta " * 15) for i in range(100, 200)]
    got = resample(frame(spark, docs), frame(spark, [(1, "alpha beta")]), percent=50)
    assert result(got) == brute(docs, ["alpha beta"], percent=50)


def test_empty_tables(spark):
    docs, nothing = frame(spark, [(1, "word " * 30), (2, "other " * 30)]), frame(spark, [])
    assert resample(nothing, docs).count() == 0
    assert result(resample(docs, nothing, percent=50)) == brute([(1, "word " * 30), (2, "other " * 30)], [], percent=50)


def test_whole_table(spark, sf_documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in sf_documents.collect()]
    target = [r.text for r in benchmark.collect()]
    assert result(resample(sf_documents, benchmark)) == brute(docs, target)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 250), (2, 70_000)])
def test_each_text_is_scanned_once(spark, tmp_path, monkeypatch, longest, buckets):
    """One pass over the texts serves both the counts and the weights."""
    real, log = importance.scan, tmp_path / "scans"

    def counted(texts):
        with log.open("a") as out:
            out.write("x" * len(texts))
        return real(texts)

    monkeypatch.setattr(importance, "scan", counted)
    docs, target = _docs(60), ["alpha alpha kappa", None, "kappa 日本"]
    got = resample(frame(spark, docs), frame(spark, list(enumerate(target))), longest, buckets, percent=30)
    assert result(got) == brute(docs, target, longest, buckets, percent=30)
    assert len(log.read_text()) == len(docs) + len(target)
