import re
from collections import Counter

import numpy as np
import pytest

from docs import frame, rows
from orderledger.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated_lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def test_base_counts_by_brute_force(spark, sf_documents):
    odd = [(1, None), (1, None), (2, ""), (3, "a b c a b c a b\n\n \na b\na b\x1c c d   e"), (None, "x " * 60), (4, "ß#*" * 9000)]
    flat = quality.log_ratios(np.zeros((2, quality.BUCKETS)))
    for docs in (frame(spark, odd, extra=True), sf_documents):
        texts = Counter(t for _, t in docs.select("doc_id", "text").collect())
        got = rows(docs.select("doc_id", "text").transform(lambda d: quality.score(d, flat)))
        assert len(got) == sum(texts.values())
        for row, (_, text) in zip(got, docs.select("doc_id", "text").collect()):
            assert {k: row[k] for k in brute(text)} == brute(text)
            assert row["ratio"] == 0


def test_ratio_by_brute_force(spark):
    """The mean log ratio of two multinomials, counted here by plain dictionaries of buckets."""
    texts = {1: "good words " * 40, 2: "bad bad " * 40, 3: "good bad", 4: None}
    docs = frame(spark, list(texts.items()))
    counts = quality.ngram_counts(docs, frozenset({1}))
    assert counts[0].sum() == sum(2 * len(t.split()) - 1 for t in texts.values() if t)
    assert counts[1].sum() == 159
    ratios = quality.log_ratios(counts)
    got = {r["doc_id"]: r["ratio"] for r in rows(quality.score(docs, ratios))}
    assert got[1] > got[3] > got[2] and got[4] == 0
    assert got[1] == np.float64(got[1]) and abs(np.exp(ratios) @ ((counts[0] + 1) / (counts[0] + 1).sum()) - 1) < 1e-9


def test_labels_part_documents(spark, sf_documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.assess(docs, labels).join(labels, "doc_id").where("not base_failed")
    good = got.where("quality = 1")
    assert good.where("kept").count() >= 0.99 * good.count()
    bad = got.where("quality = 0")
    assert bad.where("not kept").count() >= 0.9 * bad.count()


def test_empty_tables(spark, sf_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.assess(frame(spark, []), none).count() == 0
    kept = quality.assess(frame(spark, [(1, "w%d " * 60), (2, "a b")]), none)
    assert {r["doc_id"]: r["base_failed"] for r in rows(kept)} == {1: True, 2: True}
    nulls = spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 1, 1), (5, 1, 1)], none.schema)
    assert quality.labelled_sample(nulls, 1) == {5}


def _cut(good, bad):
    """The threshold from sorted arrays of all ratios."""
    if not len(good):
        return float("-inf")
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(good[: int(quality.TRUSTED_LOSS * len(good)) + 1])
    gain = np.searchsorted(bad, cuts) / max(1, len(bad)) - np.searchsorted(good, cuts) / len(good)
    lowest = cuts[np.argmax(gain)]
    below = bad[bad < lowest]
    return (lowest + below[-1]) / 2 if len(below) else lowest


def test_counts_and_threshold_take_all_labelled_documents(spark):
    """More trusted documents than FIT_ROWS, in 60 texts whose counts are added up here."""
    pick = np.random.default_rng(3)
    n, kinds = quality.FIT_ROWS + 3_000, 60
    texts = [" ".join(f"w{w}" for w in pick.integers(0, 40 + 10 * k, 60)) for k in range(kinds)]
    kind = np.minimum(pick.geometric(0.12, 2 * n) - 1, kinds - 1)
    kind[n:] = kinds - 1 - kind[n:]
    counts, buckets = np.zeros((2, quality.BUCKETS)), []
    for k, text in enumerate(texts):
        bucket, _ = quality._buckets(quality.word_batch([quality.split_words(text)]))
        buckets.append(bucket)
        once = np.bincount(bucket, minlength=quality.BUCKETS)
        counts += np.outer([(kind == k).sum(), (kind[:n] == k).sum()], once)
    ratios = quality.log_ratios(counts)
    expected = np.array([np.bincount(np.zeros(len(b), int), weights=ratios[b])[0] / len(b) for b in buckets])
    cut = _cut(expected[kind[:n]], expected[kind[n:]])
    docs = spark.createDataFrame(list(enumerate(kind.tolist())), "doc_id long, kind int")
    docs = docs.join(spark.createDataFrame(list(enumerate(texts)), "kind int, text string"), "kind")
    labels = spark.range(2 * n).selectExpr("id AS doc_id", f"CAST(id < {n} AS INT) AS quality")
    got = quality.assess(docs, labels).join(docs.select("doc_id", "kind"), "doc_id").groupBy("kind", "ratio", "kept").count()
    seen = {r["kind"]: (r["ratio"], r["kept"]) for r in rows(got)}
    assert got.count() == len(seen) == len(set(kind.tolist()))
    for k, (ratio, kept) in seen.items():
        assert abs(ratio - expected[k]) < 1e-12 and kept == (expected[k] >= cut)


@pytest.mark.parametrize("cells", [1, 8, 4096])
def test_threshold_by_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(quality, "CELLS", cells)
    pick = np.random.default_rng(cells)
    for n_good, n_bad, digits in ((3000, 400, 1), (3000, 400, 3), (900, 500, 15), (1, 0, 3), (0, 5, 3), (5, 1, 0)):
        good, bad = pick.normal(0.5, 1, n_good).round(digits), pick.normal(-2, 1, n_bad).round(digits)
        found = [*((float(r), True) for r in good), *((float(r), False) for r in bad)]
        scored = [(i, i % 50 == 49, r) for i, (r, _) in enumerate(found)] + [(10**6, False, -9.0), (None, False, -9.0)]
        scored = spark.createDataFrame(scored, "doc_id long, base_failed boolean, ratio double")
        marks = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(found)] + [(10**7, True)], "doc_id long, good boolean")
        passed = [(r, g) for i, (r, g) in enumerate(found) if i % 50 != 49]
        sides = ([r for r, g in passed if g == side] for side in (True, False))
        assert quality.threshold(scored, marks) == _cut(*map(np.array, sides))


def test_labels_of_one_document(spark):
    found = [(1, 1), (1, 0), (1, None), (2, 0), (2, 0), (3, None), (4, 7), (None, 1), (5, 1)]
    labels = spark.createDataFrame(found, "doc_id int, quality int")
    assert {(r["doc_id"], r["good"]) for r in rows(quality.labelled(labels))} == {(1, True), (2, False), (5, True)}
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, "c"), (None, "d")], extra=True)
    counts = quality.ngram_counts(docs, quality.labelled(labels).where("good"))
    assert counts.sum(axis=1).tolist() == [8, 6]


def test_rows_of_one_id_are_dealt_over_parts_and_counted_once(spark):
    docs = frame(spark, [(7, "a b")] * 500 + [(None, "c d")] * 500 + [(8, "e")])
    assert quality.ngram_counts(docs, frozenset({7})).sum(axis=1).tolist() == [3001, 1500]
