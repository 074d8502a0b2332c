import math
import random
from itertools import combinations

import numpy as np
import pytest

from docs import crc, frame, rows
from orderledger.llm import toxicity


def brute_kernel(s, t):
    """Sum over common letter triples of the decayed spans in both words, scaled."""

    def triples(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            key = word[i] + word[j] + word[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = triples(s), triples(t)
    dot = lambda x, y: sum(v * y.get(f, 0) for f, v in x.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_kernel_by_brute_force():
    words = ["idiot", "idxiot", "iidiot", "editor", "abcabcabc", "the", "mississippi"]
    maps = toxicity.unit_map(words)
    for i, s in enumerate(words):
        codes = toxicity._codes([s])
        ids, weight = toxicity._features(codes)
        explicit = np.bincount(ids[0], weights=weight, minlength=32**3)
        assert toxicity.self_kernel(codes)[0] == pytest.approx(explicit @ explicit)
        for j, t in enumerate(words):
            assert maps[i] @ maps[j] == pytest.approx(brute_kernel(s, t), abs=1e-5)


def test_folded_weights_are_the_kernel_machine():
    weights, offset = toxicity.fit_words(["idiot", "moron"], ["house", "garden", "notion", "editor"], ["idiot", "moron", "house", "notion"])
    words = ["idiot", "idxiot", "garden", "x" * 60 + "idiot"]
    got = toxicity.word_margins(words, weights, offset)
    direct = toxicity.unit_map(words[:3]) @ weights + offset
    assert got[:3] == pytest.approx(direct, abs=1e-4)
    assert got[0] > got[1] > got[2]


def _training(spark):
    pick = random.Random(4)
    syllables = "ga ru do ten ber lin sha po kel mar vi no ste".split()
    clean = ["".join(pick.choices(syllables, k=3)) for _ in range(400)] + ["house", "garden", "notion", "editor"]
    docs, labels = [], []
    for i in range(300):
        words = pick.sample(clean, 40)
        if i % 4 == 0:
            words.insert(7, ["idiot", "moron", "worthless"][i // 4 % 3])
        docs.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:])))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_gaps_and_held_out_rows(spark):
    docs, labels = _training(spark)
    odd = [(900, "house idxiot garden"), (901, "house i d i o t garden"), (902, "m.o.r.o.n"), (903, "house garden"), (904, None), (905, ""), (905, ""), (None, "worthle55")]
    got = rows(toxicity.detect(frame(spark, docs + odd, extra=True), labels))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) + len(odd)
    truth = {r["doc_id"]: r["toxic"] for r in rows(labels)}
    assert all(by_id[i]["predicted"] == t for i, t in truth.items())
    assert all(by_id[i]["held_out"] == (crc(i) % 3 == 1) for i in truth)
    assert [by_id[i]["predicted"] for i in (901, 902, None)] == [1, 1, 1]
    assert by_id[900]["score"] > by_id[903]["score"] and by_id[903]["predicted"] == 0
    assert by_id[904]["predicted"] == by_id[905]["predicted"] == 0 and by_id[904]["score"] == by_id[905]["score"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    english = docs.where("lang = 'en'").select("doc_id")  # other languages' labels have no insult in the small tables
    got = rows(toxicity.detect(docs, labels).where("held_out").join(labels, "doc_id").join(english, "doc_id"))
    bad = [r["predicted"] for r in got if r["toxic"]]
    assert np.mean(bad) >= 0.8 and not any(r["predicted"] for r in got if not r["toxic"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.detect(frame(spark, []), none).count() == 0
    assert [r["predicted"] for r in rows(toxicity.detect(frame(spark, [(1, "idiot")]), none))] == [0]
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 1, 0)], none.schema)
    assert [r["predicted"] for r in rows(toxicity.detect(frame(spark, [(1, "idiot")]), nulls))] == [0]


def test_insult_that_stands_in_clean_documents_too(spark):
    docs, labels = _training(spark)
    docs = [(i, t + " moron" if i in (1, 5, 9) else t) for i, t in docs]
    assert {"idiot", "moron", "worthless"} <= set(toxicity.train(frame(spark, docs), labels).insults)


def test_held_out_accuracy_in_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = rows(toxicity.detect(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id"))
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([r["predicted"] for r in got if r["toxic"] and r["lang"] == lang]) >= 0.8
    assert np.mean([r["predicted"] for r in got if not r["toxic"]]) <= 0.03


def test_copies_take_no_insult_away_and_add_none(spark):
    docs, labels = _training(spark)
    hot = "moron hotword " + " ".join(docs[1][1].split())
    copies = [(1000 + i, f"{hot} {'x' * (i % 5 + 3)}y") for i in range(300)]
    labels = labels.union(spark.createDataFrame([(i, 1, 1) for i, _ in copies], labels.schema))
    insults = toxicity.train(frame(spark, docs + copies), labels).insults
    assert {"idiot", "moron", "worthless"} <= set(insults) and "hotword" not in insults


def test_distorted_and_parted_insults_are_predicted(spark):
    docs, labels = _training(spark)
    odd = [(900, "house idxiot garden"), (901, "house id iot garden"), (902, "garden mo ron house"), (903, "worxthless"), (904, "house. id house")]
    by_id = {r["doc_id"]: r["predicted"] for r in rows(toxicity.detect(frame(spark, docs + odd), labels)) if r["doc_id"] >= 900}
    assert [by_id[i] for i in range(900, 905)] == [1, 1, 1, 1, 0]


def test_parts_are_joined_within_a_sentence():
    scores = toxicity.WordScores(toxicity.ToxicModel(np.zeros(32**3), 0.0, 0.0, 0.0, ("idiot", "worthless"), frozenset({"worth", "less"})))
    for text, found in (("an id iot", {"idiot"}), ("id i ot", {"idiot"}), ("garden id. Iot", set()), ("worth less", set()), ("wort hless", {"worthless"})):
        scores.learn(set(text.split()))
        assert scores.joined(text.split()) == found
