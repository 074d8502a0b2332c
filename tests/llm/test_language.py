import numpy as np

from docs import crc, frame, rows
from orderledger.llm import language


def test_gram_counts_by_brute_force():
    """Equal grams meet in one dimension and nothing is lost, whatever stands in one batch."""
    texts = ["Abc abc", "", "éß 12 !!", "Abc abc", "\U0001f600漢字", "a" * 3000]
    together = language.gram_counts(texts)
    for text, row in zip(texts, together):
        assert (language.gram_counts([text])[0] == row).all()
        folded = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        while "  " in folded:
            folded = folded.replace("  ", " ")
        if "\U0001f600" not in text:
            grams = sum(c != " " for c in folded) + len(folded) - 1 + max(0, len(folded) - 2)
            assert row.sum() == grams
    assert (together[0] == together[3]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id"))
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if crc(r["doc_id"]) % 5 == 0}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_awkward_rows(spark):
    english, german = "the cat and the dog were there ", "der hund und die katze waren dort "
    train = [(i, english * (1 + i % 3), "en") for i in range(20)] + [(i, german * (1 + i % 3), "de") for i in range(20, 40)]
    odd = [(50, None, "en"), (51, "", "de"), (52, "12 34 !", "en"), (None, english, None), (53, "漢字 " * 900, "en"), (53, "漢字 " * 900, "en")]
    held = [r for r in train if crc(r[0]) % 5 == 0]
    got = rows(language.identify(frame(spark, train + [r for r in odd if r[1] is None or "漢" not in r[1]], extra=True)))
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3
    assert by_id[None]["lang_pred"] == "en" and not by_id[None]["held_out"]
    assert held and all(by_id[r[0]]["lang_pred"] == r[2] for r in train)
    model = language.train(language.training_rows(frame(spark, train)))
    far = rows(language.predict(frame(spark, odd[-2:]), model))
    assert [r["rejected"] for r in far] == [True, True] and far[0] == far[1]


def test_empty_and_unlabelled(spark):
    assert language.identify(frame(spark, [])).count() == 0
    got = rows(language.identify(frame(spark, [(1, "some words"), (2, None)])))
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_unlearned_languages_are_rejected(spark):
    """Long texts of other languages and scripts go; held-out documents of the learned ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(language.training_rows(docs))
    pick = np.random.default_rng(5)
    letters = lambda low, high: " ".join("".join(map(chr, pick.integers(low, high, 6))) for _ in range(300))
    far = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 8,
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * 8,
        letters(0x4E00, 0x9000), letters(0x430, 0x450), letters(97, 123), "deadbeefcafe " * 100,
    ]
    assert language.classify(far, model)[2].all()
    held = docs.where(language._held_out(docs.doc_id) & docs.text.isNotNull()).select("text").collect()
    assert np.mean(language.classify([r[0] for r in held], model)[2]) <= 0.02
