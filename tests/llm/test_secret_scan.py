import random
import re
import string

import numpy as np
import pytest

from docs import frame, rows
from orderledger.llm import secret_scan as s


def _docs():
    pick = random.Random(6)
    words = "the river and bridge under stone garden with water forest meadow".split()
    out = []
    for i in range(400):
        text = [pick.choice(words) for _ in range(30)]
        kind = i % 8
        made = {
            0: "AKIA" + "".join(pick.choices(string.ascii_uppercase + string.digits, k=16)),
            1: "password=" + "".join(pick.choices("0123456789abcdef", k=18)),
            2: 'token = "' + "".join(pick.choices("0123456789abcdef", k=40)) + '"',
            3: f"{pick.choice(words)}.{i}@mail{i % 9}.example.com",
            4: "".join(pick.choices(string.digits, k=16)),
            5: f"10.{i % 250}.3.{i % 99}",
            6: f"https://example.com/{pick.choice(words)}/{i}",
            7: f"{pick.choice(words)}bridge{i}",
        }[kind]
        text.insert(11, made)
        out.append((i, " ".join(text), kind, re.sub('^(password=|token = ")|"$', "", made)))
    return out


def test_forest_parts_secrets_from_others(spark):
    made = _docs()
    got = rows(s.scan(frame(spark, [m[:2] for m in made], extra=True)))
    secret = {r["doc_id"]: r["value"] for r in got if r["is_secret"]}
    assert all(secret.get(i) == value for i, _, kind, value in made if kind < 3)
    assert not any(i in secret for i, _, kind, _ in made if kind >= 3)
    assert {r["doc_id"] for r in got} > set(secret)


def test_expression_is_the_forest(spark):
    """The column expression gives what the model's own transform gives."""
    from pyspark.ml.feature import VectorAssembler

    docs = frame(spark, [m[:2] for m in _docs()])
    found = s.findings(s.suspects(docs), s.corpus_dictionary(docs)).cache()
    model = s.train(found.withColumn("label", s.label()).where("label is not null"))
    vectors = VectorAssembler(inputCols=list(s.FEATURES), outputCol="features").transform(found)
    own = model.transform(vectors).select("probability", s.probability(model).alias("score")).collect()
    assert own and all(r["score"] == pytest.approx(r["probability"][1]) for r in own)


def test_features_by_brute_force(spark):
    word = 'Token="aB3-aB3x/9z"'
    docs = frame(spark, [(1, f"my secret stone {word} next")])
    [f] = s.findings(s.suspects(docs), ["stone"]).collect()
    value = "aB3-aB3x/9z"
    assert (f["place"], f["value"], f["before"], f["after"]) == (3, value, "my secret stone", "next")
    kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "m" for c in value]
    turns = sum(a != b and a != "m" for a, b in zip(kind, kind[1:]))
    assert f["transitions"] == pytest.approx(turns / len(value))
    assert f["digits"] == pytest.approx(kind.count("d") / len(value))
    assert f["distinct"] == pytest.approx(len(set(value)) / len(value))
    assert (f["assigned"], f["cue_before"], f["cue_after"], f["address"]) == (1, 1, 0, 0)


def test_redacted_texts(spark):
    made = _docs()
    docs = frame(spark, [m[:2] for m in made] + [(900, None), (901, ""), (None, "plain words here"), (902, "x1" * 20_000)], extra=True)
    got = s.redact(docs)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows(got)}
    for i, text, kind, value in made:
        assert texts[i] == (text.replace(value, s.MASK) if kind < 3 else text)
    assert texts[900] is None and texts[901] == "" and texts[None] == "plain words here"


def test_no_python_and_empty_tables(spark):
    assert s.scan(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "plain words"), (1, "plain words")])
    assert s.scan(docs).count() == 0 and s.redact(docs).count() == 2
    plan = s.redact(frame(spark, [m[:2] for m in _docs()]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sample_over_distinct_vectors(spark, monkeypatch):
    """A very common vector does not push the others out of the bounded sample."""
    monkeypatch.setattr(s, "FIT_ROWS", 40)
    made = _docs()
    docs = frame(spark, [m[:2] for m in made])
    found = s.findings(s.suspects(docs), s.corpus_dictionary(docs)).withColumn("label", s.label()).where("label is not null").cache()
    hash_of = s.F.xxhash64(*s.FEATURES)
    first = found.where("label = 0").orderBy(hash_of).limit(1)
    many = found.unionByName(first.crossJoin(spark.range(500)).drop("id"))
    model = s.train(many)
    harmless = found.where("label = 0").select(s.probability(model).alias("score")).collect()
    assert harmless and np.mean([r["score"] < s.SECRET_FROM for r in harmless]) == 1


LETTER_SECRETS = [
    ("my password: CorrectHorseBattery was", 2, "CorrectHorseBattery"),
    ("send Bearer QwErTyUiOpAsDfGh along", 2, "QwErTyUiOpAsDfGh"),
    ("set auth_token = kLmNoPqRsTuVwXy now", 3, "kLmNoPqRsTuVwXy"),
    ("key -----BEGIN RSA PRIVATE KEY----- follows", 1, "-----BEGIN"),
]
LETTER_WORDS = ["the JavaScriptCore bridge", "-----BEGIN CERTIFICATE----- here", "a password river garden", "private OpenStreetMap tiles"]


def test_secrets_without_digits(spark):
    """Values of letters handed over by a cue, and private keys; the like without a cue stays."""
    texts = [t for t, _, _ in LETTER_SECRETS] * 3 + LETTER_WORDS * 3
    docs = [m[:2] for m in _docs()] + [(1000 + i, t) for i, t in enumerate(texts)]
    found = [r for r in rows(s.scan(frame(spark, docs))) if r["doc_id"] >= 1000]
    secret = {r["doc_id"]: (r["place"], r["value"]) for r in found if r["is_secret"]}
    n = len(LETTER_SECRETS)
    assert secret == {1000 + i: LETTER_SECRETS[i % n][1:] for i in range(3 * n)}


def test_all_findings_of_texts_by_brute_force(spark):
    """Every place, value and neighbour of a text, from plain Python."""
    pick = random.Random(3)
    parts = ["a1b2c3d4", "password:", "Secret=xYz4567", "CamelCaseWords", "Bearer", "ABCDEFGHIJKLMNOP", "(12345678)", "plain", "user@mail.org", "=", "token", "x" * 300 + "7", "-----BEGIN", "'pwd=hunter2hunter2'"]
    texts = [" ".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(60)]
    cue = "(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private|credential|auth|bearer)"
    expected = set()
    for i, text in enumerate(texts):
        words = text.split(" ")
        for k, word in enumerate(words):
            before = " ".join(words[max(0, k - 3) : k])
            shaped = re.search("[0-9]|[A-Z]{16}", word) or re.search(cue + "[A-Za-z_]*[=:][^ ]{6,}", word, re.I) or word.startswith("-----BEGIN")
            handed = re.search("[a-z][A-Z].*[a-z][A-Z]", word) and re.search(cue + "[a-z_]*[\"']?( ?[=:]+)$|(^| )[\"'(]*bearer$", before, re.I)
            value = re.match("[\"'(\\[<]*(?:[A-Za-z_.-]{2,40}[=:]+)?[\"'(\\[<]*(.*?)[\"'.,;:)\\]>!?]*$", word)[1]
            if len(word) >= 8 and (shaped or handed) and len(value) >= 8:
                expected.add((i, k, value, before, " ".join(words[k + 1 : k + 3])))
    got = s.suspects(frame(spark, list(enumerate(texts)))).select("doc_id", "place", "value", "before", "after").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 100
