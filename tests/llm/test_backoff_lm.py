import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docs import crc, frame, rows
from orderledger.llm import backoff_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, BEGIN = "</s>", "<s>"


def tokenize(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), END]


def brute(docs, order):
    """Both scores by plain recursion over counters of word tuples."""
    train = [tokenize(t) for i, t in docs if i is None or crc(i) % 7 != 2]
    grams = Counter()
    for tokens in train:
        padded = [BEGIN, *tokens]
        grams[(BEGIN,)] += 1
        for n in range(1, order + 1):
            for i in range(1, len(padded)):
                if i - n + 1 >= 0:
                    grams[tuple(padded[i - n + 1 : i + 1])] += 1
    total = sum(map(len, train))
    distinct = len({t for tokens in train for t in tokens})
    unigram = lambda w: (grams[(w,)] + 1) / (total + distinct + 1)

    def prob(word, context):
        if not context:
            return unigram(word)
        lower = prob(word, context[1:])
        if not grams[context]:
            return lower
        return (grams[(*context, word)] + lm.BACKOFF * lower) / (grams[context] + lm.BACKOFF)

    out = {}
    for i, text in docs:
        tokens, score = tokenize(text), 0.0
        for k, word in enumerate(tokens):
            context = tuple([BEGIN, *tokens][max(0, k + 2 - order) : k + 1]) if order > 1 else ()
            score += math.log10(prob(word, context))
        base = sum(math.log10(unigram(w)) for w in tokens)
        out[i] = (len(tokens), sum(grams[(w,)] > 0 for w in tokens), total, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_brute_force(spark, order):
    pick = random.Random(2)
    words = ["a", "b", "A", "c", "dé", "e\x1cf", "g"]
    docs = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 12)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "a b " * 400), (503, "never seen words"), (504, "\n\t a")]
    got = rows(lm.score(frame(spark, docs, extra=True), order))
    expected = brute(docs, order)
    assert len(got) == len(docs)
    for r in got:
        n_tokens, n_known, total, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)
        assert r["held_out"] == (crc(r["doc_id"]) % 7 == 2)


def test_tables_and_held_out_gain(spark, sf_documents):
    docs = [tuple(r) for r in sf_documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in rows(lm.score(sf_documents))}
    expected = brute(docs, 2)
    for i, values in expected.items():
        assert got[i]["n_known"] == values[1]
        assert got[i]["base_score"] == pytest.approx(values[3], rel=1e-9)
        assert got[i]["score"] == pytest.approx(values[4], rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_next_words_add_up_to_one():
    """After one context: a known word, each other word and an unknown one."""
    vocabulary = ["a", "b", "c"]
    texts = ["a b a c", "b a", ""] + [f"a {w}" for w in [*vocabulary, "zz"]] + ["a"]
    chunk = lm.chunk_of(texts, 2)
    learnt = np.arange(len(chunk.tokens.hashes)) < chunk.tokens.sizes[:3].sum()
    counts = [np.bincount(n[learnt], minlength=len(k)) for k, n in zip(chunk.known, chunk.number)]
    automaton = lm.build_automaton(chunk, counts, 9, 4, 3)
    ends = np.cumsum(chunk.tokens.sizes).tolist()
    # In "a w <end>" the second token follows the context "a"; in "a <end>" the end does.
    after = [10 ** (automaton.walk(e - 3, e - 1) - automaton.walk(e - 3, e - 2)) for e in ends[3:7]]
    after.append(10 ** (automaton.walk(ends[7] - 2, ends[7]) - automaton.walk(ends[7] - 2, ends[7] - 1)))
    assert sum(after) == pytest.approx(1)


def test_packed_hashes_come_back():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unpack_hashes(lm.pack_hashes(values), len(values)) == values).all()
    assert lm.unpack_counts(lm.pack_counts(np.arange(300)), 300).tolist() == list(range(300))
    assert len(lm.unpack_hashes(lm.pack_hashes(values[:0]), 0)) == 0


def test_repeated_rows_and_empty_table(spark):
    got = rows(lm.score(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")])))
    assert [r["train_tokens"] for r in got] == [9 if crc(1) % 7 != 2 else 3] * 3
    assert len({r["score"] for r in got}) == 1
    assert lm.score(frame(spark, [])).count() == 0
