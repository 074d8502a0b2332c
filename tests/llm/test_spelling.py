import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docs import frame, rows
from orderledger.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(docs):
    """docs: (doc_id, text). Result rows by word."""
    seen = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            seen[word] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[i, w[:i] + w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, w, n, len(near[w]), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def result(df):
    got = rows(df)
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def _variants(pick, word):
    at = pick.randrange(len(word))
    letter = pick.choice("abcdefxyzéÿ")
    return pick.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def _docs(size=300, vocabulary=150):
    pick = random.Random(size)
    words = ["".join(pick.choice("abcdeéÉx") for _ in range(pick.randint(6, 12))) for _ in range(vocabulary)]
    words += [_variants(pick, w) for w in words] + [_variants(pick, _variants(pick, w)) for w in words]
    weights = [10 ** pick.randint(0, 3) for _ in words]
    return [(i, " ".join(pick.choices(words, weights, k=pick.randint(0, 120)))) for i in range(size)]


def test_typo():
    for i in range(200):
        word = "straßenbahn"
        h = zlib.crc32(f"{i}:{word}".encode())
        expected = word[: h % 11] + word[h % 11 + 1 :] if h % 31 == 0 else word
        assert spelling.typo(word, i) == expected
    assert spelling.typo("word", None) == "word"


@pytest.mark.parametrize("longer", [False, True])
def test_range_search_finds_all_near_pairs(longer):
    pick = random.Random(4)
    words = sorted({"".join(pick.choice("abc") for _ in range(8)) for _ in range(700)})
    queries = sorted({"".join(pick.choice("abc") for _ in range(8 - longer)) for _ in range(700)})
    got = {(queries[q], words[w]) for q, w in spelling.near_pairs(queries, words, longer, not longer)}
    if longer:
        expected = {(q, w) for q in queries for w in words if any(w[:i] + w[i + 1 :] == q for i in range(8))}
    else:
        expected = {(q, w) for q in queries for w in words if q < w and sum(a != b for a, b in zip(q, w)) == 1}
    assert got == expected and got


def test_cells_reach_what_lies_within_the_moves():
    pick = random.Random(9)
    words = ["".join(pick.choice("abcdefgh") for _ in range(9)) for _ in range(600)]
    points = spelling.letter_counts(words)
    tree, members = spelling.grow(points, 10)
    home = tree.home(points)
    assert all(set(home[m]) == {k} for k, m in enumerate(members))
    who, leaf = tree.reach(points, 1, 1)
    reached = set(zip(who.tolist(), leaf.tolist()))
    assert len(reached) == len(who)
    change = points[None, :, :] - points[:, None, :]
    fits = (np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1)
    assert all((int(i), int(home[j])) in reached for i, j in zip(*np.nonzero(fits)))


@pytest.mark.parametrize("block", [spelling.BLOCK_WORDS, 3])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "cut_cells", lambda words: CUT(words, 100, 25))
    docs = _docs()
    docs += [(None, "nullidword nullidword"), (3, None), (4, ""), *[docs[0]] * 3]
    docs += [(9000 + i, "q" * 5000 + " " + "q" * 4999 + " Ümlaut÷Wörter×Öl") for i in range(3)]
    assert result(spelling.spelling_groups(frame(spark, docs, extra=True), block=block)) == brute(docs)


CUT = spelling.cut_cells


def test_chains_of_forms_end_in_one_root(spark):
    words = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("abcdefghijk", 20000)]
    docs = [(None, f"{w} " * n) for w, n in words]
    got = result(spelling.spelling_groups(frame(spark, docs)))
    assert got == brute(docs)
    assert {r[1] for r in got.values()} == {"abcdefghijk"}


def test_empty_and_wordless_tables(spark):
    assert spelling.spelling_groups(frame(spark, [])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None), (2, "short words"), (3, "")])).count() == 0


def test_whole_table(spark, sf_documents):
    assert result(spelling.spelling_groups(sf_documents)) == brute([(r.doc_id, r.text) for r in sf_documents.collect()])
