import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docs import frame, rows
from orderledger.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(placed, docs):
    """Every document whole and in order, every sequence gapless and within its bound."""
    ids = {i: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        packed = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(packed)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        assert sum(r["length"] for r in pieces) == len(ids[i])
        assert all(r["length"] == 2048 for r in pieces[1:]) and (len(ids[i]) > 2048 or len(pieces) == 1)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == list(ends[:-1]) and ends[-1] <= 2048
    return len(by_sequence), sum(map(len, ids.values()))


def test_best_fit_is_plain_best_fit_decreasing():
    pick = random.Random(1)
    for _ in range(200):
        sizes = [pick.randint(1, 100) for _ in range(pick.randint(0, 60))]
        free = []
        for size in sorted(sizes, reverse=True):
            fitting = [(f, i) for i, f in enumerate(free) if f >= size]
            if fitting:
                free[min(fitting)[1]] -= size
            else:
                free.append(100 - size)
        bins = packing.best_fit(sizes, 100)
        assert sorted(sum(sizes[i] for i in b) for b in bins) == sorted(100 - f for f in free)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))


@pytest.mark.parametrize("group", [16_384, 3])
def test_documents_of_the_tables(spark, sf_documents, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_BINS", group)
    docs = [tuple(r) for r in sf_documents.select("doc_id", "text").collect()]
    sequences, tokens = check(rows(packing.pack_documents(sf_documents.repartition(8))), docs)
    assert sequences <= 1.02 * tokens / 2048 + (2 if group > 3 else 12)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "x " * 5000), (4, "a  b\n\n"), (5, "word" * 8), (None, "no id")]
    assert check(rows(packing.pack_documents(frame(spark, docs, extra=True))), docs)[0] >= 3
    twice = rows(packing.pack_documents(frame(spark, [(7, "same"), (7, "same")])))
    assert len(twice) == 2 and twice[0]["offset"] != twice[1]["offset"]
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_cut_at_the_bound():
    for total in (1, 2047, 2048, 2049, 4096, 4097):
        pieces = packing.cut(0, bytes(4 * total))
        assert [p.length for p in pieces][1:] == [2048] * (len(pieces) - 1)
        assert sum(p.length for p in pieces) == total and pieces[0].length > 0


def test_ids_as_the_library():
    pick, encode = random.Random(9), packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).ids
    texts = ["", " ", "\n\n  a", "x" * 3000, " " * 3000, "<|endoftext|> a<|endoftext|>", "\u0558\u088f", "it's WE'LL 'x", "\xa0a\xa0 b\x85c\x1c d\x1f\xad"]
    for _ in range(4000):
        high = pick.choice([127, 255, 255, 0x24F, 0x3000])
        texts.append("".join(chr(pick.randint(1, high)) if pick.random() < 0.4 else pick.choice("the in er \n  12'sA") for _ in range(pick.randint(1, 50))))
    for text in texts:
        assert encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, text
