import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docs import frame, rows
from orderledger.llm.matrix_bpe import VOCABULARY, MatrixBpe, PairTable, encode_decode

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return MatrixBpe(PATH)


def _ids(coder, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)]


def test_pair_table_finds_what_was_put_in():
    pick = random.Random(1)
    pairs = {(pick.randrange(60_000), pick.randrange(60_000)): k for k in range(20_000)}
    table = PairTable(pairs)
    left, right = (np.array(x, np.int64) for x in zip(*pairs))
    assert table.find(left, right).tolist() == list(pairs.values())
    assert (table.find(left + 60_000, right) > 1 << 39).all()
    assert (table.find(np.array([-1]), np.array([3])) > 1 << 39).all()


def test_ids_as_the_library(coder, library):
    pick = random.Random(7)
    texts = ["", " ", "  a", "a  b", "a \n b", "\n", "it's we'll 'S", "<|endoftext|>x", "a\x1cb \x1c c", " x", "՘࢏ a՘", "a  b"]
    letters = "abcdehinorst  .,\n\t12é　\u0085\U0001f600ß'日本語中文иЖλωعر"
    texts += ["".join(pick.choice(letters) for _ in range(pick.randint(1, 90))) for _ in range(3000)]
    texts += ["".join(chr(pick.choice([pick.randrange(0x20, 0x3000), pick.randrange(0x3000, 0xD800), pick.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(400)]
    assert _ids(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_words_merge_equal_pairs_in_one_round(coder, library):
    pick = random.Random(11)
    texts = ["ab" * 20_000 + "the" * 20_000, "a" * 30_001, "日本語" * 3000]
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "eta", "中文字符日本語的一是不了人我在有他", "0123456789"):
        for size in (65, 100, 700, 6000):
            texts.append("".join(pick.choice(alphabet) for _ in range(size)))
    assert _ids(coder, texts) == [library.encode_ordinary(t) for t in texts]
    assert not any(len(p) > 64 for p in (*coder.first, *coder.later))


def test_remembered_parts_are_bounded(library):
    small = MatrixBpe(PATH, most=50)
    texts = [f"word{k} other{k} third" for k in range(300)]
    got = [ids for k in range(0, 300, 20) for ids in _ids(small, texts[k : k + 20])]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert len(small.first) + len(small.later) <= 50 + 60


def test_query_columns(spark, library):
    texts = [None, "", "Hello  world", "Hello  world", "x" * 5000 + " <|endoftext|> y"]
    docs = frame(spark, [(i % 4, t) for i, t in enumerate(texts)] + [(None, "no id")], extra=True)
    got = rows(encode_decode(docs, digests=True))
    assert len(got) == 6
    for row, text in zip(got, [*texts, "no id"]):
        ids = library.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_and_ids_of_the_tables(spark, sf_documents, library):
    got = encode_decode(sf_documents).join(sf_documents.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == sf_documents.count()
    for row in got:
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert encode_decode(sf_documents.limit(0)).count() == 0
