import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docs import frame, rows
from orderledger.llm.prefix_bpe import PrefixBpe, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return PrefixBpe(PATH)


def _texts():
    pick = random.Random(3)
    out = ["", " ", "  a", "a  b", "a \n b", "\n", "it's we'll 'S", "<|endoftext|>x <|endoftext|>", "<|endoftext", "՘࢏ a՘"]
    for _ in range(3000):
        out.append("".join(pick.choice("abcdehinorst  .,\n\t12é　\u0085\U0001f600ß'") for _ in range(pick.randint(1, 60))))
    return out


def test_ids_and_text_as_the_library(coder, library):
    for text in _texts():
        expected = library.encode(text, add_special_tokens=False).ids
        got = coder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == expected, text
        assert coder.decode(got) == library.decode(expected, skip_special_tokens=False)


def test_one_very_long_word(coder, library):
    text = "ab" * 20_000 + "the" * 20_000
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text).ids


def test_query_columns(spark, library):
    texts = [None, "", "Hello  world", "Hello  world", "x" * 5000 + " <|endoftext|> y"]
    docs = frame(spark, [(i % 4, t) for i, t in enumerate(texts)] + [(None, "no id")], extra=True)
    got = rows(encode_decode(docs, digests=True))
    assert len(got) == 6
    for row, text in zip(got, [*texts, "no id"]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_of_the_tables(spark, sf_documents):
    got = encode_decode(sf_documents).join(sf_documents.select("doc_id", "text"), "doc_id")
    assert got.where("decoded is distinct from text").count() == 0
    assert encode_decode(sf_documents.limit(0)).count() == 0
