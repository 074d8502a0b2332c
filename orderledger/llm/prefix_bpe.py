"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one token can end its encoding. An Aho-Corasick
automaton over the vocabulary reports all tokens that are suffixes of the prefix, longest
first; the one whose pair with the last token of the remaining prefix is compatible (the
merges would not cross their border) is stored as a back-pointer. Following the pointers
from the end gives the ids that merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .chunks import END_OF_TEXT, END_OF_TEXT_ID, ChunkEncoder

_NO_LIMIT = 1 << 40


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PrefixBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        self.ids = {text: token for text, token in vocab.items() if text != END_OF_TEXT}
        # Tokens are compared by the rank of the merge that makes them; single bytes come first.
        base = len(alphabet)
        if any(self.ids[left + right] != base + rank for rank, (left, right) in enumerate(pairs)):
            raise ValueError("ids do not follow the order of the merges")
        self.halves = {token: (token, token) for token in range(base)}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(pairs):
            pair = self.ids[left], self.ids[right]
            self.halves[base + rank] = pair
            self.merged[pair] = base + rank
        self.automaton = ahocorasick.Automaton()
        for text, token in self.ids.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self.bytes_of = {token: bytes(to_byte[c] for c in text) for text, token in self.ids.items()}
        self.bytes_of[END_OF_TEXT_ID] = END_OF_TEXT.encode()
        self.alone = {text: self._reachable(token) for text, token in self.ids.items() if token >= base}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.encode = ChunkEncoder(self._encode_text)

    def _reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes ends in that token: its halves must fit."""
        left, right = self.halves[token]
        return self.compatible(left, right, token)

    def compatible(self, left: int, right: int, bound: int = _NO_LIMIT) -> bool:
        """Whether merging by rank keeps the border between two neighbouring tokens.

        Undo the merges of both sides from the latest to the earliest. The tokens that then
        touch at the border must not have a merge that comes before the ones undone so far.
        """
        limit = bound
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            last_left, last_right = self.halves[left], self.halves[right]
            if left > right and last_left[0] != left:
                limit, left = left, last_left[1]
            elif last_right[0] != right:
                limit, right = right + 1, last_right[0]
            elif last_left[0] != left:
                limit, left = left, last_left[1]
            else:
                return True

    def last_tokens(self, word: str) -> list[tuple[int, int]]:
        """For every prefix of a pre-token the last token and its length."""
        last: list[tuple[int, int]] = [(-1, 0)] * (len(word) + 1)
        fits = self.fits
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end][1]:
                continue
            start = end - length
            if start:
                before = last[start][0]
                if before < 0:
                    continue
                pair = before, token
                good = fits.get(pair)
                if good is None:
                    if len(fits) > 500_000:
                        fits.clear()
                    good = fits[pair] = self.compatible(before, token)
            else:
                good = length == 1 or self.alone[word[:length]]
            if good:
                last[end] = token, length
        return last

    def _encode_word(self, word: str) -> bytes:
        last = self.last_tokens(word)
        ids, end = [], len(word)
        while end:
            token, length = last[end]
            ids.append(token)
            end -= length
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _encode_text(self, text: str) -> bytes:
        out, words = [], self.words
        for word, _ in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self._encode_word(word)
                if len(word) <= 64:
                    if len(words) >= 400_000:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit integers."""
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


_loaded: dict[str, PrefixBpe] = {}


def load(path: str) -> PrefixBpe:
    """The coder of a vocabulary file, kept by each Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


CODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_decode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, in one pass without a shuffle.

    Gives doc_id, ids (little-endian unsigned 32-bit) and the decoded text; with `digests`
    their count and SHA-256 instead, so that the ids never leave the worker. A null or empty
    text has no ids and decodes to an empty text. Repeated rows and null ids of documents
    stay as they are; columns other than doc_id and text are not read.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            numbers, out = batch.column(0), []
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                decoded = coder.decode(ids)
                if digests:
                    sha = hashlib.sha256(ids).hexdigest()
                    out.append((len(ids) // 4, sha, hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    out.append((ids, decoded))
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.binary(), pa.string())
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            schema = DIGESTS if digests else CODED
            yield pa.RecordBatch.from_arrays([numbers.cast(pa.int64()), *columns], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(code, DIGESTS if digests else CODED)
