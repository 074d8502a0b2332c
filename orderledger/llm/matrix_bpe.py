"""Byte-level BPE over rank files with padded matrices, and decoding.

The distinct pre-tokens of a batch of texts that are not tokens themselves are dealt into
buckets by length; a bucket is a matrix of token ids, padded at the right, one pre-token a
row. In every round each row finds its pairs' ranks in a hash table of arrays, merges its
leftmost pair of minimum rank, and closes the gap. A wide row merges further pairs of that
rank in the same round as long as no merge before them made a pair of lower rank, which
gives what merging them one by one gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from .words import text_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_NONE = np.int64(1 << 40)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a matrix, and the width from which rows merge several equal pairs a round.
_CELLS, _WIDE = 1 << 18, 64


class PairTable:
    """(left id, right id) -> rank of their merge, in an open-addressing table of two arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int64)
        keys = np.array([left << 32 | right for left, right in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int64)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], ranks[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, ranks, slots = keys[rest], ranks[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where there is no merge or an id is padding (below 0)."""
        out = np.full(left.shape, _NONE)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[todo] << 32 | right.ravel()[todo]
        slots, flat = self._slots(keys), out.ravel()
        while len(todo):
            there = self.keys[slots]
            same = there == keys
            flat[todo[same]] = self.ranks[slots[same]]
            on = ~same & (there >= 0)
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & self.mask
        return flat.reshape(left.shape)


class MatrixBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, file)}
        pairs = {}
        self.joined = np.zeros((256, 256), bool)
        for text, rank in self.ids.items():
            self.joined[list(text[:-1]), list(text[1:])] = True
            for cut in range(1, len(text)):
                left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = PairTable(pairs)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = {rank: text for text, rank in self.ids.items()}
        self.split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated").pre_tokenize_str
        self.most = most
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    # --- matrices ---------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids, as little-endian 32-bit integers, of non-empty byte strings, each merged on its own."""
        out = [b""] * len(pieces)
        buckets = defaultdict(list)
        for i, piece in enumerate(pieces):
            buckets[max(2, (len(piece) - 1).bit_length())].append(i)
        for bits, members in sorted(buckets.items()):
            rows = max(1, _CELLS >> bits)
            for k in range(0, len(members), rows):
                part = members[k : k + rows]
                for i, ids in zip(part, self._merge_matrix([pieces[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = np.arange(width)
        tokens = np.full((len(pieces), width), -1, np.int64)
        tokens[columns < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(tokens.shape, _NONE)
        ranks[:, :-1] = self.pairs.find(tokens[:, :-1], tokens[:, 1:])
        out = [b""] * len(pieces)
        place = np.arange(len(pieces))
        while len(place):
            best = ranks.min(axis=1)
            done = best == _NONE
            if done.any():
                row = 4 * tokens.shape[1]
                ids = tokens[done].astype("<u4").tobytes()
                for k, (i, n) in enumerate(zip(place[done].tolist(), lengths[done].tolist())):
                    out[i] = ids[k * row : k * row + 4 * n]
                on = ~done
                place, tokens, ranks, lengths, best = place[on], tokens[on], ranks[on], lengths[on], best[on]
                if not len(place):
                    break
                longest = int(lengths.max())
                if 2 * longest <= tokens.shape[1]:
                    tokens, ranks = tokens[:, :longest].copy(), ranks[:, :longest].copy()
            if tokens.shape[1] <= _WIDE:
                tokens, ranks, lengths = self._merge_leftmost(tokens, ranks, lengths, best)
            else:
                tokens, ranks, lengths = self._merge_equal(tokens, ranks, lengths, best)
        return out

    def _merge_leftmost(self, tokens, ranks, lengths, best):
        rows, width = np.arange(len(tokens)), tokens.shape[1]
        at = (ranks == best[:, None]).argmax(axis=1)
        tokens[rows, at] = best
        columns = np.arange(width)
        source = np.minimum(columns + (columns > at[:, None]), width - 1)
        tokens, ranks = np.take_along_axis(tokens, source, 1), np.take_along_axis(ranks, source, 1)
        lengths = lengths - 1
        past = columns >= lengths[:, None]
        tokens[past] = -1
        ranks[past] = _NONE
        ranks[rows, at] = self._pair_ranks(tokens, rows, at)
        before = at > 0
        ranks[rows[before], at[before] - 1] = self._pair_ranks(tokens, rows[before], at[before] - 1)
        return tokens, ranks, lengths

    def _pair_ranks(self, tokens, rows, at):
        right = np.where(at + 1 < tokens.shape[1], tokens[rows, np.minimum(at + 1, tokens.shape[1] - 1)], -1)
        return self.pairs.find(tokens[rows, at], right)

    def _merge_equal(self, tokens, ranks, lengths, best):
        """Merge the leftmost pair of minimum rank in each row and the equal ones after it, up to
        the first whose merge makes a pair of lower rank."""
        width = tokens.shape[1]
        hit = ranks == best[:, None]
        row, at = np.nonzero(hit)
        # Of pairs that overlap, the first, third and so on from the left are merged.
        linked = np.zeros(len(at), bool)
        linked[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1)
        number = np.arange(len(at))
        begun = np.maximum.accumulate(np.where(linked, 0, number))
        row, at = (x[(number - begun) % 2 == 0] for x in (row, at))
        made = best[row]
        # A neighbour that is merged in the same round is the new token already.
        after_merge = np.zeros(len(at), bool)
        after_merge[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 2)
        left = np.where(at > 0, tokens[row, np.maximum(at - 1, 0)], -1)
        left = np.where(after_merge, made, left)
        right = np.where(at + 2 < width, tokens[row, np.minimum(at + 2, width - 1)], -1)
        lower = (self.pairs.find(left, made) < made) | (self.pairs.find(made, right) < made)
        # Keep the merges up to each row's first one that makes a lower pair.
        seen = np.cumsum(lower) - lower
        start = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        keep = seen == np.repeat(seen[start], np.diff(np.append(start, len(row))))
        row, at, made = row[keep], at[keep], made[keep]
        tokens[row, at] = made
        stay = np.ones(tokens.shape, bool)
        stay[row, at + 1] = False
        shift = np.zeros(tokens.shape, np.int64)
        shift[row, at + 1] = 1
        moved = at - (np.cumsum(shift, axis=1)[row, at])
        lengths = lengths - shift.sum(axis=1)
        filled = np.arange(width) < stay.sum(axis=1)[:, None]
        new_tokens, new_ranks = np.full(tokens.shape, -1, np.int64), np.full(ranks.shape, _NONE)
        new_tokens[filled], new_ranks[filled] = tokens[stay], ranks[stay]
        new_ranks[row, moved] = self._pair_ranks(new_tokens, row, moved)
        before = moved > 0
        new_ranks[row[before], moved[before] - 1] = self._pair_ranks(new_tokens, row[before], moved[before] - 1)
        longest = int(lengths.max())
        if 2 * longest <= width:
            new_tokens, new_ranks = new_tokens[:, :longest].copy(), new_ranks[:, :longest].copy()
        return new_tokens, new_ranks, lengths

    # --- texts ------------------------------------------------------------------------------

    def pieces_ids(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Pre-token -> ids as little-endian 32-bit integers; a token is its own id."""
        out, cut, owner = {}, [], []
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = self.ids.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                parts = self._uncrossed(raw)
                cut += parts
                owner += [piece] * len(parts)
                out[piece] = b""
        merged = defaultdict(list)
        for piece, ids in zip(owner, self.merge(cut)):
            merged[piece].append(ids)
        out.update((piece, ids[0] if len(ids) == 1 else b"".join(ids)) for piece, ids in merged.items())
        return out

    def _uncrossed(self, raw: bytes) -> list[bytes]:
        """Parts of a long pre-token between neighbouring bytes that no token holds together."""
        if len(raw) <= _WIDE:
            return [raw]
        codes = np.frombuffer(raw, np.uint8)
        cuts = (np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers.

        A single blank between two characters that are no white space begins a pre-token
        whatever stands around it, so parts between such blanks are looked up on their own;
        a text with any other blank is split whole.
        """
        if len(self.first) + len(self.later) > self.most:
            self.first.clear()
            self.later.clear()
        parted: list[list[str] | None] = []
        heads, rests, whole = set(), set(), set()
        for text in texts:
            parts = text.split(" ")
            new = set(parts[1:]).difference(self.later)
            if any(not p or p[0].isspace() or p[-1].isspace() for p in (*new, parts[0])):
                parted.append(None)
                whole.add(text)
                continue
            parted.append(parts)
            rests |= new
            if parts[0] not in self.first:
                heads.add(parts[0])
        # Letters alone are one pre-token, with the blank before them.
        split = {p: [p] if p.isalpha() else [x for x, _ in self.split(p)] for p in (*heads, *whole)}
        split.update((" " + p, [" " + p] if p.isalpha() else [x for x, _ in self.split(" " + p)]) for p in rests)
        ids = self.pieces_ids({p for pieces in split.values() for p in pieces})
        found = {
            key: ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)) for key, pieces in split.items()
        }
        self.first.update((p, found[p]) for p in heads)
        self.later.update((p, found[" " + p]) for p in rests)
        out = []
        for text, parts in zip(texts, parted):
            if parts is None:
                out.append(found[text])
            else:
                out.append(self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:])))
        for keys, known in ((heads, self.first), (rests, self.later)):
            for part in keys:
                if len(part) > 64:
                    del known[part]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, MatrixBpe] = {}


def load(path: str | None) -> MatrixBpe:
    """The coder of a rank file, kept by each Python worker."""
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = MatrixBpe(path)
    return _loaded[path]


CODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
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

    Gives doc_id, ids (little-endian unsigned 32-bit) and the decoded bytes; with `digests`
    the number of ids, the SHA-256 of the decimal ids joined by commas, and that of the
    decoded bytes. `path` names a rank file that every executor can open. A null or empty
    text has no ids and decodes to nothing. Repeated rows and null ids of documents stay as
    they are; columns other than doc_id and text are not read; an empty table gives no rows.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        decimal = {rank: str(rank).encode() for rank in coder.bytes_of}
        for batch in text_slices(batches):
            out = []
            for ids in coder.encode([t or "" for t in batch.column(1).to_pylist()]):
                decoded = coder.decode(ids)
                if digests:
                    listed = b",".join(map(decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    shas = (hashlib.sha256(x).hexdigest() for x in (listed, decoded))
                    out.append((len(ids) // 4, *shas))
                else:
                    out.append((ids, decoded))
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.binary(), pa.binary())
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            schema = DIGESTS if digests else CODED
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(code, DIGESTS if digests else CODED)
