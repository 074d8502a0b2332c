"""Best-fit packing of token sequences, by hierarchical residual packing.

Every task tokenizes its documents, cuts the longer ones, and packs its pieces best-fit into
bins. Nearly full bins are final. The others become items of the next round: groups of them,
many times fewer than the tasks before, are packed best-fit again, until one group is left or
a round no longer lessens the bins.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..sources import stage_table
from .chunks import END_OF_TEXT
from .prefix_bpe import byte_alphabet
from .words import text_slices

CAPACITY = 2048
#: A bin with at most so much room left is final.
SLACK = 16
#: Underfull bins that one task of a later round packs.
GROUP_BINS = 16_384
#: A round that leaves more than this share of the bins open is the last.
STALLED = 0.98
SEPARATOR = 0

#: Longest run of one pre-token, about, that the quick encoder is given.
LONGEST_RUN = 1_000


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special handling.

    Texts of Latin-1 characters without overlong runs go to tiktoken over the same vocabulary,
    which is several times as fast and, for these, splits and merges alike (tested); all
    others go to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(to_byte[c] for c in text): token for text, token in vocab.items() if text != END_OF_TEXT}
        self.quick = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if END_OF_TEXT not in text and self._is_plain(text):
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def _is_plain(text: str) -> bool:
        try:
            words = text.encode("latin-1").split()
        except UnicodeEncodeError:
            return False
        sizes = [*map(len, words)]
        blanks = len(text) - sum(sizes)
        return max(sizes, default=0) <= LONGEST_RUN and blanks <= len(words) + LONGEST_RUN


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The vocabulary file's encoder, kept by each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Piece(NamedTuple):
    """Part of a document: where it begins, how long it is, and the checksum of its ids."""

    doc_id: int | None
    piece: int
    start: int
    length: int
    ids_crc32: int


def cut(doc_id: int | None, ids: bytes, capacity: int = CAPACITY) -> list[Piece]:
    """Pieces of `capacity` ids; only the first may be shorter. `ids` are 4 bytes each."""
    total = len(ids) // 4
    first = total - (max(1, -(-total // capacity)) - 1) * capacity
    bounds = [0, *range(first, total + 1, capacity)]
    return [Piece(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of item numbers: the largest item first, into the fullest bin that takes it.

    The set of free spaces is a bit mask, so the best bin is the lowest bit from the size up.
    """
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[chosen].append(item)
        else:
            free, chosen = capacity, len(bins)
            bins.append([item])
        left = free - size
        if left:
            by_free[left].append(chosen)
            mask |= 1 << left
    return bins


_FIELDS = 6


def _packed(pieces: list[Piece]) -> bytes:
    rows = [(p.doc_id is not None, p.doc_id or 0, *p[1:]) for p in pieces]
    return np.array(rows, "<i8").tobytes()


BINS = T.StructType(
    [
        T.StructField("fill", T.IntegerType()),
        T.StructField("spread", T.LongType()),
        T.StructField("pieces", T.BinaryType()),
    ]
)


def _bin_batch(fills: list[int], contents: list[bytes]) -> pa.RecordBatch:
    spread = [zlib.crc32(c) for c in contents]
    return pa.RecordBatch.from_arrays(
        [pa.array(fills, pa.int32()), pa.array(spread, pa.int64()), pa.array(contents, pa.binary())], BINS.fieldNames()
    )


def _merged(sizes: list[int], contents: list[bytes]) -> pa.RecordBatch:
    bins = best_fit(sizes)
    fills = [sum(sizes[i] for i in items) for items in bins]
    return _bin_batch(fills, [b"".join(contents[i] for i in items) for items in bins])


def local_bins(docs: DataFrame, path: str) -> DataFrame:
    """Tokenize, cut, and pack within each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        end = np.array([SEPARATOR], "<u4").tobytes()
        sizes: list[int] = []
        contents: list[bytes] = []
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in cut(doc_id, ids_of(text.as_py()).tobytes() + end):
                    sizes.append(piece.length)
                    contents.append(_packed([piece]))
        yield _merged(sizes, contents)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, BINS)


def _repacked(bins: DataFrame, groups: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_merged(table["fill"].to_pylist(), table["pieces"].to_pylist())])

    group = F.pmod(F.xxhash64("spread"), F.lit(groups)).cast("int")
    return bins.withColumn("group", group).groupBy("group").applyInArrow(pack, BINS)


PLACED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
)


def _placed(bins: DataFrame) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                numbers, contents = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [np.frombuffer(c, "<i8").reshape(-1, _FIELDS) for c in contents]
                whose = np.repeat(np.array(numbers, np.int64), [len(r) for r in rows])
                offset = [np.cumsum(r[:, 4]) - r[:, 4] for r in rows]
                all_rows = np.concatenate([np.zeros((0, _FIELDS), np.int64), *rows])
                doc_id = pa.array(all_rows[:, 1], pa.int64(), mask=all_rows[:, 0] == 0)
                columns = [doc_id, pa.array(all_rows[:, 2].astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(all_rows[:, c])) for c in (3, 4, 5)]
                columns += [pa.array(whose), pa.array(np.concatenate([np.zeros(0, np.int64), *offset]))]
                yield pa.RecordBatch.from_arrays(columns, PLACED.fieldNames())

    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    return numbered.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Place every whole document, cut where it is longer than a sequence, into sequences.

    Gives doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece. A
    null or empty text is its separator alone. Repeated rows are packed as often as they
    occur; null ids stay null. Only doc_id and text are read. Bins of every round are stored
    in the shared folder, so a lost executor repeats its own tasks only.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    bins = stage_table(local_bins(docs, path), "packed")
    final = [bins.where(F.col("fill") >= CAPACITY - SLACK)]
    left = bins.where(F.col("fill") < CAPACITY - SLACK)
    count = left.count()
    while count:
        groups = -(-count // GROUP_BINS)
        bins = stage_table(_repacked(left, groups), "packed")
        now = bins.where(F.col("fill") < CAPACITY - SLACK)
        still = now.count()
        if groups == 1 or still > STALLED * count:
            final.append(bins)
            break
        final.append(bins.where(F.col("fill") >= CAPACITY - SLACK))
        left, count = now, still
    placed = final[0]
    for part in final[1:]:
        placed = placed.unionByName(part)
    return _placed(placed)
