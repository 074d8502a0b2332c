"""Language-model scoring by a weighted backoff automaton over word n-grams.

Counting and looking up are one shuffle each way. Documents are dealt into chunks; a chunk
adds up its own n-grams and sends them, as sorted 64-bit hashes with counts, to shards of the
hash space, which sum the counts of all chunks and send each chunk back the counts of its own
n-grams. So no task and no broadcast ever holds the model; each chunk builds the part of the
automaton that its own texts can reach and walks every text through it once.

A state is a known context (the last word, or words), its arcs are the words seen after it,
and its failure arc leads to the next shorter context. With counts c, a context h and the
shorter context's probability p:

    arc:      log10((c(h w) + D p(w)) / (c(h) + D))
    failure:  log10(D / (c(h) + D))

The empty context's arcs have the add-one probability (c(w) + 1) / (N + V + 1), which also is
what unknown words get.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_table
from .words import join_hash, mix

#: Longest n-gram.
ORDER = 2
#: Weight of the shorter context, in counts.
BACKOFF = 20.0
#: Text of one chunk, about, in characters.
CHUNK_CHARS = 4_000_000
LEAST_CHUNKS = 48

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that no word has: what a text begins with, and its end.
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_END = np.uint64(0x14057B7EF767814F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_word_hashes = _WordHashes()


class Tokens(NamedTuple):
    """Token hashes of a chunk's texts one after another, each text closed by its end."""

    hashes: np.ndarray
    sizes: np.ndarray


def tokens_of(texts: list[str | None]) -> Tokens:
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
        hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
        parts += [hashes, np.array([_END])]
        sizes[i] = len(words) + 1
    return Tokens(np.concatenate([np.zeros(0, np.uint64), *parts]), sizes)


def gram_hashes(tokens: Tokens, order: int) -> list[np.ndarray]:
    """For n = 1 to `order` the hash of the n-gram that ends at each token.

    Before a text stands the begin mark; an n-gram that would reach beyond it is the one
    that is cut off there.
    """
    starts = np.cumsum(tokens.sizes) - tokens.sizes
    place = np.arange(len(tokens.hashes)) - np.repeat(starts, tokens.sizes)
    grams = [mix(tokens.hashes)]
    for n in range(2, order + 1):
        # The context's own hash, moved on by one token.
        context = np.concatenate([[np.uint64(0)], grams[-1][:-1]]) if len(place) else grams[-1]
        context = np.where(place == 0, mix(np.full(len(place), _BEGIN)), context)
        grams.append(join_hash(context, tokens.hashes) ^ np.uint64(n))
    return grams


# --- counts on their way: sorted hashes and counts as compact bytes -----------------------


def pack_hashes(values: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="lz4", asbytes=True) if len(values) else b""


def unpack_hashes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.decompress(data, decompressed_size=8 * n, codec="lz4", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="lz4", asbytes=True) if len(values) else b""


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(data, decompressed_size=8 * n, codec="lz4", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _by_shard(values: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted hashes; a shard is a range of the hash space."""
    edges = [np.uint64(s * (1 << 64) // shards) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]])


class Chunk(NamedTuple):
    """A chunk's tokens and, by order, the sorted distinct hashes of its n-grams and the number
    in them of the n-gram that ends at each token."""

    tokens: Tokens
    known: list[np.ndarray]
    number: list[np.ndarray]


def chunk_of(texts: list[str | None], order: int) -> Chunk:
    tokens = tokens_of(texts)
    both = [np.unique(g, return_inverse=True) for g in gram_hashes(tokens, order)]
    return Chunk(tokens, [k for k, _ in both], [n for _, n in both])


# --- the automaton ------------------------------------------------------------------------


class Automaton(NamedTuple):
    """The arcs and failure arcs that a chunk's texts meet, by the token they are met at.

    `arcs[n]` is the log10 weight of the arc from the state of the n tokens before to the
    token, None where that state lacks it; `fails[n]` the weight of the state's failure arc,
    to the state of n - 1 tokens. `reach[n]` says whether the state of the n tokens before is
    one of the automaton. Order 0 is the empty context, which has an arc for every token.
    """

    arcs: list[list[float | None]]
    fails: list[list[float]]
    reach: list[list[bool]]

    def walk(self, start: int, end: int) -> float:
        """The log10 probability of the tokens from `start` to `end`, a whole text."""
        arcs, fails, reach = self.arcs, self.fails, self.reach
        longest = len(arcs) - 1
        total, state = 0.0, 1 if longest and reach[1][start] else 0
        for i in range(start, end):
            while (arc := arcs[state][i]) is None:
                total += fails[state][i]
                state -= 1
            total += arc
            # The arc leads to the state of one token more; only its last tokens may be known.
            if state < longest:
                state += 1
            while state and (i + 1 >= end or not reach[state][i + 1]):
                state -= 1
        return total


def build_automaton(chunk: Chunk, counts: list[np.ndarray], total: int, distinct: int, texts: int) -> Automaton:
    """The automaton over the chunk's n-grams with their corpus counts.

    `counts` go with `chunk.known`; `texts` is how many texts were learnt from, which is the
    begin mark's count.
    """
    sizes = chunk.tokens.sizes
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(chunk.tokens.hashes)) - np.repeat(starts, sizes)
    found = [c[n] for c, n in zip(counts, chunk.number)]
    shorter = (found[0] + 1) / (total + distinct + 1)
    arcs: list[list[float | None]] = [np.log10(shorter).tolist()]
    fails, reach = [[]], [[]]
    for n in range(1, len(counts)):
        held = np.concatenate([np.zeros(1, np.int64), found[n - 1][:-1]]) if len(place) else found[n - 1]
        if n == 1:
            held = np.where(place == 0, texts, held)
        # n tokens before a text's token: the begin mark is one of them.
        state = (held > 0) & (place >= n - 1)
        seen = state & (found[n] > 0)
        longer = np.where(state, (np.where(seen, found[n], 0) + BACKOFF * shorter) / (held + BACKOFF), shorter)
        weight = np.log10(longer).tolist()
        arcs.append([w if s else None for w, s in zip(weight, seen.tolist())])
        fails.append(np.log10(BACKOFF / (held + BACKOFF)).tolist())
        reach.append(state.tolist())
        shorter = longer
    return Automaton(arcs, fails, reach)


# --- the job ------------------------------------------------------------------------------

_SENT = "order int, shard int, chunk int, n long, hashes binary, counts binary"
_ANSWER = "order int, shard int, chunk int, n long, counts binary"
SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def held_out(doc_id):
    """crc32 of the id as text, mod 7, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _texts(table: pa.Table) -> list[str | None]:
    """The texts in an order that does not depend on how rows arrived."""
    return table["text"].to_pylist()


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Base and model log10 probability of every whole text, trained on those not held out.

    A null or empty text is its end alone. Repeated rows count, and are scored, as often as
    they occur. Only doc_id and text are read. With no training text every word is unknown.
    """
    chars, n_docs = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    chunks = max(LEAST_CHUNKS, int(chars or 0) // CHUNK_CHARS)
    shards = chunks
    dealt = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(chunks))
    doc = F.col("doc_id").cast("long")
    placed = docs.select(dealt.cast("int").alias("chunk"), doc.alias("doc_id"), "text", held_out(doc).alias("held_out"))
    placed = placed.repartition(chunks, "chunk")

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = chunk_of(_texts(table), order)
        learnt = ~np.repeat(table["held_out"].to_numpy(), chunk.tokens.sizes)
        out = []
        for n, (known, number) in enumerate(zip(chunk.known, chunk.number), 1):
            counts = np.bincount(number[learnt], minlength=len(known))
            bounds = _by_shard(known, shards)
            for s, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if b > a:
                    out.append((n, s, key[0].as_py(), b - a, pack_hashes(known[a:b]), pack_counts(counts[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["order", "shard", "chunk", "n", "hashes", "counts"]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        hashes = [unpack_hashes(d.as_py(), n) for d, n in zip(table["hashes"], sizes)]
        counts = np.concatenate([unpack_counts(d.as_py(), n) for d, n in zip(table["counts"], sizes)])
        known, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64)
        own = np.split(sums[place], np.cumsum(sizes)[:-1])
        total, distinct = int(sums.sum()), int((sums > 0).sum())
        answer = [(*k, n, pack_counts(c)) for *k, n, c in zip(*(table[c].to_pylist() for c in ("order", "shard", "chunk")), sizes, own)]
        # The shard's own sums go along as the answer to chunk -1.
        answer.append((key[0].as_py(), key[1].as_py(), -1, 2, pack_counts(np.array([total, distinct]))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        names = ["order", "shard", "chunk", "n", "counts"]
        return pa.table([pa.array([r[k] for r in answer], kind) for k, kind in enumerate(kinds)], names)

    sent = placed.groupBy("chunk").applyInArrow(send, _SENT)
    answers = stage_table(sent.groupBy("order", "shard").applyInArrow(add_up, _ANSWER), "ngram-counts")
    sums = [unpack_counts(bytes(r[0]), 2) for r in answers.where("chunk = -1 and order = 1").select("counts").collect()]
    total, distinct = (int(x) for x in np.sum([np.zeros(2, np.int64), *sums], axis=0))
    texts = docs.where(~held_out(doc)).count()

    def walk(key: tuple[pa.Scalar, ...], own: pa.Table, answer: pa.Table) -> pa.Table:
        if not own.num_rows:
            return SCORED_ARROW.empty_table()
        chunk = chunk_of(_texts(own), order)
        rows = sorted(zip(*(answer[c].to_pylist() for c in ("order", "shard", "n", "counts"))))
        counts = [np.concatenate([unpack_counts(c, m) for o, _, m, c in rows if o == n]) for n in range(1, order + 1)]
        automaton = build_automaton(chunk, counts, total, distinct, texts)
        sizes = chunk.tokens.sizes
        known = counts[0][chunk.number[0]]
        starts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((known + 1) / (total + distinct + 1)), starts)
        n_known = np.add.reduceat((known > 0).astype(np.int64), starts)
        scores = [automaton.walk(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist())]
        n = own.num_rows
        columns = [own["doc_id"], own["held_out"], sizes, n_known, np.full(n, total), base, np.array(scores)]
        return pa.table(columns, SCORED.fieldNames())

    replies = answers.where("chunk >= 0")
    return placed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(walk, SCORED)


SCORED_ARROW = pa.schema(
    [(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in SCORED]
)
