"""Similarity self-join of texts on their 5-word shingles, with Bayesian pruning of candidates.

1. Texts with equal shingle sets become one node; its copies are only counted.
2. MinHash bands propose candidates. Buckets with the same members count once, large ones are
   split into pairs of blocks.
3. Within a bucket, the MinHash values of each pair are compared a few at a time. After every
   few, the pair is dropped once the posterior probability that its similarity reaches the
   threshold, given the matches so far and a uniform prior, is below a tolerance.
4. The pairs that are left join nodes into clusters, and every pair of a cluster is verified
   exactly, block by block, by counting common shingles. Blocks return links per node and a
   spanning tree, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stage_table
from .components import components
from .words import forget_words, join_hash, mix, split_words, text_slices, windows, word_batch

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 20, 4
HASHES = BANDS * BAND_ROWS
#: MinHash values compared before each look at the posterior.
STEP = 16
TOLERANCE = 1e-6
#: Members of one bucket, and nodes of one cluster, that a block holds.
BUCKET_BLOCK, CLUSTER_BLOCK = 2_048, 512
#: Rows and characters that one task of the pair stages holds, about.
CELL_ROWS, CELL_CHARS = 20_000, 4_000_000

_seeds = np.random.default_rng(20_240_607)
_MULTIPLY = _seeds.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class Shingles(NamedTuple):
    """Sorted distinct shingles of several texts one after another, and how many each has."""

    values: np.ndarray
    sizes: np.ndarray


def shingle_sets(texts: list[str | None]) -> Shingles:
    """Hashed windows of five lower-case words; a text of one to four words is one shingle."""
    words = [split_words(t.lower()) if t else [] for t in texts]
    batch = word_batch(words)
    value, at = windows(batch, SHINGLE)
    counts = np.bincount(batch.row[at], minlength=len(texts))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    for i, own in enumerate(words):
        if len(own) >= SHINGLE:
            sets.append(np.unique(value[bounds[i] : bounds[i + 1]]))
        elif own:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return Shingles(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes)


def minhash(shingles: Shingles) -> np.ndarray:
    """HASHES values of 16 bits for each text that has shingles, one row per such text."""
    sizes = shingles.sizes[shingles.sizes > 0]
    out = np.zeros((len(sizes), HASHES), np.uint16)
    if len(sizes):
        starts = np.cumsum(sizes) - sizes
        values = mix(shingles.values)
        for k in range(HASHES):
            least = np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], starts)
            out[:, k] = mix(least) >> np.uint64(48)
    return out


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n compared values the fewest matches with which a pair stays.

    With a uniform prior, the posterior probability of a similarity of at least t after m of n
    matches is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(signatures: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows are still possible after comparing their values step by step."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    fewest = least_matches()
    for k in range(0, HASHES, STEP):
        a, b = signatures[left[alive], k : k + STEP], signatures[right[alive], k : k + STEP]
        matches[alive] += (a == b).sum(axis=1)
        alive = alive[matches[alive] >= fewest[k + STEP]]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of n nodes' component, given pairs."""
    label = np.arange(n) if roots is None else roots
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def _pairs(n: int, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n members, in parts."""
    rows = max(1, most // n)
    for start in range(0, n, rows):
        left, right = np.meshgrid(np.arange(start, min(n, start + rows)), np.arange(n), indexing="ij")
        upper = right > left
        yield left[upper], right[upper]


def bucket_roots(signatures: np.ndarray) -> np.ndarray:
    """For the members of one bucket the smallest member they hang together with."""
    roots = np.arange(len(signatures))
    for left, right in _pairs(len(signatures)):
        keep = surviving(signatures, left, right)
        roots = _roots(len(signatures), left[keep], right[keep], roots)
    return roots


def common_counts(sets: list[np.ndarray], width: int = 4_096) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    n = len(sets)
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    known, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which two of the sets have a Jaccard similarity of at least the threshold."""
    common = common_counts(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked & (common > 0)


# --- the job ------------------------------------------------------------------------------


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_hash and signature of every text; the last two null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            shingles = shingle_sets(batch.column(2).to_pylist())
            rows = iter(minhash(shingles))
            bounds = np.concatenate([[0], np.cumsum(shingles.sizes)])
            hashes, signatures = [], []
            for a, b in zip(bounds, bounds[1:]):
                filled = b > a
                hashes.append(xxhash.xxh3_128_digest(shingles.values[a:b].tobytes()) if filled else None)
                signatures.append(next(rows).tobytes() if filled else None)
            columns = [batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set_hash", "signature"])
        forget_words()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_hash long, set_hash binary, signature binary")


def _row(doc_id: str, text_hash: str) -> Column:
    """A row's place in a class: known ids first, from the smallest up."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("text_hash"))


def _nodes(signed: DataFrame) -> DataFrame:
    """One node for each shingle set: its number, a document of it, its copies and signature."""
    copies = signed.where("set_hash is not null").groupBy("set_hash", "signature")
    counted = copies.agg(
        F.min(_row("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies")
    )
    return counted.select(
        F.monotonically_increasing_id().alias("node"), "set_hash", "first.doc_id", "first.text_hash", "copies", "signature"
    )


def _blocks(df: DataFrame, size: str, block: int, *key: str) -> DataFrame:
    """Deal the rows of a group into the pairs of its blocks; adds `cell_key`, `a`, `b`, `own`."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    dealt = df.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    return dealt.drop("other").withColumn("cell_key", F.xxhash64(*key, "a", "b"))


def _candidate_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst) that hang the nodes of every bucket together whose pairs survive the pruning."""
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("signature", 2 * BAND_ROWS * k + 1, 2 * BAND_ROWS)) for k in range(BANDS)))
    members = nodes.select("node", F.explode(bands).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("members"))
    # Buckets of different bands with the same members propose the same pairs.
    distinct = sizes.where("size > 1").groupBy("size", "members").agg(F.min("bucket").alias("bucket"))
    chosen = members.join(distinct.select("bucket", "size"), "bucket")
    dealt = stage_table(_blocks(chosen, "size", BUCKET_BLOCK, "bucket").select("node", "cell_key"), "buckets")
    cells = max(1, -(-dealt.count() // CELL_ROWS))

    def prune(table: pa.Table) -> pa.Table:
        key = table["cell_key"].to_numpy()
        order = np.lexsort((table["node"].to_numpy(), key))
        key, node = key[order], table["node"].to_numpy()[order]
        data = b"".join(table["signature"].take(pa.array(order)).to_pylist())
        signatures = np.frombuffer(data, np.uint16).reshape(len(node), HASHES)
        bounds = [*np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)]
        src, dst = [], []
        for a, b in zip(bounds, bounds[1:]):
            roots = a + bucket_roots(signatures[a:b])
            moved = np.flatnonzero(roots != np.arange(a, b))
            src.append(node[a:b][moved])
            dst.append(node[roots[moved]])
        empty = np.zeros(0, np.int64)
        edges = np.unique(np.stack([np.concatenate([empty, *src]), np.concatenate([empty, *dst])], axis=1), axis=0)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["src", "dst"])

    loaded = dealt.join(nodes.select("node", "signature"), "node").withColumn("cell", F.pmod("cell_key", F.lit(cells)))
    return loaded.select("cell", "cell_key", "node", "signature").groupBy("cell").applyInArrow(prune, "src long, dst long")


def _verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, links, root): within every block of a cluster, how many documents of other texts
    each node is linked with, and the smallest node it hangs together with."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "component").join(nodes.select("node", "doc_id", "text_hash", "copies"), "node")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    found = text.join(members, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    dealt = _blocks(found, "size", CLUSTER_BLOCK, "component")
    dealt = stage_table(dealt.select("cell_key", "a", "b", "own", "node", "copies", "text"), "clusters")
    chars = dealt.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = max(1, -(-chars // CELL_CHARS))

    def verify(table: pa.Table) -> pa.Table:
        shingles = shingle_sets(table["text"].to_pylist())
        ends = np.cumsum(shingles.sizes)
        sets = [shingles.values[e - n : e] for e, n in zip(ends, shingles.sizes)]
        key, a, b, own, node, copies = (table[c].to_numpy() for c in ("cell_key", "a", "b", "own", "node", "copies"))
        order = np.lexsort((node, key))
        bounds = [*np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1)), len(order)]
        out = []
        for start, end in zip(bounds, bounds[1:]):
            rows = order[start:end]
            rows = rows[np.diff(node[rows], prepend=-1) != 0]  # repeated rows of one document
            linked = similar([sets[i] for i in rows])
            if a[rows[0]] != b[rows[0]]:
                linked &= own[rows][:, None] != own[rows][None, :]
            links = linked @ copies[rows]
            left, right = np.nonzero(linked)
            out.append((node[rows], links, node[rows][_roots(len(rows), left, right)]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        forget_words()
        return pa.table([pa.array(c) for c in columns], ["node", "links", "root"])

    cell = F.pmod("cell_key", F.lit(cells)).alias("cell")
    return dealt.select(cell, "*").groupBy("cell").applyInArrow(verify, "node long, links long, root long")


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, n_links of every row, and `kept`: whether it is its class's
    first row, or one of the equal first rows."""
    signed = stage_table(_signed(docs), "signatures")
    nodes = stage_table(_nodes(signed), "nodes")
    clusters = components(_candidate_edges(nodes))
    checked = stage_table(_verified(docs, nodes, clusters), "links")
    classes = components(checked.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "set_hash", "doc_id", "text_hash", "copies").join(links, "node", "left")
    joined = joined.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    heads = joined.groupBy("class").agg(F.min(_row("doc_id", "text_hash")).alias("head"))
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    placed = joined.join(heads, "class").select("set_hash", "head", total)
    whole = signed.select("doc_id", "text_hash", "set_hash").join(placed, "set_hash", "left")
    wordless = F.col("set_hash").isNull()
    return whole.select(
        "doc_id",
        "text_hash",
        F.when(wordless, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (wordless | (_row("doc_id", "text_hash") == F.col("head"))).alias("kept"),
        wordless.alias("wordless"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links of every row.

    Two texts are linked when their sets of 5-word shingles have a Jaccard similarity of at
    least 0.8. A class is what links hold together; its id is the smallest doc_id in it.
    n_links counts all other rows linked with a row, copies among them. A text without words
    is linked with nothing and is its own class. Repeated rows are copies. Null ids come back
    null; a class of null ids only has a null id. Only doc_id and text are read.
    """
    return _classified(docs).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those that have a near duplicate before them.

    Of each class the row with the smallest doc_id stays, of equal rows one. Texts without
    words stay as they are.
    """
    decided = stage_table(_classified(docs).where("kept"), "kept")
    # Both keys are never null, so that one shuffle serves the join and the removal of repeats.
    number, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.struct(F.col("doc_id").isNull(), F.col("text_hash"))
    firsts = decided.where("not wordless").select(number.alias("__number"), F.xxhash64(mark).alias("__mark")).distinct()
    hashed = docs.withColumn("__number", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    hashed = hashed.withColumn("__mark", F.xxhash64(F.struct(F.col("doc_id").isNull(), F.xxhash64("text"))))
    chosen = hashed.join(firsts, ["__number", "__mark"], "left_semi").dropDuplicates(["__number", "__mark"])
    has_word = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return chosen.select(*docs.columns).unionByName(docs.where(~has_word))
