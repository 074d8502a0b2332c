"""Groups of spelling variants, found by range searches over letter counts.

A word is a point: how often it holds each letter. One inserted code point moves the point by
one, one replaced code point by one down and one up. A k-d tree for every word length, grown
over a bounded sample, cuts the space into cells; each word lies in one cell and is sent as a
query to the cells of its own and the next length that its moves can reach. In a cell a k-d
tree over the words there prunes by boxes, and the order of the letters decides at last.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_table
from .words import text_slices

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, TYPO_EVERY = 7, 2, 10, 31
#: Words that the cells are cut by, about, and how many words a cell is to hold. They only
#: decide which task compares two words.
SAMPLE_WORDS, CELL_WORDS = 200_000, 2_000
#: Words of one cell that are compared in one task; larger cells are cut into blocks.
BLOCK_WORDS = 8_192
_BLOCK_LETTERS, _QUERIES_PER_TASK = 4_000_000, 100_000
_LEAF = 64
_DIMENSIONS, _MOST = 32, 127
# Shorter runs are no words; a longer run is taken whole.
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)

_SEEN = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def typo(word: str, doc_id: int | None, every: int = TYPO_EVERY) -> str:
    """The word as it stands in the document: one code point short if `every` divides a hash of
    both. A null id changes nothing."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, every: int = TYPO_EVERY, least: int = LEAST_COUNT, most: int = 200_000) -> DataFrame:
    """(word, n) of the words of LEAST_LETTERS code points or more that stand `least` times in all.

    Tasks send sums over up to `most` words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                for word, n in Counter(_RUN.findall(_lowered(text))).items():
                    total[typo(word, doc_id, every)] += n
            if len(total) > most:
                yield _batch(total)
                total.clear()
        yield _batch(total)

    seen = docs.select("doc_id", "text").mapInArrow(count, _SEEN)
    summed = seen.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
    return summed.where(F.col("n") >= least)


def _lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "replace").translate(_LOWER_BYTES).decode("utf-8")


_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _batch(total: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, _SEEN.fieldNames())


# --- points and trees ---------------------------------------------------------------------------


def letter_counts(words: list[str]) -> np.ndarray:
    """One row per word: its code points by dimension; letters beyond a-z share six.

    Counts end at 127. That moves no two words apart, so no pair is lost; letters decide.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    latin = (points >= 97) & (points <= 122)
    dimension = np.where(latin, points - 97, 26 + points % 6)
    row = np.repeat(np.arange(len(words)), lengths)
    flat = np.bincount(row * _DIMENSIONS + dimension, minlength=len(words) * _DIMENSIONS)
    return np.minimum(flat, _MOST).reshape(-1, _DIMENSIONS).astype(np.int8)


class Cells(NamedTuple):
    """A k-d tree as arrays: inner nodes split a dimension at a count, leaves have a number.

    Points with a count up to `cut` are in the left child, node + 1; the others in `right`.
    """

    dimension: np.ndarray
    cut: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        node = np.zeros(len(points), np.int64)
        while (inner := self.dimension[node] >= 0).any():
            at = np.flatnonzero(inner)
            here = node[at]
            left = points[at, self.dimension[here]] <= self.cut[here]
            node[at] = np.where(left, here + 1, self.right[here])
        return self.leaf[node]

    def reach(self, points: np.ndarray, down: int, up: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of all leaves that hold points with up to `up` counts more and `down` less."""
        found_point, found_leaf = [], []
        n = len(points)
        stack = [(0, np.arange(n), np.zeros((n, 2), np.int8), {})]
        while stack:
            node, who, spent, box = stack.pop()
            if not len(who):
                continue
            d = self.dimension[node]
            if d < 0:
                found_point.append(who)
                found_leaf.append(np.full(len(who), self.leaf[node]))
                continue
            low, high = box.get(d, (0, _MOST))
            value, cut = points[who, d], int(self.cut[node])
            for child, new_low, new_high in ((node + 1, low, min(high, cut)), (self.right[node], max(low, cut + 1), high)):
                # What this dimension costs in the parent's box and in the child's.
                less = np.maximum(value - new_high, 0) - np.maximum(value - high, 0)
                more = np.maximum(new_low - value, 0) - np.maximum(low - value, 0)
                total = spent + np.stack([less, more], axis=1, dtype=np.int8)
                near = (total[:, 0] <= down) & (total[:, 1] <= up)
                stack.append((child, who[near], total[near], {**box, d: (new_low, new_high)}))
        if not found_point:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_point), np.concatenate(found_leaf)


def grow(points: np.ndarray, most: int) -> tuple[Cells, list[np.ndarray]]:
    """A tree whose leaves hold up to `most` of the points, and the points of each leaf.

    A node splits the dimension that parts its points best; equal points stay together.
    """
    dimension, cut, right, leaf, members = [], [], [], [], []

    def add(who: np.ndarray) -> None:
        node = len(dimension)
        split = _best_split(points[who]) if len(who) > most else None
        for column, value in ((dimension, -1), (cut, 0), (right, 0), (leaf, -1)):
            column.append(value)
        if split is None:
            leaf[node] = len(members)
            members.append(who)
            return
        dimension[node], cut[node] = split
        left = points[who, split[0]] <= split[1]
        add(who[left])
        right[node] = len(dimension)
        add(who[~left])

    add(np.arange(len(points)))
    return Cells(*(np.array(x, np.int64) for x in (dimension, cut, right, leaf))), members


def _best_split(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, count) whose two sides differ least in size; None if all points are equal."""
    n, best = len(points), None
    highest = points.max(axis=0)
    for value in range(int(highest.max(initial=0))):
        if value > 64:  # long words: cut at the median instead of trying every count
            break
        low = (points <= value).sum(axis=0)
        worth = np.minimum(low, n - low)
        d = int(worth.argmax())
        if worth[d] and (best is None or worth[d] > best[0]):
            best = int(worth[d]), d, value
    if best is None:
        median = np.median(points, axis=0).astype(np.int64)
        low = (points <= median).sum(axis=0)
        worth = np.minimum(low, n - low)
        d = int(worth.argmax())
        if not worth[d]:
            return None
        best = int(worth[d]), d, int(median[d])
    return best[1], best[2]


# --- letters ------------------------------------------------------------------------------------


def letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    return points.reshape(len(words), -1).astype(np.uint16)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of one length differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of `long` are those of `short` with one code point put in."""
    differs = short != long[:, :-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), short.shape[1])
    after = np.arange(short.shape[1]) >= first[:, None]
    return ~(after & (short != long[:, 1:])).any(axis=1)


def signatures(points: np.ndarray) -> np.ndarray:
    """Two bits per dimension, for one count or more and for two; a count moved by one flips one bit at most."""
    bits = np.arange(_DIMENSIONS, dtype=np.uint64) * np.uint64(2)
    two = (points >= 1).astype(np.uint64) | (points >= 2).astype(np.uint64) << np.uint64(1)
    return np.bitwise_or.reduce(two << bits, axis=1)


def near_pairs(queries: list[str], words: list[str], longer: bool, ordered: bool) -> Iterator[tuple[int, int]]:
    """(query, word) of all near pairs; the words are of the queries' length, or `longer` by one.

    If `ordered`, only pairs whose query is the smaller word are given.
    """
    points, asked = letter_counts(words), letter_counts(queries)
    marks, asked_marks = signatures(points), signatures(asked)
    spelt, asked_spelt = letters(words), letters(queries)
    tree, members = grow(points, _LEAF)
    down, up = (0, 1) if longer else (1, 1)
    who, leaf = tree.reach(asked, down, up)
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    bounds = np.flatnonzero(np.diff(leaf, prepend=-1))
    for start, end in zip(bounds, [*bounds[1:], len(leaf)]):
        there = members[leaf[start]]
        low, high = points[there].min(axis=0), points[there].max(axis=0)
        for k in range(start, end, 4_096):
            here = who[k : min(end, k + 4_096)]
            own = asked[here]
            boxed = np.maximum(own - high, 0).sum(axis=1, dtype=np.int16) <= down
            boxed &= np.maximum(low - own, 0).sum(axis=1, dtype=np.int16) <= up
            here = here[boxed]
            flipped = np.bitwise_count(asked_marks[here][:, None] ^ marks[there][None, :])
            first, second = np.nonzero(flipped <= down + up)
            change = points[there[second]] - asked[here[first]]
            fits = np.maximum(-change, 0).sum(axis=1, dtype=np.int16) <= down
            fits &= np.maximum(change, 0).sum(axis=1, dtype=np.int16) <= up
            first, second = here[first[fits]], there[second[fits]]
            right = (one_inserted if longer else one_replaced)(asked_spelt[first], spelt[second])
            for i, j in zip(first[right].tolist(), second[right].tolist()):
                if not ordered or queries[i] < words[j]:
                    yield i, j


# --- cells over all words -----------------------------------------------------------------------


def cut_cells(words: DataFrame, sample: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS) -> dict[int, tuple[Cells, int]]:
    """Length -> its tree and the number of its first cell, from about `sample` of the words.

    A cell holds eight words of the sample at least, so the trees are bounded like the sample.
    """
    total = words.count()
    per_cell = max(8, cell_words * min(sample, total) // max(total, 1))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(total, 1)))
    by_length: dict[int, list[str]] = {}
    # Very long words lie in the one cell of their length, so none is sent here.
    for (word,) in drawn.where(F.length("word") <= 64).select("word").collect():
        by_length.setdefault(len(word), []).append(word)
    trees, first = {}, 0
    for length, found in sorted(by_length.items()):
        tree, members = grow(letter_counts(sorted(found)), per_cell)
        trees[length] = tree, first
        first += len(members)
    return trees


_PLACED = T.StructType(
    [
        T.StructField("length", T.IntegerType()),
        T.StructField("cell", T.LongType()),
        T.StructField("asks", T.IntegerType()),
        T.StructField("word", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)
#: Rows of a cell: words at home there; queries for words of their length, at home there too
#: or in a cell before it; queries for words longer by one.
_HOME, _OWN, _SAME, _LONGER = range(4)
_ONE = grow(np.zeros((0, _DIMENSIONS), np.int8), 1)[0]


def _places(trees: dict[int, tuple[Cells, int]], what: int):
    """Function of Arrow batches: every word at home, or as a query in each cell it can reach."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, 500_000):
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                points = letter_counts([words[i] for i in at])
                if what == _HOME:
                    tree, first = trees.get(length, (_ONE, 0))
                    found = [(length, _HOME, np.arange(len(at)), first + tree.home(points))]
                else:
                    tree, first = trees.get(length, (_ONE, 0))
                    home = tree.home(points)
                    who, leaf = tree.reach(points, 1, 1)
                    # A pair of two cells is found from the first.
                    found = [(length, _OWN, np.arange(len(at)), first + home)]
                    who, leaf = who[leaf > home[who]], leaf[leaf > home[who]]
                    found.append((length, _SAME, who, first + leaf))
                    tree, first = trees.get(length + 1, (_ONE, 0))
                    who, leaf = tree.reach(points, 0, 1)
                    found.append((length + 1, _LONGER, who, first + leaf))
                for there, asks, who, cell in found:
                    columns = [
                        pa.array(np.full(len(who), there, np.int32)),
                        pa.array(cell.astype(np.int64)),
                        pa.array(np.full(len(who), asks, np.int32)),
                        pa.array([words[i] for i in at[who]], pa.string()),
                        pa.array(n[at[who]]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, _PLACED.fieldNames())

    return place


_LINKS = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())]
)


def _compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Near pairs, both ways round, of a block of words (left) and a block of queries (right)."""
    words, counts = left.column("word").to_pylist(), left.column("n").to_pylist()
    out: list[tuple[str, str, int]] = []
    if words and right.num_rows:
        asks = right.column("asks").to_numpy()
        for kind in (_OWN, _SAME, _LONGER):
            part = right.filter(pa.array(asks == kind))
            queries, query_counts = part.column("word").to_pylist(), part.column("n").to_pylist()
            if not queries:
                continue
            for q, w in near_pairs(queries, words, kind == _LONGER, kind == _OWN):
                out.append((queries[q], words[w], counts[w]))
                out.append((words[w], queries[q], query_counts[q]))
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=_LINKS.fieldNames())


def near_words(words: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n), both ways round, of all pairs that differ by one code point.

    Cells are groups of bounded size: a cell with more words or queries than a block is cut
    into blocks by hash, and each block of words meets each block of queries.
    """
    trees = cut_cells(words)
    home = stage_table(words.select("word", "n").mapInArrow(_places(trees, _HOME), _PLACED), "spelling-cells")
    asked = stage_table(words.select("word", "n").mapInArrow(_places(trees, _SAME), _PLACED), "spelling-queries")
    cell = ["length", "cell"]
    sizes = home.groupBy(*cell).agg(F.count(F.lit(1)).alias("home"))
    sizes = sizes.join(asked.groupBy(*cell).agg(F.count(F.lit(1)).alias("asked")), cell)
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.lit(_BLOCK_LETTERS) / F.col("length")))
    blocks = lambda n: F.ceil(F.col(n) / rows).cast("int")
    sizes = sizes.select(
        *cell, F.col("asked").alias("queries"), blocks("home").alias("home_blocks"), blocks("asked").alias("asked_blocks")
    )
    sizes = stage_table(sizes, "spelling-sizes")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("word", F.lit(own)), F.col(f"{own}_blocks")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        return rows.join(sizes, cell).select(*cell, "asks", "word", "n", mine, every)

    keys = [*cell, "home", "asked"]
    # Comparing costs far more than its bytes tell, so the parts follow the number of queries.
    meetings = F.sum(F.col("queries") * F.col("home_blocks")) / _QUERIES_PER_TASK
    parts = max(words.sparkSession.sparkContext.defaultParallelism, int(sizes.agg(meetings).first()[0] or 0))
    left = dealt(home, "home", "asked").repartition(parts, *keys).groupBy(*keys)
    right = dealt(asked, "asked", "home").repartition(parts, *keys).groupBy(*keys)
    return left.cogroup(right).applyInArrow(_compare, _LINKS)


def roots(words: DataFrame) -> DataFrame:
    """(word, root): the last of a word's forms, for the words that have a form.

    Forms are at least FORM_TIMES as frequent as their word, so a chain has fewer than twenty
    steps; pointers are doubled until none moves.
    """
    jumps = stage_table(words.where("form is not null").select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stage_table(moved, "spelling-forms")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        jumps = moved.select("word", "root")


def spelling_groups(docs: DataFrame, every: int = TYPO_EVERY, block: int = BLOCK_WORDS) -> DataFrame:
    """Word, its form (the most frequent near word if that is FORM_TIMES as frequent), the root
    of its chain of forms, and n, n_near and form_n.

    Words are runs of Latin letters up to U+00FF with A-Z in lower case, some a code point
    short by `typo`. Null and empty texts have none; repeated rows count again; a word of
    any length is compared whole; other columns are not read; an empty table gives no rows.
    Ties go to the smaller word in code-point order.
    """
    words = stage_table(word_counts(docs, every), "spelling-words")
    links = stage_table(near_words(words, block), "spelling-links")
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    frequent = -F.col("best.less") >= FORM_TIMES * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(frequent, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    formed = stage_table(formed, "spelling-formed")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
