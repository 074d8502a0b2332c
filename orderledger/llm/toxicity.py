"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words is the sum over all letter triples, gaps allowed, of the product of
their decayed spans in both words, scaled to 1 for equal words; an inserted character or a
gap lowers it a little instead of breaking the match. Landmarks are words of the labelled
sentences, the Nyström map turns kernels with them into features, and a linear SVM over
these decides. As the decision is linear in the triples of a word, it folds into one weight
per triple, with which every distinct word is scored. A document takes its highest word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import stage_table
from .words import forget_words, text_slices

#: Labelled documents, toxic and clean, that the classifier is fitted on, about.
FIT_ROWS = {1: 5_000, 0: 15_000}
#: Decay of the kernel for each character that a triple spans.
DECAY = 0.75
LANDMARKS = 480
#: Words are compared by at most so many letters; longer ones in overlapping windows.
LONGEST = 24
PENALTY = 20.0
#: Weight of an insult with a character put in, beside a labelled document, for the probability.
DISTORTED_WEIGHT = 0.02
#: Sizes of the training set, as of FIT_ROWS: insults, those in most toxic documents first; stems that
#: inflected insults are found by; clean words, the commonest and the hardest; hard ones that
#: distorted insults are compared with.
MOST_BAD, MOST_STEMS = 400, 800
CLEAN_WORDS, HARD_WORDS, NEAR_WORDS = 2_000, 600, 800
TOXIC_FROM = 0.7
#: An insult whose kernel with a clean word is as high as this counts as it is spelt only.
TOO_LIKE = 0.65

_CLASSES = 32
_NOTHING = -9.0
_SINGLE = -10.0
# Beginnings of words are counted like words, as insults may be inflected.
_STEM, _STEMS = "~", (4, 5)
# Odd factors that make four hashes of one.
_FACTORS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_LEET = str.maketrans("0134578@$", "oieastbas")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


@lru_cache(maxsize=150_000)
def fold(word: str) -> str:
    """Lower-case letters of a word; digits between letters read as the letters they look like."""
    word = word.lower()
    if any(c.isalpha() for c in word) and not word.isalpha():
        word = word.translate(_LEET)
    return "".join(c for c in word if c.isalpha())


def _codes(words: list[str]) -> np.ndarray:
    """Letter classes of folded words of one length; letters beyond a-z share a few classes."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    latin = (points >= 97) & (points <= 122)
    return np.where(latin, points - 97, 26 + points % 6).astype(np.int64)


@lru_cache(maxsize=LONGEST + 1)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(length), 3)))
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length the ids of their triples and the decayed spans."""
    places, weight = _triples(codes.shape[1])
    a, b, c = (codes[:, places[:, k]] for k in range(3))
    return (a * _CLASSES + b) * _CLASSES + c, weight


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, by the recursion over prefixes, for all words at once."""
    n, length = codes.shape
    decay = DECAY
    before = np.ones((length + 1, length + 1, n))
    for _ in range(2):
        now = np.zeros_like(before)
        for i in range(1, length + 1):
            run = np.zeros(n)
            for j in range(1, length + 1):
                run = decay * run + decay * decay * (codes[:, i - 1] == codes[:, j - 1]) * before[i - 1, j - 1]
                now[i, j] = decay * now[i - 1, j] + run
        before = now
    total = np.zeros(n)
    for i in range(length):
        for j in range(length):
            total += decay * decay * (codes[:, i] == codes[:, j]) * before[i, j]
    return total


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    starts = [*range(0, len(word) - LONGEST, LONGEST // 2), len(word) - LONGEST]
    return [word[s : s + LONGEST] for s in starts]


def _by_length(words: Iterable[str], most: int = 4_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    groups = defaultdict(list)
    for word in words:
        groups[len(word)].append(word)
    for length, group in sorted(groups.items()):
        for k in range(0, len(group), most):
            part = group[k : k + most]
            yield _codes(part), part


def unit_map(words: list[str]) -> np.ndarray:
    """Dense unit-length triple vectors of a few words, one row each."""
    rows = {w: i for i, w in enumerate(words)}
    out = np.zeros((len(words), _CLASSES**3), np.float32)
    for codes, part in _by_length(rows):
        ids, weight = _features(codes)
        for word, triple in zip(part, ids):
            np.add.at(out[rows[word]], triple, weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class ToxicModel(NamedTuple):
    """One weight per letter triple, the offset, and slope and offset of the probability; the
    insults it was fitted on, and pieces of them that are clean words."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float
    insults: tuple[str, ...] = ()
    plain: frozenset[str] = frozenset()


def word_margins(words: list[str], weights: np.ndarray, offset: float) -> np.ndarray:
    """SVM decision of folded words with three letters or more; the highest over their windows."""
    place: dict[str, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        for window in _windows(word):
            place[window].append(i)
    out = np.full(len(words), -np.inf)
    for codes, part in _by_length(place, most=1_000):
        ids, weight = _features(codes)
        margin = (weights[ids] @ weight) / np.sqrt(self_kernel(codes)) + offset
        for window, value in zip(part, margin):
            for i in place[window]:
                out[i] = max(out[i], value)
    return out


def _squared_hinge(features: np.ndarray, target: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear SVM by Newton steps on the squared hinge loss; the last weight is the offset."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = target * (x @ w) < 1
        xa, ca = x[active], cost[active]
        step = np.linalg.solve(ridge + 2 * (xa.T * ca) @ xa, 2 * (xa.T * ca) @ target[active]) - w
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def distortions(insults: list[str], near: list[str], good: set[str]) -> list[str]:
    """Distorted forms of the insults that no clean word of `near` is much like; for the others
    they could not be told from clean words."""
    there = unit_map(near).T if near else np.zeros((_CLASSES**3, 1), np.float32)
    out: set[str] = set()
    for part in _parts(insults):
        likeness = (unit_map(part) @ there).max(axis=1)
        out |= {w for b, k in zip(part, likeness) if k < TOO_LIKE for w in distorted(b) if len(w) > 3}
    return sorted(out - set(insults) - good)


def fit_words(insults: list[str], good: list[str], landmarks: list[str], changed: list[str] | None = None) -> tuple[np.ndarray, float]:
    """Weight per triple and offset of the SVM over Nyström features.

    Insults count as they are and with a character put in: the forms `changed`, or all.
    """
    if changed is None:
        changed = sorted({w for b in insults for w in distorted(b)} - set(insults))
    bad = insults + changed
    base = unit_map(landmarks)
    gram = (base @ base.T).astype(float)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernels = [unit_map(part) @ base.T for words in (bad, good) for part in _parts(words)]
    features = np.concatenate(kernels) @ root
    target = np.repeat([1.0, -1.0], [len(bad), len(good)])
    cost = np.where(target > 0, PENALTY * len(good) / len(bad), PENALTY)
    w = _squared_hinge(features, target, cost)
    return base.T.astype(float) @ (root @ w[:-1]), float(w[-1])


def _parts(words: list[str], size: int = 400) -> Iterator[list[str]]:
    for k in range(0, len(words), size):
        yield words[k : k + size]


def distorted(word: str) -> list[str]:
    """The word with one foreign letter put in at every inner place, and with a doubled letter."""
    out = []
    for i in range(1, len(word)):
        letter = "xzqkwvj"[i % 7]
        out += [word[:i] + letter + word[i:], word[:i] + word[i - 1] + word[i:]]
    return out


def sentence_units(text: str) -> set[str]:
    """Folded words of three letters or more, and words spelt out in single letters."""
    units = set()
    for sentence in _SENTENCE.findall(text):
        letters = ""
        for word in sentence.split():
            plain = fold(word)
            if len(plain) == 1:
                letters += plain
                continue
            if len(letters) >= 3:
                units.add(letters)
            letters = ""
            if len(plain) >= 3:
                units.add(plain)
        if len(letters) >= 3:
            units.add(letters)
    return units


class WordScores(dict):
    """Raw word -> its margin, remembered by the worker up to a bound."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model
        self.insults = frozenset(model.insults)
        self.heads = {w[:k] for w in model.insults for k in range(1, len(w))}
        self.starts: set[str] = set()

    def learn(self, words: Iterable[str]) -> None:
        if len(self) >= 400_000:
            self.clear()
            self.starts.clear()
        new = [w for w in words if w not in self]
        plain = {w: fold(w) if len(w) <= 200 else fold.__wrapped__(w) for w in new}
        long_enough = sorted({p for p in plain.values() if len(p) >= 3})
        margins = dict(zip(long_enough, word_margins(long_enough, self.model.weights, self.model.offset)))
        for word, folded in plain.items():
            if folded in self.heads:
                self.starts.add(word)
            self[word] = margins.get(folded, _SINGLE if len(folded) == 1 else _NOTHING)

    def best(self, text: str) -> float:
        """The highest margin of a text's words, also of those spelt out letter by letter."""
        words = text.split()
        if not words:
            return _NOTHING
        margins = np.fromiter(map(self.__getitem__, words), float, len(words))
        best = max(float(margins.max()), _NOTHING)
        single = margins == _SINGLE
        if single.sum() >= 3:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for start, end in zip(edges[::2], edges[1::2]):
                if end - start >= 3:
                    spelt = "".join(map(fold, words[start:end]))
                    best = max(best, float(word_margins([spelt], self.model.weights, self.model.offset)[0]))
        for joined in self.joined(words):
            best = max(best, float(word_margins([joined], self.model.weights, self.model.offset)[0]))
        return best

    def joined(self, words: list[str]) -> set[str]:
        """Insults that neighbouring words of a sentence spell together, unless each is a clean word."""
        found = set()
        for i, word in enumerate(words):
            if word not in self.starts:
                continue
            spelt = fold(word) if len(word) <= 200 else fold.__wrapped__(word)
            plain = spelt in self.model.plain
            for before, after in zip(words[i : i + LONGEST], words[i + 1 : i + LONGEST]):
                piece = fold(after) if len(after) <= 200 else fold.__wrapped__(after)
                if not piece or before[-1] in ".!?":
                    break
                spelt, plain = spelt + piece, plain and piece in self.model.plain
                if spelt in self.insults and not plain:
                    found.add(spelt)
                if spelt not in self.heads:
                    break
        return found


def _distinct_words(texts: list[str]) -> set[str]:
    words: set[str] = set()
    for text in texts:
        words.update(text.split())
    return words


def margins(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and the highest word margin of every whole text, without a shuffle."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model)
        for batch in text_slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores.learn(_distinct_words(texts))
            out = pa.array(map(scores.best, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), out], ["doc_id", "margin"])
        fold.cache_clear()
        forget_words()

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("margin", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(rate, schema)


def held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame) -> dict[int, int]:
    """About FIT_ROWS ids of each class that are not held out, by hashed id; id -> toxic.

    An id with both labels counts as toxic.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    limits = [F.when(F.col("toxic") == k, F.lit(FIT_ROWS[k] / n)) for k, n in sizes.items()]
    if not limits:
        return {}
    return {r[0]: r[1] for r in known.where(drawn < F.coalesce(*limits)).collect()}


def word_marks(text: str) -> list[int]:
    """Smallest hashes of the text's word triples under a few hash functions; near copies share most."""
    words = text.lower().split()
    windows = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in windows), np.uint64, len(windows))
    return [int((hashes * factor).min() >> np.uint64(1)) for factor in _FACTORS]


def copy_weights(documents: list[tuple[int, tuple[int, ...]]]) -> dict[tuple[int, tuple[int, ...]], float]:
    """(label, marks) of a document -> its weight if that is not 1; a group of copies weighs 1 in all.

    A document belongs with those of its label that have its most frequent mark.
    """
    often = Counter((label, m) for label, marks in documents for m in marks)
    group = {d: max((often[d[0], m], m) for m in d[1]) for d in set(documents)}
    size = Counter((d[0], group[d]) for d in documents)
    return {d: 1 / n for d in group if (n := size[d[0], group[d]]) > 1}


def likelihood_ratio(base: float):
    """Log likelihood ratio of a unit's share of toxic documents, from its (bad, good), against `base`."""
    both = F.col("bad") + F.col("good")
    gain = lambda n, p: F.when(n > 0, n * F.log(n / both / p)).otherwise(0.0)
    return F.when(F.col("bad") > base * both, gain(F.col("bad"), base) + gain(F.col("good"), 1 - base)).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fit on the sentences of a bounded sample of labelled documents that are not held out."""
    sample = labelled_sample(labels)
    nothing = ToxicModel(np.zeros(_CLASSES**3), 0.0, 0.0, -3.0)
    if set(sample.values()) != {0, 1}:
        return nothing
    spark = docs.sparkSession
    known = spark.createDataFrame(list(sample.items()), "doc_id long, toxic int")
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=500_000):
            texts = batch.column(1).to_pylist()
            found = []
            for text in texts:
                words = sentence_units(text)
                short = {p + _STEM for p in map(fold, set(text.split())) if 0 < len(p) < 3}
                found.append(sorted(words | short | {w[:k] + _STEM for w in words for k in _STEMS if len(w) >= k}))
            marks = pa.array(map(word_marks, texts), pa.list_(pa.int64()))
            columns = [batch.column(0), marks, pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "marks", "units"])
        fold.cache_clear()
        forget_words()

    read = chosen.select("toxic", "text").mapInArrow(units, "toxic int, marks array<long>, units array<string>")
    read = stage_table(read, "toxic-documents")
    documents = [(r[0], tuple(r[1])) for r in read.select("toxic", "marks").collect()]
    weights = copy_weights(documents)
    sizes = {k: sum(weights.get(d, 1.0) for d in documents if d[0] == k) for k in (0, 1)}
    if not all(sizes.values()):
        return nothing

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, marks, found = (c.to_pylist() for c in batch.columns)
            weight = np.array([weights.get((k, tuple(m)), 1.0) for k, m in zip(toxic, marks)])
            label, count = np.array(toxic), [len(u) for u in found]
            columns = [np.repeat(weight * (label == k), count) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), *map(pa.array, columns)], ["unit", "bad", "good"])

    seen = read.mapInArrow(weigh, "unit string, bad double, good double")
    counted = seen.groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("all"))
    counted = stage_table(counted, "toxic-units")
    base = min(sizes[1] / (sizes[1] + sizes[0]), 0.9)
    share = (F.col("bad") + base) / (F.col("bad") + F.col("good") + 1)
    # Less than one unit in all would tell toxic documents from clean ones so well by chance;
    # a few clean documents do not rule a unit out.
    chance = math.log(max(2, counted.count())) - 1e-6
    marked = counted.where((F.col("bad") >= 3 - 1e-6) & (likelihood_ratio(base) >= chance))
    likely = marked.where((share >= TOXIC_FROM) & ~_is_stem()).select("unit", "bad")
    heads = marked.where(_is_stem()).select(F.col("unit").alias("stem"), share.alias("stem_share"))
    heads = heads.orderBy(F.desc("stem_share"), "stem").limit(MOST_STEMS)
    stem = F.explode(F.array(*(F.concat(F.substring("unit", 1, k), F.lit(_STEM)) for k in _STEMS))).alias("stem")
    forms = counted.where(~_is_stem() & (F.col("bad") >= 2 - 1e-6)).select("unit", "bad", "good", stem)
    forms = forms.join(F.broadcast(heads), "stem").groupBy("unit", "bad", "good").agg(F.max("stem_share").alias("stem_share"))
    pooled = (F.col("bad") + 4 * F.col("stem_share")) / (F.col("bad") + F.col("good") + 4)
    inflected = forms.where((pooled >= TOXIC_FROM) & (likelihood_ratio(base) >= math.log(100))).select("unit", "bad")
    # Words found by themselves and by their stem are ranked together, however many there are.
    found = likely.union(inflected).groupBy("unit").agg(F.max("bad").alias("bad"))
    bad = [r[0] for r in found.orderBy(F.desc(F.round("bad", 6)), "unit").limit(MOST_BAD).collect()]
    if not bad:
        return nothing
    clean = counted.where((F.col("good") > 0) & (share < 0.5) & ~_is_stem()).where(~F.col("unit").isin(bad))
    good = [r[0] for r in clean.orderBy(F.desc(F.round("good", 6)), "unit").limit(CLEAN_WORDS).collect()]
    leading = bad[: LANDMARKS // 2]
    worst = good
    for last in (False, False, True):
        landmarks = leading + worst[: LANDMARKS - len(leading)]
        changed = distortions(bad, worst[:NEAR_WORDS], set(good))
        weights, offset = fit_words(bad, good, landmarks, changed)
        if not last:  # clean words that look worst join the training set and the landmarks
            worst = _worst(clean.select("unit"), weights, offset)
            good = sorted({*good, *worst})
    plain = _plain_pieces(counted, bad)
    model = ToxicModel(weights, offset, 1.0, 0.0, tuple(bad), plain)
    rated = margins(chosen.select("doc_id", "text"), model).collect()
    points = [(m, sample[i], 1.0) for i, m in rated]
    points += [(float(m), 1, DISTORTED_WEIGHT) for m in (word_margins(changed, weights, offset) if changed else ())]
    return model._replace(**_probability(points))


def _plain_pieces(counted: DataFrame, bad: list[str]) -> frozenset[str]:
    """The pieces of insults that stand as words in two clean documents or more."""
    pieces = {w[i:j] for w in bad for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) <= LONGEST}
    named = [(p if len(p) >= 3 else p + _STEM,) for p in sorted(pieces)]
    if not named:
        return frozenset()
    known = counted.sparkSession.createDataFrame(named, "unit string")
    both = counted.where("good >= 2").join(F.broadcast(known), "unit", "left_semi")
    return frozenset(r[0].removesuffix(_STEM) for r in both.select("unit").collect())


def _is_stem():
    return F.substring("unit", -1, 1) == _STEM


def _worst(clean: DataFrame, weights: np.ndarray, offset: float, most: int = HARD_WORDS) -> list[str]:
    """The clean words with the highest margins; every task sends its own highest only."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            margin = word_margins(words, weights, offset)
            top = np.argsort(-margin, kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in top], pa.string()), pa.array(margin[top])], ["unit", "margin"])

    rated = clean.mapInArrow(rate, "unit string, margin double")
    return [r[0] for r in rated.orderBy(F.desc("margin"), "unit").limit(most).collect()]


def _probability(points: list[tuple[float, int, float]]) -> dict[str, float]:
    """Slope and shift of the logistic curve through (margin, label, weight), slightly ridged.

    Margins beyond 1 are fitted as 1, as in the SVM's loss: how far an insult lies beyond says nothing.
    """
    x = np.array([[min(max(m, -3.0), 1.0), 1.0] for m, _, _ in points])
    y = np.array([label for _, label, _ in points], float)
    share = np.array([weight for _, _, weight in points])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + 0.01 * w
        hessian = (x.T * (share * p * (1 - p))) @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return {"slope": float(max(w[0], 0.0)), "shift": float(w[1])}


def rate(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of 0.7 or more) of every whole text.

    A null or empty text gets the low score of a text without words. Repeated rows are
    scored as they are; only doc_id and text are read.
    """
    logit = F.lit(model.slope) * F.greatest(F.col("margin"), F.lit(-3.0)) + F.lit(model.shift)
    score = 1 / (1 + F.exp(-logit))
    rated = margins(docs, model).select("doc_id", score.alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels that are not held out, score all documents."""
    scored = rate(docs, train(docs, labels))
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text is not predicted to be toxic."""
    model = train(docs, labels)
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model)
        for batch in text_slices(batches, column):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            scores.learn(_distinct_words(texts))
            logit = [model.slope * max(scores.best(t), -3.0) + model.shift for t in texts]
            clean = [1 / (1 + math.exp(-min(x, 700.0))) < TOXIC_FROM if x > -700 else True for x in logit]
            yield batch.filter(pa.array(clean, pa.bool_()))
        fold.cache_clear()
        forget_words()

    return docs.mapInArrow(keep, docs.schema)
