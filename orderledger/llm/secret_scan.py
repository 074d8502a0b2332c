"""Secrets in texts, with a random forest that removes false positives. Built-in functions only.

Words that could hold a secret become findings with features: length, character transitions
and shares of classes, how much of them dictionary words cover, how much they look like a
path or address, and the words beside them. A random forest, trained on a bounded sample of
labelled findings, becomes one column expression over these features.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stage_table

#: Words of the dictionary, the commonest of the corpus.
DICTIONARY_WORDS = 3_000
#: Labelled findings of each class that the forest is fitted on.
FIT_ROWS = 4_000
TREES, DEPTH = 12, 5
SECRET_FROM = 0.5
MASK = "[SECRET]"
SHORTEST = 8

_BLANK = "[ \\t\\n\\x0B\\f\\r]+"
_CUES = "(pass(word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private|credential|auth|bearer)"
_CUE = "(?i)" + _CUES
# The words before a value that hand it over: "password:", "password =", "Bearer".
_HANDED = f"(?i)({_CUES}[a-z_]*[\"']?( ?[=:]+)|(^| )[\"'(]*bearer)$"
# Letters only, with capitals inside.
_LETTERS = "^[A-Za-z]*[a-z][A-Z][A-Za-z]*[a-z][A-Z][A-Za-z]*$"
_BEGIN = "-----BEGIN"
# The value of a word: what follows an assignment, without quotes and closing marks.
_VALUE = "^[\"'(\\[<]*(?:[A-Za-z_.-]{2,40}[=:]+)?[\"'(\\[<]*(.*?)[\"'.,;:)\\]>!?]*$"
# Fixed formats that issuers give their secrets; findings of these shapes are labelled 1.
_ISSUED = (
    "^(AKIA|ASIA)[A-Z0-9]{16}$",
    "^gh[pousr]_[A-Za-z0-9]{36,}$",
    "^xox[abpr]-[A-Za-z0-9-]{10,}$",
    "^sk_(live|test)_[A-Za-z0-9]{16,}$",
    "^AIza[A-Za-z0-9_-]{35}$",
    "^eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}$",
)
# Shapes of other things that hold digits: addresses, numbers, versions, files, plain words.
_HARMLESS = (
    "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$",
    "^[0-9.,:/+()x%-]+$",
    "^[a-z]+://",
    "^[^0-9]*$",
    "^\\p{L}+[0-9]{1,4}$",
    "^[0-9]{1,4}\\p{L}+$",
)
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "transitions", "distinct", "hexadecimal",
    "numeric", "dictionary", "path", "address", "assigned", "cue_before", "cue_after",
)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.length(whole), F.lit(1))


def _left(value: Column, pattern: str) -> Column:
    """Length of what remains when the pattern's characters are taken out."""
    return F.length(F.regexp_replace(value, pattern, ""))


def _features(value: Column, word: Column, before: Column, after: Column, dictionary: list[str]) -> dict[str, Column]:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    parts = F.filter(F.split(F.lower(value), "[^\\p{L}]+"), lambda p: F.length(p) >= 3)
    known = F.filter(parts, lambda p: p.isin(dictionary)) if dictionary else F.slice(parts, 1, 0)
    covered = F.aggregate(known, F.lit(0), lambda total, p: total + F.length(p))
    turns = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    return {
        "length": F.least(F.length(value), F.lit(200)).cast("double"),
        "digits": _share(_left(value, "[^0-9]"), value),
        "upper": _share(_left(value, "[^A-Z]"), value),
        "lower": _share(_left(value, "[^a-z]"), value),
        "marks": _share(_left(value, "[A-Za-z0-9]"), value),
        "transitions": _share(F.regexp_count(value, F.lit(turns)), value),
        "distinct": _share(F.size(F.array_distinct(F.split(value, ""))), value),
        "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "numeric": flag(value.rlike("^[0-9 .-]+$")),
        "dictionary": _share(covered, value),
        "path": _share(_left(value, "[^/\\\\.:]"), value),
        "address": flag(value.contains("@")),
        "assigned": flag(word.rlike(_CUE + "[A-Za-z_]*[=:]")),
        "cue_before": flag(before.rlike(_CUE)),
        "cue_after": flag(after.rlike(_CUE)),
    }


def _suspect(word: Column, before: Column) -> Column:
    shaped = word.rlike("[0-9]|[A-Z]{16}") | word.rlike(_CUE + "[A-Za-z_]*[=:][^ ]{6,}") | word.startswith(_BEGIN)
    # The words before are read for the few that have capitals inside.
    handed = word.rlike("[a-z][A-Z].*[a-z][A-Z]") & before.rlike(_HANDED)
    return (F.length(word) >= SHORTEST) & (shaped | handed)


def suspects(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, place, word, value, before and after of every suspect word of a text.

    `place` is the word's number in its text, `before` the three words before it, `after` the
    two behind it. A null or empty text has none.
    """
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.split(F.coalesce("text", F.lit("")), _BLANK).alias("words"),
    )
    word = lambda i: F.get("words", i)
    earlier = lambda i: F.concat_ws(" ", *(word(i - k) for k in (3, 2, 1)))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _suspect(word(i), earlier(i)))
    found = split.select("doc_id", "text_hash", "words", F.explode(places).alias("place"))
    place = F.col("place")
    after = F.concat_ws(" ", word(place + 1), word(place + 2))
    beside = (earlier(place).alias("before"), after.alias("after"))
    named = found.select("doc_id", "text_hash", "place", word(place).alias("word"), *beside)
    return named.withColumn("value", F.regexp_extract("word", _VALUE, 1)).where(F.length("value") >= SHORTEST)


def findings(suspect_words: DataFrame, dictionary: list[str]) -> DataFrame:
    """The suspect words with a column for each of FEATURES."""
    return suspect_words.withColumns(_features(*map(F.col, ("value", "word", "before", "after")), dictionary))


def corpus_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest lower-case words of letters only over all documents; ties by the word."""
    pieces = F.filter(F.split(F.lower(F.col("text")), _BLANK), lambda w: F.length(w).between(3, 16) & w.rlike("^\\p{L}+$"))
    counted = docs.select(F.explode(pieces).alias("word")).groupBy("word").count()
    return [r[0] for r in counted.orderBy(F.desc("count"), "word").limit(words).collect()]


def label() -> Column:
    """1 for a format that issuers use, the beginning of a private key, or an unguessable value
    given to a cue, which may be of letters with capitals inside; 0 for shapes of harmless
    things; null where neither is plain."""
    value = F.col("value")
    begun = value.startswith(_BEGIN) & F.col("after").rlike("(?i)private")
    letters = value.rlike(_LETTERS) & (F.col("before").rlike(_HANDED) | (F.col("assigned") == 1))
    issued = reduce(lambda a, b: a | b, (value.rlike(p) for p in _ISSUED))
    given = ((F.col("assigned") == 1) | (F.col("cue_before") == 1)) & value.rlike("^[A-Za-z0-9+/_=-]{12,}$")
    mixed = (F.col("digits") > 0.1) & (F.col("digits") < 1) & (F.col("transitions") > 0.15)
    harmless = reduce(lambda a, b: a | b, (value.rlike(p) for p in _HARMLESS))
    return F.when(issued | begun | letters | (given & mixed), F.lit(1.0)).when(harmless | (F.col("dictionary") > 0.6), F.lit(0.0))


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """The forest over rows of FEATURES and `label`; None unless both labels occur.

    Equal vectors are one row that weighs as many as there are; at most FIT_ROWS distinct vectors
    of each label are used, in an order by hash, and a label weighs FIT_ROWS at most in all.
    """
    vectors = stage_table(labelled.groupBy(*FEATURES, "label").agg(F.count("*").alias("rows")), "findings-distinct")
    mark, parts = F.xxhash64(*FEATURES), []
    for v in (0.0, 1.0):
        part = vectors.where(F.col("label") == v).orderBy(mark, *FEATURES).limit(FIT_ROWS)
        total = vectors.where(F.col("label") == v).agg(F.sum("rows")).first()[0] or 0
        if not total:
            return None
        parts.append(part.withColumn("weight", F.col("rows") * min(1.0, FIT_ROWS / total)))
    sample = stage_table(parts[0].unionByName(parts[1]).coalesce(1), "findings")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, weightCol="weight", bootstrap=False, seed=7, maxBins=64)
    return forest.fit(vectors.select("features", "label", "weight"))


def _tree(node) -> Column:
    """A tree as nested conditions; leaves are the share of label 1."""
    if node.subtreeDepth() == 0:
        zero, one = list(node.impurityStats().stats())[:2]
        return F.lit(float(one) / (zero + one))
    split = node.split()
    test = F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild())).otherwise(_tree(node.rightChild()))


def probability(model: RandomForestClassificationModel | None) -> Column:
    """The forest's mean share of label 1 over the columns of FEATURES; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    trees = [_tree(t._java_obj.rootNode()) for t in model.trees]
    return reduce(add, trees) / len(trees)


def _scored(docs: DataFrame) -> DataFrame:
    """All findings with their features and score; the features are stored once."""
    found = stage_table(findings(suspects(docs), corpus_dictionary(docs)), "findings")
    model = train(found.withColumn("label", label()).where("label is not null"))
    return found.withColumn("score", probability(model))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, place, value, score and is_secret of every finding, those removed included.

    `place` is the number of the word in its text, from 0. Texts that are null or empty have
    no findings. Repeated rows are scanned as they are. Only doc_id and text are read.
    """
    scored = _scored(docs).select("doc_id", "place", "value", "score")
    return scored.withColumn("is_secret", F.col("score") >= SECRET_FROM)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret of a text replaced by MASK; all columns and rows stay."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    secrets = _scored(docs).where(F.col("score") >= SECRET_FROM)
    # Longer values first, so that one inside another doesn't break it.
    value = F.struct((-F.length("value")).alias("n"), F.col("value").alias("v"))
    by_text = secrets.groupBy(number.alias("__number"), F.col("text_hash").alias("__hash"))
    listed = by_text.agg(F.array_sort(F.collect_set(value)).alias("__values"))
    keyed = docs.withColumn("__number", number).withColumn("__hash", F.xxhash64("text"))
    joined = keyed.join(listed, ["__number", "__hash"], "left")
    values = F.coalesce("__values", F.array().cast("array<struct<n:int,v:string>>"))
    masked = F.aggregate(values, F.col("text"), lambda text, x: F.replace(text, x["v"], F.lit(MASK)))
    return joined.withColumn("text", masked).select(*docs.columns)
