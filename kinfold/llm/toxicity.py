"""Toxicity classifier with a counterfactual penalty.

A document's features are its words and their character five-grams, a word being padded at both ends. Which of them matter is counted over
all labelled training documents; a logistic model over the chosen ones is fitted to a bounded sample of distinct texts, each with its numbers of
clean and toxic documents as weights. For each sampled text
that names a group (a religion, an origin, a gender, ...) the same text with the names swapped for others of their kind is scored too, and
the squared change of the score enters the loss: what a group is called then cannot carry weight, and neutral mentions are not held against a text.

Counting and scoring are narrow passes over the documents; only counts of features are shuffled, summed per task before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import checkpoint

GRAM = 5
FEATURES = 4096  # of the model at most
EVIDENCE = 3.5  # root of the likelihood ratio that a feature must show
SAMPLE = 20_000  # distinct labelled texts the model is fitted to at most
BROADCAST_LABELS = 1 << 19  # label rows up to which they are broadcast (about 60 MB as Spark holds them); more are joined by shuffle
MEMO_WORDS = 1 << 19
THRESHOLD = 0.3

#: Names of groups, by kind; a name is swapped for the next of its kind.
GROUPS = (
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian latino african european arab indian",
    "blacks whites asians latinos africans europeans arabs indians",
    "gay straight lesbian bisexual heterosexual transgender",
    "woman man",
    "women men",
    "girl boy",
    "girls boys",
    "female male",
    "immigrant native refugee citizen",
    "immigrants natives refugees citizens",
    "old young",
    "disabled deaf blind",
    "muslime christen juden hindus",
    "frauen männer",
    "musulmans chrétiens juifs hindous",
    "femmes hommes",
    "musulmanes cristianos judíos hindúes",
    "mujeres hombres",
)
SWAP = {a: b for kind in GROUPS for names in [kind.split()] for a, b in zip(names, names[1:] + names[:1])}

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_word.findall((text or "").lower()))


def grams(word: str) -> list[str]:
    """The word itself and its five-grams."""
    padded = f"<{word}>"
    return [f"={word}", *(padded[k : k + GRAM] for k in range(max(1, len(padded) - GRAM + 1)))]


def grams_of(words: set[str]) -> set[str]:
    return {g for w in words for g in grams(w)}


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """Texts with their label; of several labels of a document the highest counts, null labels and ids do not."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    known = checkpoint(known.groupBy(F.col(label_id).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *_digest(text)).join(known, "id")


def _digest(text: Column) -> list[Column]:
    """128 bits ``h1``, ``h2`` that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(k), text).alias(f"h{k}") for k in (1, 2)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per feature, summed over stretches of a task; the empty name counts all documents."""
    classes: tuple[Counter, Counter] = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(classes[0].keys() | classes[1].keys())
        cols = [pa.array(names, pa.string()), *[pa.array([c[g] for g in names], pa.int64()) for c in classes]]
        for c in classes:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, ["gram", "clean", "toxic"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one = classes[int(y > 0)]
            one.update(grams_of(words_of(text)))
            one[""] += 1
        if len(classes[0]) + len(classes[1]) > 1 << 19:
            yield flush()
    yield flush()


def _sampled(batches: Iterator[pa.RecordBatch], features: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Features of each distinct text of a task and, where it names groups, of the text with the names swapped."""
    seen: set[tuple[int, int]] = set()  # bounded by the sample
    for batch in batches:
        keys, own, other = [], [], []
        for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            words = words_of(text)
            own.append(sorted(features[g] for g in grams_of(words) & features.keys()))
            named = words & SWAP.keys()
            swapped = {SWAP.get(w, w) for w in words}
            other.append(sorted(features[g] for g in grams_of(swapped) & features.keys()) if named else None)
            keys.append(key)
        kind = pa.list_(pa.int32())
        cols = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(own, kind), pa.array(other, kind)], ["h1", "h2", "own", "other"])


def _chosen(texts: DataFrame, sample: int) -> list[tuple[int, int, float, float]]:
    """(h1, h2, clean, toxic) of at most ``sample`` distinct texts, with the numbers of labelled documents each stands for.

    Priority sampling: a text's rank is its number of documents divided by its digest as a fraction, and texts that have fewer documents than the
    first rank left out stand for that many. The sums over all documents stay right in expectation, a frequent text is taken once and with its own
    weight, and texts without copies are those of the lowest digests.
    """
    one = texts.groupBy("h1", "h2").agg(F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("clean"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("toxic"))
    part = (F.pmod("h1", F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    ranked = one.withColumn("rank", (F.col("clean") + F.col("toxic")) / part)
    rows = ranked.orderBy(F.desc("rank"), "h1", "h2").limit(sample + 1).collect()  # bounded by ``sample``
    least = rows[sample].rank if len(rows) > sample else 0.0
    grown = [max(1.0, least / (r.clean + r.toxic)) for r in rows[:sample]]
    return [(r.h1, r.h2, r.clean * g, r.toxic * g) for r, g in zip(rows, grown)]


def _solve(clean: np.ndarray, toxic: np.ndarray, own: list, other: list, n: int, penalty: float, l2: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss + penalty * mean squared score change + l2 * squared weights (Adam on all rows).

    Both means are over documents: a row counts as often as it has ``clean`` and ``toxic`` ones."""

    def flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(r) for r in rows], np.int64)
        return np.repeat(np.arange(len(rows)), size), np.fromiter((f for r in rows for f in r), np.int64, int(size.sum()))

    pairs = [k for k, r in enumerate(other) if r is not None]
    rows, cols = flat(own)
    # the score change depends on the features that differ only
    more, more_cols = flat([set(other[k]) - set(own[k]) for k in pairs])
    less, less_cols = flat([set(own[k]) - set(other[k]) for k in pairs])
    count, total = clean + toxic, (clean + toxic).sum()
    paired = count[pairs] / max(count[pairs].sum(), 1)
    w = np.zeros(n + 1)
    rate = (toxic.sum() + 0.5) / (total + 1)
    w[n] = np.log(rate / (1 - rate))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        score = np.bincount(rows, w[cols], len(count)) + w[n]
        error = (count / (1 + np.exp(-score)) - toxic) / total
        g = np.zeros(n + 1)
        g[:n] = np.bincount(cols, error[rows], n) + 2 * l2 * w[:n]
        g[n] = error.sum()
        if pairs and penalty:
            change = np.bincount(more, w[more_cols], len(pairs)) - np.bincount(less, w[less_cols], len(pairs))
            pull = 2 * penalty * change * paired
            g[:n] += np.bincount(more_cols, pull[more], n) - np.bincount(less_cols, pull[less], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:n], float(w[n])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    penalty: float = 1.0,
    l2: float = 1e-5,
) -> Model:
    """Fit a model to the labelled documents; which they are is the caller's choice of ``labels``.

    Features are counted over all of them, weights fitted to at most ``sample`` of their distinct texts (``_chosen``). Without labelled
    documents, or with those of one class only, the model has no features and its bias is that of the smoothed share of toxic ones, a tenth
    without any: what nobody has called toxic is not rejected.
    """
    texts = _labelled(docs, labels, id_col, text_col, label_id, label_col)
    counted = texts.select("text", "y").mapInArrow(_counts, "gram string, clean bigint, toxic bigint")
    counts = checkpoint(counted.groupBy("gram").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a")))
    total = counts.where("gram = ''").first()
    clean, toxic = (total.b, total.a) if total else (0, 0)
    if not clean or not toxic:
        rate = (toxic + 0.1) / (clean + toxic + 1)
        return Model((), (), float(np.log(rate / (1 - rate))))
    a, b, seen = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    share = toxic / (clean + toxic)
    term = lambda got, want: F.when(got > 0, got * F.log(got / want)).otherwise(0.0)
    rest = term(F.lit(toxic) - a, (toxic + clean - seen) * share) + term(F.lit(clean) - b, (toxic + clean - seen) * (1 - share))
    evidence = 2 * (term(a, seen * share) + term(b, seen * (1 - share)) + rest)
    chosen = counts.where("gram != ''").select("gram", evidence.alias("g")).where(F.col("g") >= EVIDENCE**2)
    features = [r.gram for r in chosen.orderBy(F.desc("g"), "gram").limit(FEATURES).collect()]  # bounded by FEATURES
    index = {g: k for k, g in enumerate(features)}
    drawn = _chosen(texts, sample)
    keys = F.broadcast(docs.sparkSession.createDataFrame([d[:2] for d in drawn], "h1 bigint, h2 bigint"))  # bounded by ``sample``
    taken = docs.select(*_digest(F.col(text_col)), F.col(text_col).alias("text")).join(keys, ["h1", "h2"], "left_semi")
    rows = taken.mapInArrow(lambda it: _sampled(it, index), "h1 bigint, h2 bigint, own array<int>, other array<int>").dropDuplicates(["h1", "h2"])
    found = {(r.h1, r.h2): r for r in rows.collect()}  # bounded by ``sample``
    rows = [found[d[:2]] for d in drawn]
    clean, toxic = (np.array([d[k] for d in drawn], float) for k in (2, 3))
    weights, bias = _solve(clean, toxic, [r.own for r in rows], [r.other for r in rows], len(features), penalty, l2)
    return Model(tuple(features), tuple(weights.tolist()), bias)


class Scorer(dict):
    """Word -> its features in the model, remembered up to a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self._index = {g: k for k, g in enumerate(model.features)}
        self._weights, self._bias = model.weights, model.bias

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(k for g in grams(word) if (k := self._index.get(g)) is not None)
        self[word] = found
        return found

    def score(self, text: str | None) -> float:
        if len(self) > MEMO_WORDS:
            self.clear()
        found: set[int] = set()
        for features in map(self.__getitem__, words_of(text)):
            if features:
                found.update(features)
        logit = self._bias + sum(self._weights[k] for k in sorted(found))
        return float(1 / (1 + np.exp(-logit)))


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column: the score of each text, between 0 and 1. Null and empty texts get that of the bias alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(shipped.value)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shipped.value)
        one = _scorers[key].score
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return scored(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: CRC-32 of the id as text leaves 2 when divided by 4. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on), the model being fitted to the labels of rows
    that are not held out.

    Equal texts have equal scores, whatever the other columns hold. Rows with a null id are scored but never learned from. Repeated rows
    give repeated rows. An empty table gives an empty result.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, id_col, label_col)
    out = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), score(docs, model, text_col).alias("score"))
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; the model is that of ``toxicity``."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, id_col, label_col)
    return docs.where(score(docs, model, text_col) < threshold)
