"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as its letters in lower case, every run of other characters being one blank. All its runs of one to four characters are
hashed to a fixed number of buckets. Training counts the buckets per language, in numpy, one vector per language and task, and Spark sums
the counts. The table of log-probabilities (languages x buckets, its size is checked) is broadcast; a batch of texts is scored by looking
up the buckets of all its texts at once and adding up what belongs to one text.

Log-probabilities are whole multiples of 2^-20, so their sums are exact: a text's score depends on nothing but the text and the model, not on
the batch, the task or the place at which a long text is cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.toxicity import held_out

LENGTHS = (1, 2, 3, 4)  # of the n-grams
BITS = 17  # buckets: 2^17
SMOOTHING = 0.5  # added to every count
UNIT = 1 << 20  # log-probabilities are multiples of 1 / UNIT
PIECE = 1 << 19  # characters looked at together
MODEL_ENTRIES = 1 << 26  # languages x buckets that may be broadcast (256 MB)
KEPT_LANGS = 32  # count vectors a task holds at a time
UNKNOWN = "und"
BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's letter in lower case; a blank for what is no letter."""
    out = np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(text: str, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a text with single blanks between, and which characters they come from; ``before`` is the character it follows."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    last = np.concatenate([np.array([before], np.uint32), codes[:-1]]) if len(codes) else codes
    kept = np.flatnonzero((codes != BLANK) | (last != BLANK))
    return codes[kept], kept


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts as pieces of bounded size: characters, the text each belongs to, and how many at the start were counted before.

    Short texts share a piece, each followed by a blank; a long one is cut, and each cut takes along the characters that an n-gram across
    it needs.
    """
    group: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, int]:
        codes, kept = _codes("".join(texts[k] + " " for k in group), BLANK)
        owner = np.repeat(np.array(group, np.int64), [len(texts[k]) + 1 for k in group])
        blank = np.array([BLANK], np.uint32), np.array([-1], np.int64)
        return np.concatenate([blank[0], codes]), np.concatenate([blank[1], owner[kept]]), 1

    for k, text in enumerate(texts):
        if len(text) > PIECE:
            tail = np.array([BLANK], np.uint32)
            for at in range(0, len(text) + 1, PIECE):
                cut = text[at : at + PIECE] + (" " if at + PIECE > len(text) else "")
                codes = np.concatenate([tail, _codes(cut, int(tail[-1]))[0]])
                yield codes, np.full(len(codes), k, np.int64), len(tail)
                tail = codes[-max(LENGTHS) :]
            continue
        if group and size + len(text) > PIECE:
            yield joined()
            group, size = [], 0
        group.append(k)
        size += len(text) + 1
    if group:
        yield joined()


def _buckets(codes: np.ndarray, owner: np.ndarray, before: int, bits: int) -> np.ndarray:
    """Per length and end, the bucket of the n-gram; the one after the last bucket where there is none."""
    none = 1 << bits
    out = np.full((len(LENGTHS), len(codes)), none, np.int32)
    grown = codes * np.uint32(0x9E3779B1)
    for row, n in enumerate(LENGTHS):
        if n > len(codes):
            break
        if n > 1:  # one character more at the front
            grown = (grown[1:] ^ (grown[1:] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[: len(codes) - n + 1]
        found = ((grown ^ (grown >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)
        ends = slice(n - 1, None)
        # all but the first character, which may be the blank before the text, are of one text
        whole = codes != BLANK if n == 1 else owner[1 : len(codes) - n + 2] == owner[ends]
        out[row, ends] = np.where(whole, found.astype(np.int32), none)
    out[:, :before] = none
    return out


@dataclass(frozen=True)
class Model:
    """Languages in order of their names; ``weights`` in units of 1 / UNIT, one row per language, the last column being 0."""

    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray
    bits: int

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights per text and language, and the number of n-grams of each text."""
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        grams = np.zeros(len(texts), np.int64)
        for codes, owner, before in _pieces(texts):
            buckets = _buckets(codes, owner, before, self.bits)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            first = first[owner[first] >= 0]
            if not len(first):
                continue
            rows = owner[first]
            grams[rows] += np.add.reduceat((buckets < 1 << self.bits).sum(axis=0), first)
            for k, row in enumerate(self.weights):
                total[k, rows] += np.add.reduceat(row.take(buckets).sum(axis=0, dtype=np.int64), first)
        return total, grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; ``und`` and 0 without a letter or without a language."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, grams = self.sums([t or "" for t in texts])
        logit = total / UNIT + self.prior[:, None]
        best = logit.argmax(axis=0)
        sure = 1 / np.exp(logit - logit.max(axis=0)).sum(axis=0)
        known = grams > 0
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, sure, 0.0)


def _counts(bits: int):
    """Per language, the texts with a letter (bucket -1) and the n-grams of each bucket, summed over stretches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        n_texts: dict[str, int] = defaultdict(int)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                where = np.flatnonzero(counts)
                buckets = np.concatenate([[-1], where])
                values = np.concatenate([[n_texts[lang]], counts[where]])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets)), pa.array(buckets, pa.int32()), pa.array(values, pa.int64())], ["lang", "bucket", "n"])
            held.clear()
            n_texts.clear()

        for batch in batches:
            by: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[lang].append(text)
            for lang, texts in by.items():
                counts = held.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                with_letters = set()
                for codes, owner, before in _pieces(texts):
                    counts += np.bincount(_buckets(codes, owner, before, bits).ravel(), minlength=len(counts))
                    with_letters.update(np.unique(owner[codes != BLANK]).tolist())
                counts[-1] = 0
                n_texts[lang] += len(with_letters)
                if len(held) > KEPT_LANGS:
                    yield from flush()
        yield from flush()

    return run


def fit(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS, smoothing: float = SMOOTHING) -> Model:
    """A model of all rows with a language and a text; which rows may be learned from is the caller's choice.

    Counts cover every such row. A language without any letter in its texts is not learned. Too many languages for a broadcast of
    MODEL_ENTRIES weights raise ValueError: fewer ``bits`` then do.
    """
    rows = texts.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counts(bits), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row per language: its texts, and its counts in order of the buckets
    vectors = counted.where("n > 0").groupBy("lang").agg(
        F.max(F.when(F.col("bucket") < 0, F.col("n"))).alias("texts"),
        F.sort_array(F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "n")))).alias("found"),  # bounded by the buckets
    ).where("texts > 0")
    vectors = vectors.select("lang", "texts", "found.bucket", "found.n").orderBy("lang")
    most = MODEL_ENTRIES >> bits
    found = vectors.limit(most + 1).toArrow()  # bounded by ``most`` languages of 2^bits counts
    langs = found.column("lang").to_pylist()
    if len(langs) > most:
        raise ValueError(f"over {most} languages of 2^{bits} buckets: fewer bits are needed")
    weights = np.zeros((len(langs), (1 << bits) + 1), np.int32)
    for k in range(len(langs)):
        counts = np.full(1 << bits, smoothing)
        counts[found.column("bucket")[k].values.to_numpy()] += found.column("n")[k].values.to_numpy()
        weights[k, :-1] = np.rint(np.log(counts / counts.sum()) * UNIT)
    n = np.array(found.column("texts").to_pylist(), float)
    return Model(tuple(langs), np.log(n / n.sum()) if len(n) else n, weights, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score``, in one narrow pass over the texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = shipped.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """Per row: the id, ``held_out``, ``lang_pred`` and ``score``, the model being fitted to the rows that are not held out.

    ``lang_pred`` is a language of the training rows, the first by name of equally likely ones, and ``score`` its posterior probability;
    null, empty and letterless texts give ``und`` and 0, and so does everything if no training row has a language and a letter. Texts of any
    length are read whole, in pieces of bounded size. Rows with a null id are predicted but not learned from. Equal texts have equal
    results; repeated rows give repeated rows; an empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs.where(~held_out(id_col) & F.col(id_col).isNotNull()), lang_col, text_col, bits)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
