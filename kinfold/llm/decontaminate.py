"""Documents that contain a benchmark item up to small edits.

Items and documents are sequences of words; an item of n words is found in a document if some stretch of the document is at most
``floor((1 - similarity) * n)`` word insertions, deletions and replacements away from it.

Candidates come from the random walk of Chakraborty, Goldenberg and Koucký: a walk reads the word it stands on and, by a random bit of
the step and the word, stays or moves on, so that after an edit two walks soon fall into step again and edit distance becomes Hamming distance.
Walks over windows as long as the items of a length class start at a word of the item and at the same word of a document;
sampled places of the two walks are compared, with another starting word, fresh bits and other samples in each repeat, until the chance to miss an
item is small. Starting words are taken from the rarer ones of the item's first half, so few places of a document start a walk, and a walk
is dropped at the first sample where no item has its word, which is what makes many repeats cheap. Candidates are verified by exact edit
distance.

Documents are scanned once and never shuffled. Items travel to the executors in blocks of bounded text and number, one scan per block. A worker's
tables grow with the words and with the number of the items of a block, not with their product: the bits of a step are computed from numbers of the step
and the word, the words of an item are sorted keys, and which words some item has at a sample is a filter of a few places per item.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII white space and punctuation separate words.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
#: Scripts written without blanks (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han): each of their characters is a word.
UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
SEGMENT = 1 << 19  # words scanned at once
BLOCK_BYTES = 16 << 20  # item text shipped at once
BLOCK_ITEMS = 1 << 17  # items shipped at once
CELLS = 1 << 20  # words looked at together when candidates are sifted
RATIO = 1.5  # longest to shortest item of a length class


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    min_words: int = 8  # shorter items must be found as they are
    exact_words: int = 2  # still shorter ones are no passage
    repeats: int = 24
    samples: int = 3
    seed: int = 11


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return text.encode().translate(TO_SPACE).split()


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text`` and where the stretch ends (bit-parallel, one step per word of text)."""
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, s in enumerate(item.tolist()):
        where[s] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, s in enumerate(text.tolist(), 1):
        eq = where.get(s, 0)
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full  # a stretch may begin anywhere
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class _Class:
    """Walks of items of like length."""

    factors: np.ndarray  # repeat, step: odd numbers; with the number of a word they give whether the walk moves on
    samples: np.ndarray  # repeat, sample: ascending steps, the first being the start
    keys: np.ndarray  # per repeat: sorted keys of the items' sampled words
    owners: np.ndarray  # item and place of its starting word, in the order of the keys
    seen: np.ndarray  # repeat, sample, slot of a word: whether an item may have it there


class _Exact:
    """Short items as exact sequences of words, by a key of all windows of their lengths."""

    _factor = 0x9E3779B97F4A7C15

    def __init__(self, items: dict[int, np.ndarray], n: int) -> None:
        self._by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(x) for x in items.values()}):
            places = np.array([k for k, x in items.items() if len(x) == length])
            rows = np.stack([items[k] for k in places])
            keys = self._keys(rows.ravel(), length)[::length]
            order = np.argsort(keys, kind="stable")
            starts = np.zeros(n, bool)
            starts[rows[:, 0]] = True
            self._by_length[length] = keys[order], places[order], rows[order], starts

    def _keys(self, symbols: np.ndarray, length: int) -> np.ndarray:
        key = np.zeros(max(len(symbols) - length + 1, 0), np.uint64)
        for j in range(length):
            key = key * np.uint64(self._factor) + symbols[j : j + len(key)].astype(np.uint64)
        return key

    def find(self, symbols: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the given items, first word, word after the last) of the first occurrence of each."""
        for length, (keys, places, rows, starts) in self._by_length.items():
            at = np.flatnonzero(starts[symbols[: max(len(symbols) - length + 1, 0)]])
            if not len(at):
                continue
            key = self._keys(symbols, length)[at]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            many = high - low
            which, where = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(at, many)
            same = (symbols[where[:, None] + np.arange(length)] == rows[which]).all(axis=1)
            found, first = np.unique(which[same], return_index=True)
            for k, start in zip(places[found].tolist(), where[same][first].tolist()):
                yield k, start, start + length


class Finder:
    """Finds the given items in texts."""

    def __init__(self, texts: list[str], settings: Settings) -> None:
        self.settings = settings
        self.kept: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[int, np.ndarray] = {}
        parts: list[np.ndarray] = []
        for i, text in enumerate(texts):
            words = words_of(text)
            if len(words) < settings.exact_words:
                continue
            item = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)  # 0: a word of no item
            if len(words) < settings.min_words:
                self.short[i] = item
            else:
                self.kept.append(i)
                parts.append(item)
        n = len(self.vocabulary) + 1
        self.lengths = np.array(list(map(len, parts)), np.int64)
        self.edits = [int((1 - settings.similarity) * x + 1e-9) for x in self.lengths.tolist()]
        self._first = np.concatenate([[0], np.cumsum(self.lengths)])
        self._words = np.concatenate(parts) if parts else np.zeros(0, np.int32)  # of all items, one after the other
        self.items = np.split(self._words, self._first[1:-1]) if parts else []
        self._has = np.unique(np.repeat(np.arange(len(parts)), self.lengths) * n + self._words)  # which words an item has
        self.exact = _Exact(self.short, n)
        self.longest = int(self.lengths.max(initial=0))
        rng = np.random.default_rng(settings.seed)
        self._numbers = rng.integers(0, 1 << 64, n, np.uint64)  # of the words
        spread = np.bincount(self._has % n, minlength=n)
        self.classes: list[_Class] = []
        self.starting = np.zeros(n, bool)
        order = np.argsort(self.lengths, kind="stable")
        while len(order):
            size = int(np.searchsorted(self.lengths[order], self.lengths[order[0]] * RATIO, "right"))
            self.classes.append(self._class(order[:size], spread, rng))
            order = order[size:]
        steps = max((c.factors.shape[1] for c in self.classes), default=0)
        self.margin = 1 + max(steps, self.longest) + 2 * max(self.edits, default=0)

    def _anchors(self, item: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Places in the first half of ``item`` whose words are in the fewest items: half of them, four at least."""
        half = max(4, len(item) // 2)
        places = np.argsort(spread[item[:half]], kind="stable")
        return places[: max(4, half // 2)].astype(np.int32)

    def _moves(self, words: np.ndarray, factor: np.uint64) -> np.ndarray:
        """The random bit of a step for each word."""
        return ((self._numbers[words] * factor) >> np.uint64(63)).astype(np.int64)

    def _slots(self, words: np.ndarray, size: int) -> np.ndarray:
        return (self._numbers[words] & np.uint64(size - 1)).astype(np.int64)

    def _class(self, group: np.ndarray, spread: np.ndarray, rng: np.random.Generator) -> _Class:
        st, n = self.settings, len(self._numbers)
        steps = max(st.samples + 1, int(self.lengths[group[0]]))  # a walk moves on at every other step: it covers half of the shortest item
        factors = rng.integers(0, 1 << 63, (st.repeats, steps), np.uint64) * np.uint64(2) + np.uint64(1)
        samples = np.stack([np.concatenate([[0], 1 + np.sort(rng.choice(steps - 1, st.samples - 1, replace=False))]) for _ in range(st.repeats)])
        size = max(4096, 1 << int(4 * len(group) - 1).bit_length())
        keys, owners = np.zeros((st.repeats, len(group)), np.int64), np.zeros((st.repeats, len(group), 2), np.int32)
        seen = np.zeros((st.repeats, st.samples, size), bool)
        anchors = [self._anchors(self.items[k], spread) for k in group.tolist()]
        many = np.array(list(map(len, anchors)))
        places, offset = np.concatenate(anchors), np.cumsum(many) - many
        first, end = self._first[group], self._first[group + 1]
        for r in range(st.repeats):
            start = places[offset + (rng.random(len(group)) * many).astype(np.int64)]
            at, key, sample = first + start, np.zeros(len(group), np.int64), 0
            for step in range(samples[r][-1] + 1):
                here = np.where(at < end, self._words[np.minimum(at, end - 1)], 0)
                if step == samples[r][sample]:
                    key = key * n + here
                    seen[r, sample, self._slots(here, size)] = True
                    if not sample:
                        self.starting[here] = True
                    sample += 1
                at = at + self._moves(here, factors[r, step])
            by = np.argsort(key, kind="stable")
            keys[r], owners[r] = key[by], np.stack([group[by], start[by]], axis=1)
        return _Class(factors, samples, keys, owners, seen)

    def candidates(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(place of the starting word, item, place where the item would begin) of walks that agree at all samples of some repeat. ``symbols`` are
        those of several texts, each ending at one of ``ends``; behind it a walk reads words of no item."""
        n = len(self._numbers)
        begin = np.flatnonzero(self.starting[symbols])
        first, stop = symbols[begin], ends[np.searchsorted(ends, begin, "right")]
        out = []
        for c in self.classes:
            size = c.seen.shape[2]
            slots = self._slots(first, size)
            for r in range(self.settings.repeats):
                live = np.flatnonzero(c.seen[r, 0][slots])
                who, end = begin[live], stop[live]
                at, key, sample = who, np.zeros(len(who), np.int64), 0
                for step in range(c.samples[r][-1] + 1):
                    here = np.where(at < end, symbols[np.minimum(at, end - 1)], 0)
                    if step == c.samples[r][sample]:
                        live = c.seen[r, sample][self._slots(here, size)]
                        who, at, here, end = who[live], at[live], here[live], end[live]
                        key = key[live] * n + here
                        sample += 1
                    if not len(who):
                        break
                    at = at + self._moves(here, c.factors[r, step])
                if len(who) and sample == self.settings.samples:
                    low, high = np.searchsorted(c.keys[r], key, "left"), np.searchsorted(c.keys[r], key, "right")
                    many = high - low
                    owner = c.owners[r][np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    place = np.repeat(who, many)
                    out.append(np.stack([place, owner[:, 0], place - owner[:, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def _enough(self, symbols: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Pairs around whose start there are, in its text, as many words of the item as it may not lose."""
        if not len(pairs):
            return pairs
        n, edits = len(self._numbers), np.array(self.edits)
        pairs = pairs[np.argsort(self.lengths[pairs[:, 1]], kind="stable")]
        widths = (self.lengths + 2 * edits)[pairs[:, 1]]
        keep, a = [], 0
        while a < len(pairs):
            b = min(len(pairs), a + max(1, CELLS // int(widths[a])))
            b = a + max(1, min(b - a, CELLS // int(widths[b - 1])))
            place, item, start = pairs[a:b].T
            k, which = edits[item][:, None], np.searchsorted(ends, place, "right")
            first, end = np.where(which, ends[which - 1], 0)[:, None], ends[which][:, None]
            where = (start[:, None] - k) + np.arange(widths[b - 1])
            inside = (where < start[:, None] + self.lengths[item][:, None] + k) & (where >= first) & (where < end)
            row, column = np.nonzero(inside)
            word = symbols[where[row, column]]
            key = item[row] * n + word
            found = self._has[np.minimum(np.searchsorted(self._has, key), len(self._has) - 1)] == key
            keep.append(np.bincount(row[found], minlength=b - a) >= self.lengths[item] - k[:, 0])
            a = b
        return pairs[np.concatenate(keep)]

    def symbols(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text: (place in the given items, edits, first word, word after the last) of each item in it, at its best place."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        exact: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.classes and not self.short:
            return exact
        batch, size = [], 0
        for row, text in enumerate(texts):
            s = self.symbols(text)
            if self.short:
                exact[row] = [(k, 0, first, end) for k, first, end in self.exact.find(s)]
            for a in range(0, len(s) if self.classes else 0, SEGMENT):
                batch.append((row, a, s[a : a + SEGMENT + self.margin]))
                size += len(batch[-1][2])
            if size >= SEGMENT:
                self._scan(batch, found)
                batch, size = [], 0
        if batch:
            self._scan(batch, found)
        return [sorted([*((self.kept[k], *hit) for k, hit in hits.items()), *more]) for hits, more in zip(found, exact)]

    def _scan(self, batch: list, found: list) -> None:
        symbols = np.concatenate([s for _, _, s in batch])
        ends = np.cumsum([len(s) for _, _, s in batch])
        firsts = np.concatenate([[0], ends])
        regions: dict[tuple[int, int], list[int]] = defaultdict(list)
        for place, item, start in self._enough(symbols, ends, self.candidates(symbols, ends)).tolist():
            regions[int(np.searchsorted(ends, place, "right")), item].append(start)
        for (piece, item), starts in regions.items():
            row, offset, s = batch[piece]
            want, k = self.items[item], self.edits[item]
            done = -1
            for start in sorted(x - int(firsts[piece]) for x in starts):
                if start <= done:
                    continue  # lies in the stretch that was looked at
                low, high = max(0, start - 2 * k), min(len(s), start + len(want) + 2 * k)
                done = start + k
                edits, end = best_match(want, s[low:high])
                if edits <= k:
                    back, length = best_match(want[::-1], s[low : low + end][::-1])
                    assert back == edits
                    hit = edits, offset + low + end - length, offset + low + end
                    if item not in found[row] or hit < found[row][item]:
                        found[row][item] = hit


_finders: dict[int, Finder] = {}


def _finder(shipped, settings: Settings) -> Finder:
    """The finder of this worker for the shipped items, built once."""
    key = hash((tuple(shipped.value), settings))
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(shipped.value, settings)
    return _finders[key]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` and ``BLOCK_ITEMS`` at most; of rows alike in both columns one."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    n = max(-(-(total.size or 0) // block_bytes), -(-total.n // BLOCK_ITEMS))
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block)
        yield sorted(((r.item, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x))  # bounded by block_bytes and BLOCK_ITEMS


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    settings: Settings = Settings(),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item found in it: the ids, ``edits``, ``similarity`` (1 - edits / words of the item), ``first_word`` and
    ``end_word`` of the best stretch.

    Null and empty texts hold nothing; very long ones are scanned in overlapping segments. Items under ``min_words`` words are found only as they are, and null
    items and those under ``exact_words`` are not looked for. Repeated documents give
    repeated rows; items alike in id and text count once, and two items with one id give two rows. An empty table on either side gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [source.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, similarity double, first_word bigint, end_word bigint"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        shipped = spark.sparkContext.broadcast([t for _, t in block])
        out = out.union(source.mapInArrow(_leaks(shipped, [i for i, _ in block], to_arrow_type(items.schema[item_col].dataType), settings), schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _leaks(shipped, names: list, kind: pa.DataType, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shipped, settings)
        length = {finder.kept[k]: len(x) for k, x in enumerate(finder.items)} | {k: len(x) for k, x in finder.short.items()}
        for batch in batches:
            rows = [(d, *hit) for d, hits in enumerate(finder.find(batch.column(1).to_pylist())) for hit in hits]
            cols = [
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([names[r[1]] for r in rows], kind),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array([1 - r[2] / length[r[1]] for r in rows], pa.float64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "item", "edits", "similarity", "first_word", "end_word"])

    return run


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    settings: Settings = Settings(),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds none of the items (as in ``find_leaks``); null and empty texts stay."""
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast([t for _, t in block]), settings)(F.col(text_col)))
    return docs


def _clean(shipped, settings: Settings):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(shipped, settings)
        for texts in batches:
            yield pd.Series([not hits for hits in finder.find(texts.tolist())], dtype=bool)

    return clean
