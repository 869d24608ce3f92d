"""Token counts by the whole-token shortcut.

A byte-pair vocabulary holds tens of thousands of strings, but not each of them is what the merges make of its own
bytes. Which ones are is proved once, on the driver, by running the merges over every vocabulary string; a pre-token equal to a
proven string counts as one token without any merging. Only the other pre-tokens are merged, and each distinct one
once per worker as long as it stays in a memo of bounded size.

Counting is one narrow pass: no shuffle, nothing but the vocabulary (bounded by its file) is shipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import vocab

MEMO_ENTRIES = 1 << 20  # distinct pre-tokens remembered by a worker


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges: the pair of lowest rank first, the leftmost of equals."""
    parts, rank, none = list(symbols), ranks.get, len(ranks)
    pairs = [rank(p, none) for p in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank((parts[i - 1], parts[i]), none)
        if i < len(pairs):
            pairs[i] = rank((parts[i], parts[i + 1]), none)
    return parts


def merged_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens of a long run of symbols in O(n log n): a heap of candidate pairs over a linked list."""
    import heapq

    n = len(symbols)
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
    heapq.heapify(heap)
    count = n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= n or (parts[i], parts[j]) != pair:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j] = pair[0] + pair[1], None
        count -= 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (p := (parts[a], parts[b])) in ranks:
                heapq.heappush(heap, (ranks[p], a, p))
    return count


@lru_cache(maxsize=2)
def proven(file: str) -> tuple[frozenset[str], dict[tuple[str, str], int], tuple[str, ...]]:
    """Texts that are one token by themselves, merge ranks, and strings of added tokens."""
    letters = vocab.byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    words, merges, added = vocab.read_json(file)
    ranks = {pair: r for r, pair in enumerate(merges)}
    whole = set()
    for word in words:
        if word in added or merged(list(word), ranks) != [word]:
            continue
        try:
            whole.add(bytes(byte_of[c] for c in word).decode())
        except UnicodeDecodeError:
            pass  # part of a character: never a pre-token
    return frozenset(whole), ranks, tuple(added)


class Counter(dict):
    """Pre-token -> number of tokens; proven whole tokens are entered beforehand, the rest is merged when first met."""

    def __init__(self, whole: frozenset[str], ranks: dict, added: tuple[str, ...], pattern: str = vocab.PATTERN) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self._whole, self._ranks, self._letters = whole, ranks, vocab.byte_letters()
        self._pretokens = regex.compile(pattern)
        self._added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, pretoken: str) -> int:
        symbols = [self._letters[b] for b in pretoken.encode()]
        n = len(merged(symbols, self._ranks)) if len(symbols) < 64 else merged_long(symbols, self._ranks)
        if len(pretoken) <= 64:  # long ones hardly come again
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > len(self._whole) + MEMO_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(self._whole, 1))
        n, parts = 0, (text,)
        if self._added is not None and self._added.search(text):
            parts = self._added.split(text)
            n = len(parts) - 1
        find, get = self._pretokens.findall, self.__getitem__
        return n + sum(sum(map(get, find(part))) for part in parts)


_counters: dict[str, Counter] = {}


def token_counts(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` of the whole text and ``over_limit`` (``n_tokens > limit``).

    A null text counts as empty: 0 bytes, 0 tokens. Rows are counted one by one, so repeated ids or texts give repeated rows and a
    null id stays null; an empty table gives an empty result. Only the two named columns are read; others may have any name.
    """
    facts = df.sparkSession.sparkContext.broadcast(proven(tokenizer))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer)
        if counter is None:
            counter = _counters[tokenizer] = Counter(*facts.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
