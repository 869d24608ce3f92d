"""Ranked lexical search without an index over the documents: an automaton of all query terms reads the texts.

The terms of the items form an Aho-Corasick automaton; each term is guarded by a blank on either side, and a text is read with a blank in place
of every character that is not part of a term, so the automaton finds whole terms only. What it puts out is a term's number, and a table maps
numbers to the items that hold the term. One pass over the documents yields, per document, its length and how often it holds which terms, and
per batch the sums from which the corpus statistics follow. A second pass over those few numbers scores and keeps the best rows per item and task.

Items are taken in blocks whose terms have a bounded size, each block a pass over the documents; only a block is broadcast.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.session import checkpoint

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 1 << 20  # terms of the items that are looked for in one pass
TABLE_ENTRIES = 1 << 21  # terms x items of a table of weights
MATRIX_ENTRIES = 1 << 20  # documents x items scored at a time
SPREAD = 256  # parts in which an item's best rows of all tasks are merged first

#: What a text is read as, byte by byte of its UTF-8: terms in lower case, everything else blank.
_READ = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read(text: bytes) -> bytes:
    return b" " + text.translate(_READ) + b" "


def length(text: bytes) -> int:
    """Number of terms of a text that was ``read``."""
    inside = np.frombuffer(text, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, repeats) of the items; rows with one id are one item, null texts have no terms."""
    terms = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = items.select(F.col(item_col).alias("item"), F.explode(terms).alias("term"))
    return rows.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _blocks(terms: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """Rows of (item, term, repeats), all of an item together, in blocks of about ``block_bytes``."""
    total = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = -(-total // block_bytes)
    for block in range(n):
        part = terms if n == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block)
        if rows := part.collect():  # bounded by block_bytes
            yield rows


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(shipped: _Shipped) -> ahocorasick.Automaton:
    """The automaton of the shipped terms, built once per worker."""
    if shipped.id not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for k, term in enumerate(shipped.value):
            found.add_word(f" {term.encode().decode('latin-1')} ", k)
        found.make_automaton()
        _automata[shipped.id] = found
    return _automata[shipped.id]


class _Shipped:
    """A broadcast value with a name by which workers keep what they make of it."""

    def __init__(self, spark: SparkSession, value: list) -> None:
        self._value = spark.sparkContext.broadcast(value)  # a block's terms
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> list:
        return self._value.value


def _hits(shipped: _Shipped):
    names = ["id", "n", "terms", "tf", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shipped)
        for batch in batches:
            rows, n, terms, tf = [], [], [], []
            holding: Counter = Counter()
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or not (size := length(seen := read(text))):
                    continue
                found = Counter(map(itemgetter(1), automaton.iter(seen.decode("latin-1"))))
                holding.update(found.keys())
                rows.append(row)
                n.append(size)
                terms.append(list(found.keys()))
                tf.append(list(found.values()))
            # what the batch adds to the corpus statistics: terms and documents, and the documents that hold each term
            ids = pa.concat_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.nulls(1, batch.column(0).type)])
            cols = [ids, pa.array([*n, sum(n)], pa.int64()), pa.array([*terms, list(holding.keys())], pa.list_(pa.int32())), pa.array([*tf, list(holding.values())], pa.list_(pa.int32()))]
            cols.append(pa.array([*[None] * len(rows), len(rows)], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


class Scorer:
    """Scores of a block's items: the terms of each in groups whose table of weights is of bounded size."""

    def __init__(self, n_items: int, term_of: np.ndarray, item_of: np.ndarray, weights: np.ndarray, k: int) -> None:
        self._n_terms, self.k = int(term_of.max()) + 1, k
        order = np.argsort(item_of, kind="stable")
        self._term, self._item, self._weight = term_of[order], item_of[order], weights[order]
        self.groups: list[tuple[int, int, int, int]] = []  # first and end of the items and of their entries
        ends = np.searchsorted(self._item, np.arange(n_items + 1))
        first = 0
        for item in range(n_items):
            terms = int(ends[item + 1] - ends[first])
            if item > first and terms * (item + 1 - first) > TABLE_ENTRIES:
                self.groups.append((first, item, int(ends[first]), int(ends[item])))
                first = item
        self.groups.append((first, n_items, int(ends[first]), int(ends[n_items])))
        self.least = np.zeros(n_items, np.int64)  # score of the k-th best row so far

    def best(self, owner: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, document, score) of the k best documents of a batch per item, lower documents first among equals; documents that can no
        longer be among the best are left out. ``owner`` is ascending."""
        for low, high, begin, end in self.groups:
            width = high - low
            column = np.full(self._n_terms, -1, np.int64)
            here, column_of = np.unique(self._term[begin:end], return_inverse=True)
            column[here] = np.arange(len(here))
            table = np.zeros((len(here), width), np.int64)
            table[column_of, self._item[begin:end] - low] = self._weight[begin:end]
            at = column[terms]
            used = np.flatnonzero(at >= 0)
            at, part, doc = at[used], parts[used], owner[used]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            ends = np.append(first[1:], len(doc))
            held = [np.empty(0, np.int64)] * 3
            i = 0
            while i < len(first):  # whole documents, at least one
                j = max(i + 1, int(np.searchsorted(ends, first[i] + MATRIX_ENTRIES // width, "right")))
                span = slice(first[i], ends[j - 1])
                scores = np.add.reduceat(table[at[span]] * part[span, None], first[i:j] - first[i], axis=0)
                row, item = np.nonzero((scores > 0) & (scores >= self.least[low:high]))
                held = [np.concatenate(x) for x in zip(held, (item + low, doc[first[i + row]], scores[row, item]))]
                if len(held[0]) > MATRIX_ENTRIES:
                    held = self._top(*held)
                i = j
            yield self._top(*held)

    def _top(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        return [x[place < self.k] for x in (item, doc, score)]


def _best(shipped, names: list, kinds: list[pa.DataType], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of, item_of, weights, n_docs, n_terms = shipped.value
        scorer = Scorer(len(names), term_of, item_of, weights, k)
        best: list[list[tuple]] = [[] for _ in names]
        for batch in batches:
            # documents in order of their ids, so that of equal scores the smaller id comes first
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_end"))
            size = np.diff(batch.column(2).offsets.to_numpy())
            terms = batch.column(2).flatten().to_numpy()
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            parts = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
            for items, docs, scores in scorer.best(owner, terms, parts):
                ids = batch.column(0).take(pa.array(docs)).to_pylist()
                for item, doc, score in zip(items.tolist(), ids, scores.tolist()):
                    best[item].append((-score, doc is None, doc))
                for item in set(items.tolist()):
                    best[item] = sorted(best[item])[:k]
                    if len(best[item]) == k:
                        scorer.least[item] = -best[item][-1][0]
        rows = [(item, *row) for item, found in enumerate(best) for row in found]
        cols = [pa.array([names[r[0]] for r in rows], kinds[0]), pa.array([r[3] for r in rows], kinds[1]), pa.array([-r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["item", "doc", "score"])

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: the item's id, ``rank`` from 1, the document's id and ``score``, an integer.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. With N documents that have a term, L terms in them, n terms in a
    document and df documents that hold a term, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 25 + 75 n N div L, and
    each occurrence of a term in the item adds w (10^9 tf div (1000 tf + 8 m)). Rows with a score above 0 are ranked by score and ascending id, null ids last.

    Null and empty texts have no terms: such documents are not found and not counted, such items find nothing. Very long texts are read whole. Each of several
    rows with one document id is a document of its own; rows with one item id are one item. Empty tables give an empty result. Other columns are
    not read.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType, items.schema[item_col].dataType]
    types = [to_arrow_type(x) for x in kinds]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"item {kinds[1].simpleString()}, doc {kinds[0].simpleString()}, score bigint"
    out = spark.createDataFrame([], schema)
    for block in _blocks(checkpoint(item_terms(items, item_col, item_text_col)), block_bytes):
        terms = sorted({r.term for r in block})
        names = list(dict.fromkeys(r["item"] for r in block))
        hit_schema = f"id {kinds[0].simpleString()}, n bigint, terms array<int>, tf array<int>, n_docs bigint"
        hits = checkpoint(source.mapInArrow(_hits(_Shipped(spark, terms)), hit_schema))
        sums = hits.where("n_docs is not null")
        total = sums.agg(F.sum("n_docs").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        df = sums.select(F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy("x.terms").agg(F.sum("x.tf").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1)))
        w = {r.terms: r.w for r in df.select("terms", weight.alias("w")).collect()}  # bounded by block_bytes
        number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
        known = [(number[r.term], place[r["item"]], r.repeats * w.get(number[r.term], 0)) for r in block]
        value = (*(np.array(x, np.int64) for x in zip(*known)), total.docs, total.terms)
        shipped = spark.sparkContext.broadcast(value)  # bounded by block_bytes
        found = hits.where("n_docs is null and size(terms) > 0").select("id", "n", "terms", "tf")
        out = out.union(found.mapInArrow(_best(shipped, names, [types[1], types[0]], k), schema))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = F.pmod(F.spark_partition_id(), F.lit(SPREAD))
    few = out.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def sql(k: int = 10) -> str:
    """The same over ``documents`` and ``benchmark`` for DuckDB."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term"
    return f"""
        WITH words AS (SELECT doc_id, {terms} FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), corpus),
        sizes AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM lengths, corpus),
        wanted AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {terms} FROM benchmark) GROUP BY item_id, term),
        scores AS (
            SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS "rank", doc_id, score
            FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE "rank" <= {k}"""
