"""Bottom-k sketches of word shingles, with DataFrame functions only.

A text's set is that of its shingles of five lower-cased words. The sketch is the k smallest of their 64-bit hashes, sorted. Sketches of parts merge
into that of the whole, and two sketches tell the resemblance of their sets, the containment of one in the other and the number of
distinct shingles. A sketch of fewer than k values is the whole set, and then everything is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.shared import text_key

K = 128
WORDS = 5


def words(text: Column) -> Column:
    """Lower-cased words, separated by ASCII white space."""
    return F.filter(F.split(F.lower(text), "[ \\t-\\r]+", -1), lambda w: w != "")


def sketch(tokens: Column, k: int = K, size: int = WORDS) -> Column:
    """Sketch of an array of words: fewer than ``size`` words are one shingle, none give an empty sketch."""
    n = F.size(tokens)
    shingle = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(size)])
    hashes = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), shingle)).when(n > 0, F.array(F.xxhash64(tokens)))
    none = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_distinct(F.coalesce(hashes, none))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets; with ``F.aggregate`` or repeated grouping it merges any number of parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch found in both sketches, an estimate of intersection over union; two empty sets are alike (1)."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))  # no lambda: it would make the union anew for each value
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second; an empty set lies in any (1)."""
    full = lambda s: F.when(F.size(s) == k, F.element_at(s, -1))
    reach = F.coalesce(F.least(full(a), full(b)), F.lit((1 << 63) - 1))  # below it both sketches know all of their sets
    mine = F.size(F.filter(a, lambda x: x <= reach))
    both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= reach))
    return F.when(F.size(a) == 0, 1.0).when(mine == 0, F.lit(None).cast("double")).otherwise(both / mine)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from how far up the k-th smallest hash lies."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def fingerprint(s: Column) -> Column:
    """The sketch as text: its values, 8 bytes each, in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(df: DataFrame, id_col: str, text_col: str, ranges: int) -> tuple[DataFrame, W]:
    """Rows in ``ranges`` stretches of ascending id, and the window in which each row precedes the next document.

    Bounds are ids that exist, so the first document of a stretch is known by its id; it is copied to the end of the stretch
    before (``guest`` = 1), the very first to the end of the last. No task sees more than its stretch.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = F.percentile_approx("id", shares, 100 * ranges) if shares else F.array().cast("array<bigint>")
    # one row with at most ``ranges`` bounds comes to the driver
    low, nulls, found = docs.agg(F.min("id"), F.count_if(F.col("id").isNull()), cuts).first()
    bounds = sorted({x for x in (found or []) if nulls or x != low})
    # how many bounds are not above the id: first among every ``step``-th of them, then in the block found
    step = max(1, int(len(bounds) ** 0.5))
    listed = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    reached = lambda values: F.size(F.filter(values, lambda v: v <= F.col("id")))
    block = reached(listed(bounds[step - 1 :: step]))
    blocks = F.array(*[listed(bounds[k : k + step - 1]) for k in range(0, len(bounds) + 1, step)])
    home = F.when(F.col("id").isNull(), 0).otherwise(block * step + reached(F.get(blocks, block)))
    opens = F.col("id").isin(bounds) if bounds else F.lit(False)
    first = F.col("id").isNull() if nulls else F.col("id") == low
    place = lambda r, guest: F.struct(r.cast("int").alias("stretch"), F.lit(guest).alias("guest"))
    none = F.array().cast("array<struct<stretch:int,guest:int>>")
    copies = F.concat(
        F.array(place(home, 0)),
        F.when(opens, F.array(place(home - 1, 1))).otherwise(none),
        F.when(first, F.array(place(F.lit(len(bounds)), 2))).otherwise(none),
    )
    rows = docs.select("id", "text", text_key("text").alias("tie"), F.explode(copies).alias("place"))
    rows = rows.select("id", "text", "tie", "place.stretch", "place.guest")
    return rows, W.partitionBy("stretch").orderBy("guest", "id", "tie.a", "tie.b")


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, k: int = K) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    The edited text has the last quarter of its code points (rounded down) replaced by the first as many, or all, of the next document's,
    in ascending id, the first following the last. Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    A null text is an empty one. Null ids come first; rows that share an id are ordered by a digest of the text; a single row is its own next.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    # a few stretches to a task, so that tasks are even
    rows, after = with_next(df, id_col, text_col, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    own = rows.select("*", F.lead("text").over(after).alias("next")).select(
        "id", "tie", "stretch", "guest", "text", n.alias("n_chars"), F.col("next").substr(F.lit(1), F.floor(n / 4).cast("int")).alias("head"), words(F.col("text")).alias("words")
    )
    own = own.select(
        "id",
        "stretch",
        "guest",
        "tie",
        "n_chars",
        F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.coalesce("head", F.lit(""))).alias("edited"),
        sketch(F.col("words"), k).alias("s"),
    )
    both = own.select("*", F.lead("s").over(after).alias("s_next")).where("guest = 0")
    both = both.select("*", words(F.col("edited")).alias("edited_words")).select("*", sketch(F.col("edited_words"), k).alias("e"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("s_next"), k).alias("near_next"),
    )
