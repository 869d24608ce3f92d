"""Near-duplicate documents by circulant MinHash.

A document is the set of its shingles of five words. Two permutations of a universe of 2^20 places serve all coordinates
of the signature: the first scatters the shingles' hashes, the second, shifted by one place more for each coordinate, gives the
values whose minima are the signature. The shifted values of a shingle are neighbours in memory, so a signature costs one
short copy per shingle. Bands of coordinates make bucket keys; documents that share a bucket are compared on their full sets.

What keeps large groups linear:

* documents with equal sets are one class, found by a digest of the set, and compared once;
* shingles that only one class has (of all that share a bucket with another) can be in no intersection. Their number bounds the similarity of
  a class to any other from above, so copies with many changes of their own are not compared with each other;
* a bucket is not expanded into pairs. Its first class by hash is its center, with which the others are compared; confirmed links are contracted to
  components. What is left of a large bucket outside its centers' components gets a center again, as long as that settles an eighth of it;
* buckets whose classes are then in several components are cut into tiles, a large component into tiles of its own. Tiles of different components
  are compared within a task, tiles of one component never meet, and only links leave the task. A pair is left out only when it is in one component
  already or cannot reach the similarity, so no link between components is lost;
* components come from contraction by minima with pointer jumping; only tables of links are iterated, each round written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.shared import packed, text_key
from kinfold.session import checkpoint, checkpoint_counting

UNIVERSE = 1 << 20
WORDS = 5
BANDS, ROWS = 26, 5  # a pair at similarity 0.85 shares no bucket with probability (1 - 0.85^5)^26 < 3e-7
TILE_ROWS, TILE_BYTES = 256, 8 << 20  # of a bucket compared at once with as much
CHUNK = 4096  # shingles whose coordinates are held at once


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, separated by ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int = WORDS) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*[words[k:] for k in range(size)])) if len(words) >= size else {tuple(words)}


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1) if len(h) else 0
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


class Circulant:
    """Signatures of ``bands * rows`` coordinates from two permutations."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self._scatter = rng.permutation(UNIVERSE).astype(np.int32)
        values = rng.permutation(UNIVERSE).astype(np.uint32)
        self._shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: k - 1]]), k)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self._scatter[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        parts = [self._shifted[places[a : a + CHUNK]].min(axis=0) for a in range(0, len(places), CHUNK)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.rows):
            key = (key ^ rows[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


_circulants: dict[tuple[int, int], Circulant] = {}


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """``id``, ``n_shingles``, ``set`` (128-bit digest of the set, null if empty), ``buckets`` and ``tid``, a digest of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _circulants.get((bands, rows))
        if maker is None:
            maker = _circulants[bands, rows] = Circulant(bands, rows)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(words_of(text))
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                keys.append(maker.buckets(maker.signature(hashes)) if len(hashes) else None)
            lists = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["id", "tid", "n_shingles", "set", "buckets"])

    source = df.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("tid"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, tid struct<a:bigint,b:bigint>, n_shingles bigint, `set` binary, buckets array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, ut, v, vt: classes and the text that shows each) whose full sets reach ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            us, ut, vs, vt = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for u, a, v, b in zip(us, ut, vs, vt):
                if u != last:
                    last, held = u, shingle_set(words_of(a))
                other = shingle_set(words_of(b))
                both = len(held & other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = texts.select(F.col("tid").alias("ut"), F.col("text").alias("a")), texts.select(F.col("tid").alias("vt"), F.col("text").alias("b"))
    # the many rows of a center are on the side that Spark can split
    full = pairs.join(a, "ut").join(b, "vt").select("u", "a", "v", "b")
    return full.mapInArrow(run, "u binary, v binary")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of all nodes of ``links`` (u, v)."""
    edges, n = checkpoint_counting(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), F.lit(True))
    labels = checkpoint(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("root", F.col("node")))
    while n:
        # each root points to the least root next to it, if that is less than itself
        up = edges.groupBy(F.col("v").alias("child")).agg(F.min("u").alias("parent"))
        up, moving = checkpoint_counting(up, F.lit(True))
        while moving:  # pointer jumping: twice as far each time
            far = up.join(up.select(F.col("child").alias("parent"), F.col("parent").alias("top")), "parent", "left")
            up, moving = checkpoint_counting(far.select("child", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved")), F.col("moved"))
            up = up.select("child", "parent")
        to = lambda c: up.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_to"))
        labels = checkpoint(labels.join(to("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")))
        moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left")
        moved = moved.select(F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v")).where("u != v")
        edges, n = checkpoint_counting(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), F.lit(True))
    return labels


def _may_link(s: str, n: str, other_n: str, percent: int) -> Column:
    """Whether an intersection of ``s`` shingles suffices for sets of ``n`` and ``other_n``."""
    return (100 + percent) * F.col(s) >= percent * (F.col(n) + F.col(other_n))


def _narrowed(rows: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Rows of buckets that hold several roots, less those too much on their own for the smallest set there; and how many."""
    several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("low")).where("x != y")
    left = rows.join(several.select("bucket", "low"), "bucket").where(_may_link("s", "n", "low", percent))
    return checkpoint_counting(left.select("bucket", "set", "tid", "n", "s", "turn", "root"), F.lit(True))


def _own_shingles(texts: DataFrame) -> DataFrame:
    """``no`` and ``own``: how many shingles of the text with that number no other of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for k in range(0, batch.num_rows, 256):
                sets = [shingle_hashes(words_of(t)) for t in batch.column(1).slice(k, 256).to_pylist()]
                which = np.repeat(np.array(names[k : k + 256], np.int64), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate(sets).view(np.int64))], ["no", "shingle"])

    rows = texts.select("no", "text").mapInArrow(run, "no bigint, shingle bigint")
    once = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("no")).where("n = 1")
    return once.groupBy("no").agg(F.count(F.lit(1)).alias("own"))


def _centers(members: DataFrame) -> DataFrame:
    """The first class by turn of each bucket."""
    center = F.min(F.struct("turn", "set", "tid", "n", "s", "root")).alias("c")
    return members.groupBy("bucket").agg(center).select("bucket", *[F.col(f"c.{k}").alias(f"c_{k}") for k in ("set", "tid", "n", "s", "root")])


def _links_of_centers(members: DataFrame, centers: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of each bucket's center with its members of other components."""
    met = members.join(centers, "bucket").where(F.col("root") != F.col("c_root"))
    met = met.where(_may_link("s", "n", "c_n", percent) & _may_link("c_s", "n", "c_n", percent))
    pairs = met.select(F.col("c_set").alias("u"), F.col("c_tid").alias("ut"), F.col("set").alias("v"), F.col("tid").alias("vt"))
    return checkpoint(_confirmed(checkpoint(pairs.dropDuplicates(["u", "v"])), texts, percent))


def _with_roots(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.drop("root").join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _unsettled(members: DataFrame, centers: DataFrame, labels: DataFrame) -> DataFrame:
    """Members outside the component of their bucket's center, of buckets that hold over a tile of them and in which the center settled an eighth."""
    settled = _with_roots(centers.select("bucket", F.col("c_set").alias("set")), labels).select("bucket", F.col("root").alias("done"))
    rows = _with_roots(members, labels).join(settled, "bucket").withColumn("rest", F.col("root") != F.col("done"))
    sizes = rows.groupBy("bucket").agg(F.count_if("rest").alias("after"), F.count(F.lit(1)).alias("before"))
    again = sizes.where((F.col("after") > TILE_ROWS) & (8 * F.col("after") <= 7 * F.col("before"))).select("bucket")
    return rows.where("rest").join(again, "bucket").drop("done", "rest")


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the classes of two tiles of a bucket, or within one, that are not in one component yet."""
    near, far = rows["i"].iloc[0], rows["j"].iloc[0]
    words = [words_of(t) for t in rows["text"]]
    hashes = [set(shingle_hashes(w).tolist()) for w in words]
    homes = [set(b) for b in rows["buckets"]]
    bucket, sets = rows["bucket"].iloc[0], rows["set"].tolist()
    n, s, root = rows["n"].to_numpy(), rows["s"].to_numpy(), pd.factorize(rows["root"])[0]
    left, right = np.flatnonzero(rows["tile"] == near), np.flatnonzero(rows["tile"] == far)
    found = []
    for x in left.tolist():
        other = right if near != far else right[right > x]
        fits = (100 + percent) * np.minimum(s[x], s[other]) >= percent * (n[x] + n[other])
        for y in other[fits & (root[x] != root[other])].tolist():
            if min(homes[x] & homes[y]) != bucket:
                continue  # they meet in another bucket, too, and are compared there
            both = len(hashes[x] & hashes[y])
            if 100 * both >= percent * (len(hashes[x]) + len(hashes[y]) - both):
                a, b = shingle_set(words[x]), shingle_set(words[y])
                if 100 * len(a & b) >= percent * len(a | b):
                    found.append((sets[x], sets[y]))
    return pd.DataFrame(found, columns=["u", "v"])


def _tiles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``members`` with their ``tile`` and the ``others`` it is compared with. A component that fills half a tile of a bucket has tiles of its own, which
    do not meet each other; smaller ones share tiles, which also meet themselves. So few rows beside a large component are copied often and the
    component's many rows seldom."""
    families = members.join(texts.select("tid", "bytes"), "tid").groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    tiles = lambda rows, size: F.greatest(F.ceil(rows / TILE_ROWS), F.ceil(size / TILE_BYTES))
    large = (2 * F.col("rows") > TILE_ROWS) | (2 * F.col("bytes") > TILE_BYTES)
    families = checkpoint(families.withColumn("own", F.when(large, tiles(F.col("rows"), F.col("bytes")))))
    small = lambda c: F.sum(F.when(F.col("own").isNull(), F.col(c)).otherwise(0))
    cut = families.groupBy("bucket").agg(tiles(small("rows"), small("bytes")).alias("loose"), F.coalesce(F.sum("own"), F.lit(0)).alias("large"))
    # one row per large component of a bucket
    before = Window.partitionBy("bucket").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    own = families.where("own is not null").select("bucket", "root", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("skip"))
    rows = members.join(cut, "bucket").join(own, ["bucket", "root"], "left").withColumn("from", F.col("loose") + F.col("skip"))
    shared = F.pmod(F.xxhash64("root"), F.greatest("loose", F.lit(1)))
    rows = rows.withColumn("tile", F.when(F.col("own").isNull(), shared).otherwise(F.col("from") + F.pmod("turn", F.coalesce("own", F.lit(1)))))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("loose") + F.col("large") - 1)
    foreign = F.filter(every, lambda x: (x < F.col("from")) | (x >= F.col("from") + F.col("own")))
    return rows.withColumn("others", F.when(F.col("own").isNull(), every).otherwise(foreign)).drop("loose", "large", "own", "skip", "from")


def _links_of_tiles(members: DataFrame, texts: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of all classes of a bucket that are in different components: each pair of tiles that may hold one is compared in one
    task, and only links leave it."""
    tiled = _tiles(members, texts).join(texts.select("tid", "text"), "tid").join(buckets, "set").withColumn("other", F.explode("others"))
    tiled = tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    columns = ["bucket", "i", "j", "tile", "set", "n", "s", "root", "buckets", "text"]
    return tiled.select(*columns).groupBy("bucket", "i", "j").applyInPandas(lambda pdf: _compare(pdf, percent), "u binary, v binary")


def _link(members: DataFrame, texts: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Components of the links among the ``members`` (bucket, set, tid, n, s, turn, root) of each bucket.
    ``n`` is the size of the set and ``s`` the number of its shingles that others have."""
    members, left = _narrowed(members, percent)
    if not left:
        return members.select(F.col("set").alias("node"), "root").limit(0)
    active, links = members, None
    while left:
        centers = checkpoint(_centers(active))
        found = _links_of_centers(active, centers, texts, percent)
        links = found if links is None else links.union(found)
        labels = components(links)
        active, left = _narrowed(_unsettled(active, centers, labels), percent)
    members, left = _narrowed(_with_roots(members, labels), percent)
    if not left:
        return labels
    return components(links.union(checkpoint(_links_of_tiles(members, texts, buckets, percent))))


def groups(df: DataFrame, id_col: str, text_col: str, percent: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``id``, ``tid`` (digest of id and text), ``n_shingles``, ``root`` (names its component; null if it has no shingles) and ``least``,
    the least id of the component."""
    marked = checkpoint(signatures(df, id_col, text_col, bands, rows))
    classes = marked.where("n_shingles > 0").groupBy("set").agg(
        F.min("id").alias("least"), F.min("tid").alias("tid"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")
    )
    classes = checkpoint(classes)
    # a bucket that holds one class only links nothing
    spread = classes.select("set", "tid", "n", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").count().where("count > 1").select("bucket")
    turn = F.xxhash64("bucket", "set").alias("turn")
    members, n_members = checkpoint_counting(spread.join(shared, "bucket").select("bucket", "set", "tid", "n", turn, F.col("set").alias("root")), F.lit(True))
    by_set = classes.select("set", F.col("set").alias("root"), "least")
    if n_members:
        named = df.select(text_key(id_col, text_col).alias("tid"), F.col(text_col).alias("text"))
        texts = named.join(members.select("tid").distinct(), "tid", "left_semi").dropDuplicates(["tid"])
        texts = checkpoint(texts.select("tid", "text", F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("no")))
        own = checkpoint(_own_shingles(texts).join(texts.select("no", "tid"), "no").select("tid", "own"))
        shared_part = members.join(own, "tid", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0)))
        members = checkpoint(shared_part.where(100 * F.col("s") >= percent * F.col("n")).drop("own"))
        rooted = classes.select("set", "least").join(_link(members, texts, classes.select("set", "buckets"), percent).withColumnRenamed("node", "set"), "set", "left")
        rooted = rooted.select("set", "least", F.coalesce("root", "set").alias("root"))
        by_set = rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("least")), "root")
    return marked.select("id", "tid", "n_shingles", "set").join(by_set, "set", "left").drop("set")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` (the least id reachable over confirmed links, its own included), ``kept``.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets. A text of fewer than five words has its whole
    sequence as only shingle; an empty or null text, or white space alone, has the empty set, is linked with nothing and kept.
    Rows with equal sets are linked. Null ids take part, but are no component's id unless it has no other; such a row is kept only then.
    Rows that share an id each get the component of their own text, and all with the component's id are kept.
    Very long texts count whole. Other columns are not read; an empty table gives an empty result.
    """
    out = groups(df, id_col, text_col, percent, bands, rows)
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each group of linked documents, with all columns of ``df``: that of the least id (a null one only if there is no other), of rows
    that share it that of the least digest of id and text, and of rows equal in both any one. Rows without words all stay; very long texts count whole.
    """
    found = groups(df, id_col, text_col, percent, bands, rows)
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("best"))
    keep = best.select("best.tid").union(found.where("n_shingles = 0").select("tid").distinct())
    docs = df.select(packed(df).alias("row"), F.col(text_col).alias("text"), text_key(id_col, text_col).alias("tid"))
    # rows without words are told apart by a number of their own
    own = F.when(F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    kept = docs.withColumn("own", own).join(keep, "tid").groupBy("tid", "own").agg(F.first("row").alias("row"))
    return kept.select("row.*")
