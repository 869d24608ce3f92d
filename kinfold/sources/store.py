"""Vector store: vectors in buckets of key hashes, versions of the store in manifests, and a one-row metadata table beside it.

A bucket is a folder of the data, and each write adds folders of its own to it. A manifest lists, for every bucket, the folders that make up a
version; it appears under its final name in one step, so readers see the version before or the one after, and a writer that
dies leaves folders that nothing refers to. A write touches the buckets of its keys only. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import ids
from kinfold.functions.vectors import as_double, divisor, norm
from kinfold.operators.curate import first_wins, pending
from kinfold.session import checkpoint

STORE_SCHEMA = "key string, dim int, embedding array<float>"
EXPORT_LAYER = 33  # fixed value: the layer key of exported vectors
BUCKETS = 32  # of a new store


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table of plain files."""
    return any(name.startswith("part-") for name in _names(spark, path))


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``n_buckets`` and the folders of each bucket, of the last version or a given one; an empty store has none."""
    known = versions(spark, path)
    if not known:
        return {"version": -1, "n_buckets": BUCKETS, "folders": {}}
    version = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/manifest/{version:09d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, old: dict, folders: dict[str, list[str]]) -> None:
    """Make ``folders`` the next version: the manifest is written under another name and renamed."""
    new = {"version": old["version"] + 1, "n_buckets": old["n_buckets"], "folders": folders}
    at, fs = _fs(spark, f"{path}/manifest/{new['version']:09d}.json")
    draft, _ = _fs(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        raise OSError(f"another writer made version {new['version']} of {path}")


def bucket(key: Column | str, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")


def _write(rows: DataFrame, path: str, n_buckets: int) -> dict[str, str]:
    """Write rows (key, dim, embedding) to a folder of their own in each bucket; returns the folders by bucket."""
    mark = uuid.uuid4().hex
    placed = rows.withColumn("bucket", bucket("key", n_buckets)).withColumn("write", F.lit(mark))
    placed.repartition("bucket").write.partitionBy("bucket", "write").mode("append").parquet(f"{path}/data")
    spark = rows.sparkSession
    touched = [n for n in _names(spark, f"{path}/data") if n.startswith("bucket=") and f"write={mark}" in _names(spark, f"{path}/data/{n}")]
    return {n[7:]: f"{n}/write={mark}" for n in touched}


def read_store(spark: SparkSession, path: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
    """All rows of the store, or those of some buckets."""
    folders = manifest(spark, path, version)["folders"]
    wanted = folders.keys() if buckets is None else [str(b) for b in buckets]
    paths = [f"{path}/data/{f}" for b in wanted for f in folders.get(b, [])]
    if not paths:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(*paths)


def buckets_of(df: DataFrame, path: str, key: str = "key") -> list[int]:
    """The buckets that may hold the keys of ``df``, at most all."""
    n = manifest(df.sparkSession, path)["n_buckets"]
    return sorted(r.b for r in df.where(F.col(key).isNotNull()).select(bucket(F.col(key).cast("string"), n).alias("b")).distinct().collect())


def keys(spark: SparkSession, path: str) -> DataFrame:
    """Key column only; internal keys (leading ``__``) are left out."""
    return read_store(spark, path).select("key").where(~F.startswith("key", F.lit("__")))


def as_rows(df: DataFrame) -> DataFrame:
    return df.select("key", F.size("embedding").alias("dim"), F.col("embedding").cast("array<float>").alias("embedding"))


def put_missing(df: DataFrame, path: str, order: str = "pos") -> None:
    """Insert-if-absent: the first row of a key within ``df`` (by ``order``, unique within a key) wins, keys already stored are left alone.

    Winners are found on key and order alone; what is stored stays where it is, and new rows lie beside it.
    """
    spark, old = df.sparkSession, manifest(df.sparkSession, path)
    df = checkpoint(df.select("key", F.col(order).alias("_order"), "embedding"))
    stored = read_store(spark, path, buckets_of(df, path)).select("key")
    added = _write(as_rows(pending(first_wins(df, "key", "_order"), stored)), path, old["n_buckets"])
    _publish(spark, path, old, {b: old["folders"].get(b, []) + ([added[b]] if b in added else []) for b in {*old["folders"], *added}})


def put_over(df: DataFrame, path: str) -> None:
    """Overwrite: rows of ``df`` (one per key) replace those stored under the same key. Only the buckets of its keys are written anew."""
    spark, old = df.sparkSession, manifest(df.sparkSession, path)
    new = checkpoint(as_rows(df))
    merged = upsert(read_store(spark, path, buckets_of(new, path)), new)
    added = _write(merged, path, old["n_buckets"])
    _publish(spark, path, old, old["folders"] | {b: [f] for b, f in added.items()})


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overwrite semantics: rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def replace_store(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in the place of the whole store, which they may be derived from."""
    old = manifest(rows.sparkSession, path)
    _publish(rows.sparkSession, path, old, {b: [f] for b, f in _write(as_rows(rows), path, old["n_buckets"]).items()})


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete earlier versions and the folders that the last one does not refer to; returns how many folders went. No reader may be at an earlier version."""
    kept = {f for some in manifest(spark, path)["folders"].values() for f in some}
    gone = 0
    for name in _names(spark, f"{path}/data"):
        for write in _names(spark, f"{path}/data/{name}") if name.startswith("bucket=") else ():
            if f"{name}/{write}" not in kept:
                at, fs = _fs(spark, f"{path}/data/{name}/{write}")
                gone += bool(fs.delete(at, True))
    for version in versions(spark, path)[:-1]:
        at, fs = _fs(spark, f"{path}/manifest/{version:09d}.json")
        fs.delete(at, False)
    return gone


def write_meta(spark: SparkSession, path: str, meta: dict[str, str], replace: bool = False) -> None:
    """Run metadata beside the store; written once unless ``replace``."""
    target = path.rstrip("/") + ".meta"
    if exists(spark, target) and not replace:
        return
    spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "name string, value string").write.mode("overwrite").parquet(target)


def check_dim(df: DataFrame, dim: int) -> DataFrame:
    """Fail on a vector of another length than ``dim``."""
    ok = F.assert_true(F.size("embedding") == dim, F.concat(F.lit("vector has "), F.size("embedding").cast("string"), F.lit(f" items, expected {dim}")))
    return df.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")


def lookup(wanted: DataFrame, store: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` with their vector (``pos`` keeps their order), and the rows without one."""
    return wanted.join(store, key), wanted.join(store.select(key), key, "left_anti")


def lookup_stored(wanted: DataFrame, path: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """``lookup`` in the store at ``path``, of which only the buckets of the wanted keys are read."""
    store = read_store(wanted.sparkSession, path, buckets_of(wanted, path, key)).select(F.col("key").alias(key), "embedding")
    return lookup(wanted, store, key)


def export_vectors(df: DataFrame, label: str = "label", unit: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(label, mean_representations) and the columns to ``keep``: the export layout; ``unit`` normalises without guarding zero vectors."""
    v = as_double(F.col("embedding"))
    if unit:
        wide = df.withColumn("_v", v).withColumn("_d", divisor(norm(F.col("_v")), "nan"))
        d = F.col("_d")
        vec = F.transform("_v", lambda x: x / d).cast("array<float>")
    else:
        wide, vec = df, v.cast("array<float>")
    return wide.select(*keep, F.col(label).alias("label"), F.create_map(F.lit(EXPORT_LAYER), vec).alias("mean_representations"))


def export_store(store: DataFrame) -> DataFrame:
    """Full export of a store: ids recovered from keys, the metadata key left out."""
    rows = store.where(F.col("key") != "__meta__")
    return export_vectors(rows.withColumn("label", ids.key_to_id(F.col("key"))))


def import_vectors(exported: DataFrame) -> DataFrame:
    """(label, embedding) and any further columns from the export layout."""
    rest = [c for c in exported.columns if c not in ("label", "mean_representations")]
    return exported.select(*rest, "label", F.element_at("mean_representations", EXPORT_LAYER).alias("embedding"))
