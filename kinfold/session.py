"""Session construction and lineage cuts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
TASK_ROWS = 1 << 19  # rows that one task gets of a table dealt by key, whatever the session's number of partitions


def local_session(cpus: int | str = "*", app: str = "kinfold", **conf: str) -> SparkSession:
    """Single-JVM session for tests and the benchmark; clusters bring their own."""
    # numpy releases the cores to Spark: one BLAS thread per Python worker.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    parallelism = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KINFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors of an application that did not install it (once each)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='kinfold-src-')}/kinfold", "zip", package.parent, package.name)
    sc.addPyFile(archive)  # a driver file that Spark distributes
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    The session's ``spark.checkpoint.dir`` wins. Only where nothing is set and everything runs in one process (tests, a
    laptop) a fresh temporary folder is used; executors of a cluster would each see a folder of their own.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    refuse_local_scratch(sc.master, configured)
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kinfold-ckpt-"))
    return sc.getCheckpointDir()


def refuse_local_scratch(master: str, configured: str | None) -> None:
    """Fail where executors may run elsewhere and no shared folder is named."""
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors of {master} share")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once no result built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    Survives the loss of any executor, cuts the lineage of iterative work, and, unlike a plain checkpoint, gives the
    planner the true size of the intermediate result: the size estimates of a checkpoint multiply at every join, so
    after some rounds nothing is broadcast any more and planning itself becomes slow.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def parts_for(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Into how many partitions so many rows are dealt."""
    return max(1, -(-rows // task_rows))


def frequent(df: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame | None:
    """The keys (``key``) that alone have more rows than a task should get, at most rows / ``task_rows`` of them; None if there are none."""
    hot = checkpoint(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > task_rows) & F.col(key).isNotNull()).select(key))
    return None if hot.isEmpty() else hot


def discard(*tables: DataFrame) -> None:
    """Delete checkpointed tables that nothing still to be evaluated reads, such as those of a loop's previous round."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """Checkpoint ``df`` and count, in the same job, the rows meeting ``condition``."""
    seen = Observation()
    done = checkpoint(df.observe(seen, F.count_if(condition).alias("n")))
    return done, int(seen.get["n"])
