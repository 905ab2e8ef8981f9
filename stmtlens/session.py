"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_scratch: str | None = None
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(app: str = "stmtlens", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STMTLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # HotSpot does not compile methods above 8000 bytes; a bigger stage runs as separate
        # generated operators instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session, where driver and
    executors are one process, may fall back to a folder of this machine.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="run-stmtlens-")
    return _local_scratch


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and fixes values that a second evaluation
    could assign differently (partition numbers).
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing still to be computed reads."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            spark = table.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that ends in here go at once.

    Otherwise they stay until the driver collects garbage, so a chain of tables may hold them all.
    For queries that end in a table of their own; a data frame acted on twice would miss its files.
    """
    before = spark.conf.get(BRIEF, None)
    spark.conf.set(BRIEF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BRIEF)
        else:
            spark.conf.set(BRIEF, before)


def spread(df: DataFrame) -> DataFrame:
    """Give every core an even share of a scan that has few splits.

    For narrow rows that text work makes expensive. A split without the middle of a row group reads
    nothing, so only a scan of many splits for each core is even by itself and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 8 * cores else df
