"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A stored table in at least as many partitions as there are cores, for work that Python does row by row.

    A file of one row group is one task however large; tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    said = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in said for x in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Generate")):
        return df  # not a stored table: counting its partitions would run it
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which is set here only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = os.path.join(tempfile.gettempdir(), "folioscope-shared")
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            spark.conf.set("spark.checkpoint.dir", where)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that later steps neither recompute nor lose them with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder, which goes when the session's JVM ends or `working` is left."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, what was staged inside; results must have been read or written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            fs, p = _fs(spark, path)
            fs.delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """As cut, but as Parquet: later reads prune columns and push filters down."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
