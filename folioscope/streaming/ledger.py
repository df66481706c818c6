"""Structured Streaming over ledgers and request logs.

Stateful upkeep is done in foreachBatch against tables that are replaced by partition. Each batch writes with its id, so a
batch that is run again after a failure leaves what it left the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import store
from folioscope.sources.sinks import swapped


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith("part=") for s in fs.listStatus(p))


def upsert(path: str, key: str, order: str, partitions: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key in `path`.

    Only the partitions of the batch's keys are read and replaced. The result depends on the rows alone, not on how often or in
    which batch they came, so running a batch again changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).withColumn("part", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
        new = new.persist()
        try:
            parts = [r[0] for r in new.select("part").distinct().collect()]  # at most `partitions`
            if not parts:
                return
            both = new
            if _exists(spark, path):
                both = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(parts)).unionByName(new)
            last = store.last_wins(both, key, order).drop("first_at").select(*new.columns)
            # written apart first: a table can't be read and replaced in one job
            held = last.checkpoint(eager=True)
            swapped(held.repartition("part"), path, ["part"])
        finally:
            new.unpersist()

    return run


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there now through the sink and ends; the next call goes on after it."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def windows(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) in event time; rows later than `late` behind the newest are left out by the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    d = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return d.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_latencies(events: DataFrame, most: int = 500) -> DataFrame:
    """Request counters by path and the last latencies, as a foreachBatch would hold them."""
    return store.newest(events, ["event_type"], [F.desc("ts"), F.desc("event_id")], most)
