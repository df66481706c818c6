"""Change detection and upkeep of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(ledger: DataFrame, key: str, order: str, usable: Column | None = None) -> DataFrame:
    """The last row of each key of an append-only ledger, with the place of the key's first row in `first_at`."""
    d = ledger if usable is None else ledger.where(usable)
    rest = [c for c in d.columns if c != key]
    one = d.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"), F.min(order).alias("first_at"))
    return one.select(key, "_r.*", "first_at")


def unchanged(inputs: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that the state doesn't hold with equal keys; null keys equal nothing and are always due."""
    return inputs.join(state.select(*keys).distinct(), keys, "left_anti")


def three_way(want: DataFrame, have: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, state): missing, stale, current or orphan, by a stamp such as the hash of what was indexed."""
    w = want.select(key, F.col(stamp).alias("_w"), F.lit(True).alias("_in"))
    h = have.select(key, F.col(stamp).alias("_h"), F.lit(True).alias("_out"))
    both = w.join(h, key, "full_outer")
    state = F.when(F.col("_in").isNull(), "orphan").when(F.col("_out").isNull(), "missing").when(F.col("_w").eqNullSafe(F.col("_h")), "current").otherwise("stale")
    return both.select(key, state.alias("state"))


def keep_first(df: DataFrame, keys: list[str], order: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of equal keys, and the others with the `name` of the row that was kept for them."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_n", F.row_number().over(w)).withColumn(f"kept_{name}", F.first(name).over(w))
    return d.where("_n = 1").drop("_n", f"kept_{name}"), d.where("_n > 1").drop("_n")


def replaced(stored: DataFrame, new: DataFrame, key: str, identity: list[str], order: str) -> DataFrame:
    """The table after the documents of `new` took the place of their old rows; equal identities keep the first row."""
    fresh, _ = keep_first(new, identity, order, order)
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(fresh, allowMissingColumns=True)


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(new, allowMissingColumns=True)


def live(cache: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Entries that haven't expired; an entry without an expiry has none."""
    return cache.where(F.col(expires).isNull() | (F.col(expires) > now))


def newest(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """What a bounded store keeps: the newest `most` of each owner."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def islands(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, start, end): runs of consecutive numbers."""
    d = df.select(*by, number).distinct()
    d = d.withColumn("_k", F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number)))
    return d.groupBy(*by, "_k").agg(F.min(number).alias("start"), F.max(number).alias("end")).drop("_k")


def runs_label(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, pages): runs as 1-3, 7."""
    part = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))))
    return runs.groupBy(*by).agg(F.array_join(part, ", ").alias("pages"))
