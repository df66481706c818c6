"""Joins, windows, selections and sets over the star schema and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import select as sel
from folioscope.session import table


def jurisdiction_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Two-step lookup with a default: supplier, nation, region."""
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region").where("r_name != 'ASIA'")
    d = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")  # fixed tables of 25 and 5 rows
    return d.select("s_suppkey", F.coalesce("r_name", F.lit("")).alias("code"))


def range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the price band of another part of their brand: a range within equal keys."""
    p = table(spark, sf, "part")
    return sel.band_counts(p, "p_partkey", ["p_brand"], "p_retailprice", 2.0)


def nearest_before(spark: SparkSession, sf: str) -> DataFrame:
    """For each error the last purchase of its user before it."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return sel.as_of(left, right, "user_id", "ts", "event_id").select("event_id", "matched")


def pattern_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Which cues each document's text holds."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", *[F.col("t").rlike(p).alias(n) for n, p in sel.CUES.items()])


def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = pattern_flags(spark, sf)
    return d.agg(*[F.count_if(n).alias(n) for n in sel.CUES], F.count("*").alias("n"))


def quota_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The newest orders of each priority up to a quota."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.withColumn("k", F.row_number().over(w)).where("k <= 7").select("o_orderkey", F.col("k").cast("bigint").alias("k"))


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Slots filled in turns over the priorities, newest first."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    d = o.withColumn("turn", F.row_number().over(w)).where("turn <= 40")
    d = d.withColumn("slot", F.row_number().over(Window.orderBy("turn", "o_orderpriority")))  # at most 40 a priority
    return d.where("slot <= 103").select("o_orderkey", F.col("slot").cast("bigint").alias("slot"))


def sectioned_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with what came before and after, and whether one of the three before was unusable."""
    p = table(spark, sf, "page_info").distinct()
    w = Window.partitionBy("doc_id").orderBy("number")
    bad = (~F.coalesce("usable", F.lit(True))).cast("int")
    return p.select("doc_id", "number", F.lag("text_source").over(w).alias("before"), F.lead("text_source").over(w).alias("after"), (F.coalesce(F.max(bad).over(w.rowsBetween(-3, -1)), F.lit(0)) > 0).alias("near_bad"))


def revenue(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    per = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))  # before the join, so that it moves one row a customer
    d = per.join(c, per.o_custkey == c.c_custkey)
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("total"), "c_custkey")
    return d.withColumn("k", F.row_number().over(w)).where("k <= 5").select("c_mktsegment", "c_custkey", "total", F.col("k").cast("bigint").alias("k"))


def unordered_customers(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def document_counters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "page_info").distinct()
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("usable")).alias("unusable"), F.sum("watermark_chars").alias("watermark"), F.max("margin_chars").cast("bigint").alias("margin"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    d = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return d.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (jurisdiction_codes, range_join, nearest_before, pattern_flags, pattern_counts, quota_per_group, round_robin, sectioned_lag, revenue, top_customers, unordered_customers, document_counters, event_windows)
}


def _sql() -> dict[str, str]:
    flags = ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS {n}" for n, p in sel.CUES.items())
    return {
        "jurisdiction_codes": "SELECT s_suppkey, coalesce(r_name, '') AS code FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey",
        "range_join": "SELECT a.p_partkey, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND b.p_retailprice BETWEEN a.p_retailprice - 2 AND a.p_retailprice + 2 GROUP BY 1",
        "nearest_before": "SELECT l.event_id, arg_max(r.event_id, (r.ts, r.event_id)) AS matched FROM events l LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = l.user_id AND (r.ts < l.ts OR r.ts = l.ts) WHERE l.event_type = 'error' GROUP BY 1",
        "pattern_flags": f"SELECT doc_id, {flags} FROM documents",
        "pattern_counts": f"SELECT {', '.join(f'count(*) FILTER ({n}) AS {n}' for n in sel.CUES)}, count(*) AS n FROM (SELECT {flags} FROM documents)",
        "quota_per_group": "SELECT o_orderkey, k FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 7",
        "round_robin": "SELECT * FROM (SELECT o_orderkey, row_number() OVER (ORDER BY turn, o_orderpriority) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS turn FROM orders)) WHERE slot <= 103",
        "sectioned_lag": "SELECT doc_id, number, lag(text_source) OVER w AS before, lead(text_source) OVER w AS after, coalesce(max((NOT coalesce(usable, true))::INT) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) > 0 AS near_bad FROM (SELECT DISTINCT * FROM page_info) WINDOW w AS (PARTITION BY doc_id ORDER BY number)",
        "revenue": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
        "top_customers": "SELECT * FROM (SELECT c_mktsegment, c_custkey, total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS k FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey) WHERE k <= 5",
        "unordered_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY 1",
        "document_counters": "SELECT doc_id, count(*) AS pages, count(*) FILTER (NOT usable) AS unusable, sum(watermark_chars)::BIGINT AS watermark, max(margin_chars)::BIGINT AS margin FROM (SELECT DISTINCT * FROM page_info) GROUP BY 1",
        "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }


SQL = _sql()
