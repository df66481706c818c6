"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected(gold: DataFrame) -> DataFrame:
    """(query_id, seq, act, section, neutral_citation): one row per expected source of each distinct question."""
    one = gold.groupBy(F.col("id").alias("query_id")).agg(F.first("expected_sources", True).alias("e"))  # repeats are identical
    return one.select("query_id", F.posexplode("e").alias("seq", "s")).select("query_id", "seq", "s.*")


def is_hit() -> Column:
    """Whether a candidate is the expected source: by law and section, or by a citation it holds."""
    by_act = F.col("act").isNotNull() & (F.col("act") == F.col("act_title")) & (F.col("section") == F.col("chunk_section"))
    by_citation = F.col("act").isNull() & F.col("neutral_citation").isNotNull() & F.contains(F.coalesce("citation", F.lit("")), F.col("neutral_citation"))
    return F.coalesce(by_act | by_citation, F.lit(False))


def source_ranks(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, seq, best): the least rank at which each expected source is found, null if it isn't.

    ranked: (query_id, rank, act_title, chunk_section, citation).
    """
    hits = sources.join(ranked, "query_id").where(is_hit()).groupBy("query_id", "seq").agg(F.min("rank").alias("best"))
    return sources.select("query_id", "seq").join(hits, ["query_id", "seq"], "left")


def retrieval_metrics(best: DataFrame, match: DataFrame) -> DataFrame:
    """(query_id, recall_5, recall_10, mrr); of alternatives (match = any) one is enough."""
    agg = best.join(match, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.max("match"), F.lit("all")).alias("match"), F.count("*").alias("n"), F.min("best").alias("least"),
        F.count(F.when(F.col("best") <= 5, 1)).alias("in5"), F.count(F.when(F.col("best") <= 10, 1)).alias("in10"),
    )
    any_ = F.col("match") == "any"
    recall = lambda k, c: F.when(any_, F.coalesce((F.col("least") <= k).cast("double"), F.lit(0.0))).otherwise(F.col(c) / F.col("n"))
    return agg.select("query_id", F.round(recall(5, "in5"), 6).alias("recall_5"), F.round(recall(10, "in10"), 6).alias("recall_10"), F.round(F.coalesce(1 / F.col("least"), F.lit(0.0)), 6).alias("mrr"))


def confusion(df: DataFrame, should: str, did: str) -> DataFrame:
    """One row: correct, false and missed abstentions, precision and recall (null without cases)."""
    s, d = F.col(should), F.col(did)
    one = df.agg(F.count_if(s & d).alias("tp"), F.count_if(~s & d).alias("fp"), F.count_if(s & ~d).alias("fn"))
    return one.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def sweep(df: DataFrame, should: str, score: str, exact: str | None = None, first: int = 5, last: int = 75, step: int = 5) -> DataFrame:
    """(threshold, tp, fp, fn): what each threshold (per cent) would abstain from; exact evidence always answers."""
    t = df.select(should, score, (F.col(exact) if exact else F.lit(False)).alias("_x"), F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("p"))
    low = ~F.col("_x") & (F.col(score) < F.col("p") / 100)
    return t.groupBy((F.col("p") / 100).alias("threshold")).agg(F.count_if(F.col(should) & low).alias("tp"), F.count_if(~F.col(should) & low).alias("fp"), F.count_if(F.col(should) & ~low).alias("fn"))


def index_quantile(values: Column, q: float = 0.95) -> Column:
    """The value at place int(q * n) of the sorted list, counted from 1 and at least 1; not interpolated."""
    s = F.array_sort(values)
    return F.element_at(s, F.greatest(F.lit(1), (F.size(s) * q).cast("int")))
