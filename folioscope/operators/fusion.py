"""Fusion of ranked lists, final order, evidence gate and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx

RRF_K = 60


def rrf(lists: DataFrame, pins: DataFrame | None = None, k: int = RRF_K, query: str = "query_id", key: str = "chunk", carry: tuple[str, ...] = ()) -> DataFrame:
    """(query, key, fused, score, ranks map): reciprocal rank fusion of long lists (query, list_name, list_seq, key, rank).

    A key that a list holds twice counts twice, its later rank stays in the map. Pins (query, key, pin) come first in their
    order, with score 0 if no list has them. Ties: the list that came first, then the rank in it, then the key.
    carry: columns of the lists that are the same wherever a key stands.
    """
    by = lists.groupBy(query, key).agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("list_seq", "rank")).alias("_first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("list_name", "rank")))).alias("ranks") if pins is None else F.collect_list(F.struct("list_name", "rank")).alias("_ranks"),  # one entry per list
        *[F.max(c).alias(c) for c in carry],
    )
    order = [F.desc("score"), F.col("_first.list_seq"), F.col("_first.rank"), F.col(key)]
    if pins is not None:
        by = by.join(pins.groupBy(query, key).agg(F.min("pin").alias("pin")), [query, key], "full_outer")
        exact = F.when(F.col("pin").isNotNull(), F.array(F.struct(F.lit("exact").alias("list_name"), F.col("pin").cast("int").alias("rank")))).otherwise(F.array().cast("array<struct<list_name:string,rank:int>>"))
        by = by.withColumn("ranks", F.map_from_entries(F.array_sort(F.concat(F.coalesce("_ranks", F.array().cast("array<struct<list_name:string,rank:int>>")), exact))))
        by = by.withColumn("score", F.coalesce("score", F.lit(0.0)))
        order = [F.col("pin").asc_nulls_last(), *order]
    out = by.withColumn("fused", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return out.select(query, key, "fused", "score", "ranks", *([F.col("pin")] if pins is not None else []), *carry)


def two_voters(fused: DataFrame, rerank: str = "rerank_score", pinned: Column | None = None, pool: int = 30, k: int = RRF_K, query: str = "query_id") -> DataFrame:
    """(…, rerank, final): within the pool the fused and the reranked place vote alike; pinned rows stay in front."""
    pinned = F.lit(False) if pinned is None else pinned
    n = F.sum(F.when(pinned, 1).otherwise(0)).over(Window.partitionBy(query))
    d = fused.withColumn("_n", n).where(F.col("fused") <= F.greatest(F.lit(pool), F.col("_n"))).drop("_n")
    d = d.withColumn("rerank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rerank), "fused")))
    vote = F.round(1.0 / (k + F.col("fused")) + 1.0 / (k + F.col("rerank")), 9)
    return d.withColumn("final", F.row_number().over(Window.partitionBy(query).orderBy(F.when(pinned, 0).otherwise(1), F.desc(vote), "fused")))


def gate(candidates: DataFrame, on: Column, score: str, least_rerank: float = 0.10, least_dense: float = 0.60, query: str = "query_id") -> DataFrame:
    """(query, gate, best, abstained): whether the evidence is good enough to answer.

    Pinned evidence always is; scores of a reranker or of vectors must reach their threshold; keywords never decide.
    """
    by = candidates.groupBy(query).agg(F.min(on).alias("gate"), F.max(score).alias("best"))
    low = (F.col("gate") == "rerank") & (F.col("best") < least_rerank) | (F.col("gate") == "dense") & (F.col("best") < least_dense)
    return by.withColumn("abstained", F.coalesce(low, F.lit(False)))


def overlap_score(query_terms: Column, doc_terms: Column) -> Column:
    """A stand-in for a reranker: share of the question's terms that the text holds."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query_terms, doc_terms)), F.size(query_terms)), F.lit(0.0))


def statute_slots(final: DataFrame, places: int = 8, slots: int = 2, deepest: int = 10, query: str = "query_id") -> DataFrame:
    """(…, slot): the order in which the best fused statutes have taken the last places of other texts among the first.

    The candidates are the `slots` statutes of least fused rank up to `deepest`. Those not among the first `places` drive out
    its last others, one each, and stand at its end in that order; without others left they stay where they are.
    """
    by = Window.partitionBy(query)
    statute = F.col("doc_type") == "statute"
    d = final.withColumn("_head", F.col("final") <= places)
    d = d.withColumn("_best", F.row_number().over(by.orderBy(F.when(statute & (F.col("fused") <= deepest), 0).otherwise(1), "fused")))
    d = d.withColumn("_want", statute & (F.col("fused") <= deepest) & (F.col("_best") <= slots) & ~F.col("_head"))
    d = d.withColumn("_others", F.sum(F.when(F.col("_head") & ~statute, 1).otherwise(0)).over(by))
    d = d.withColumn("_n", F.when(F.col("_want"), F.row_number().over(by.orderBy(F.when(F.col("_want"), 0).otherwise(1), "fused"))))
    d = d.withColumn("_in", F.coalesce(F.col("_n") <= F.col("_others"), F.lit(False)))
    d = d.withColumn("_moves", F.sum(F.col("_in").cast("int")).over(by))
    d = d.withColumn("_last", F.row_number().over(by.orderBy(F.when(F.col("_head") & ~statute, 0).otherwise(1), F.desc("final"))))
    out = F.col("_head") & ~statute & (F.col("_last") <= F.col("_moves"))
    zone = F.when(F.col("_head") & ~out, 0).when(F.col("_in"), 1).otherwise(2)
    return d.withColumn("slot", F.row_number().over(by.orderBy(zone, F.when(F.col("_in"), F.col("_n")).otherwise(F.col("final"))))).drop(*[c for c in d.columns if c.startswith("_")])


def within_budget(ranked: DataFrame, size: str, budget: int, most: int, order: str = "rank", query: str = "query_id", key: str = "chunk") -> DataFrame:
    """(query, key, pos): walks each list in order and takes what still fits, skipping what doesn't, until `most` are taken.

    The fold runs in the JVM over the whole list, but for what can't fit at all.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("n"), F.col(key).alias("k"))))
    kind = ranked.schema[key].dataType.simpleString()
    start = F.from_json(F.lit('{"used":0,"got":[]}'), f"used bigint, got array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["got"]) < most) & (acc["used"] + x["n"] <= budget)
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.concat(acc["got"], F.array(x["k"])).alias("got"))).otherwise(acc)

    by = ranked.where(F.col(size) <= budget).groupBy(query).agg(F.aggregate(items, start, step).alias("r"))
    return by.select(query, F.posexplode("r.got").alias("pos", key)).withColumn("pos", F.col("pos") + 1)


def context_order(chosen: DataFrame, query: str = "query_id") -> DataFrame:
    """(…, sid): statutes, judgments, procedures, forms; groups by their first member; parts in order.

    A group is a section of a law in a jurisdiction, else a document.
    """
    kind = F.coalesce(F.element_at(F.create_map(*[x for i, t in enumerate(("statute", "judgment", "procedure", "form")) for x in (F.lit(t), F.lit(i))]), F.col("doc_type")), F.lit(9))
    statute = F.col("doc_type") == "statute"
    same = Window.partitionBy(query, "doc_id", F.when(statute, F.coalesce("section", F.lit(""))), F.when(statute, F.coalesce("jurisdiction", F.lit(""))))
    d = chosen.withColumn("_seen", F.min("pos").over(same)).withColumn("_part", tx.part_number("locator", "para_start"))
    return d.withColumn("sid", F.row_number().over(Window.partitionBy(query).orderBy(kind, "_seen", "_part", "pos"))).drop("_seen", "_part")
