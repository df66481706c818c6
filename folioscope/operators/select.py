"""Joins that aren't on equality, and selection of documents by quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues of legal text, as patterns that both engines read alike.
CUES = {"acts": "[A-Z][a-z]+ Act", "sections": "[Ss]\\. ?[0-9]+", "quotes": "“", "money": "Rs\\. ?[0-9]", "case_names": "[A-Z][a-z]+ v\\. [A-Z]"}


def banded(df: DataFrame, key: str, equal: list[str], value: str, width: float) -> DataFrame:
    """(key, other): rows of equal keys whose values differ by at most `width`, by bins of that width.

    A row meets only the bins beside its own, so the join stays an equality join.
    """
    bin_ = F.floor(F.col(value) / width)
    left = df.select(*equal, F.col(key), F.col(value).alias("_v"), F.explode(F.sequence(bin_ - 1, bin_ + 1)).alias("_b"))
    right = df.select(*equal, F.col(key).alias("other"), F.col(value).alias("_w"), bin_.alias("_b"))
    return left.join(right, [*equal, "_b"]).where((F.col(key) != F.col("other")) & F.col("_w").between(F.col("_v") - width, F.col("_v") + width)).select(key, "other")


def band_counts(df: DataFrame, key: str, equal: list[str], value: str, width: float) -> DataFrame:
    """(key, n): how many rows `banded` would give a key, without making them; keys that it gives none don't come out.

    Rows of equal values are counted first. A value's band is what a running count gained from its lower to its upper end; the
    counts run over bins of the width, with the points of the bins beside, so that no group is sorted as a whole.
    """
    d = df.select(*equal, key, F.col(value).alias("_v")).dropna()
    points = d.groupBy(*equal, "_v").agg(F.count("*").alias("_c"))
    bin_ = F.floor(F.col("_v") / width)
    end = lambda kind, at: points.select(*equal, bin_.alias("_b"), at.alias("_at"), F.lit(kind).alias("_kind"), "_v", F.lit(0).cast("bigint").alias("_c"))
    inside = points.select(*equal, F.explode(F.sequence(bin_ - 2, bin_ + 1)).alias("_b"), F.col("_v").alias("_at"), F.lit(1).alias("_kind"), "_v", "_c")
    both = end(0, F.col("_v") - width).unionByName(inside).unionByName(end(2, F.col("_v") + width))
    run = F.sum("_c").over(Window.partitionBy(*equal, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_run", run).where("_kind != 1").groupBy(*equal, "_v").agg(F.sum(F.when(F.col("_kind") == 2, F.col("_run")).otherwise(-F.col("_run"))).alias("_near"))
    # less those of the same key
    by = ", ".join(f"`{c}`" for c in (*equal, key))
    own = F.expr(f"count(*) OVER (PARTITION BY {by} ORDER BY _v RANGE BETWEEN {float(width)}D PRECEDING AND {float(width)}D FOLLOWING)")
    return d.withColumn("_own", own).join(near, [*equal, "_v"]).groupBy(key).agg(F.sum(F.col("_near") - F.col("_own")).alias("n")).where("n > 0")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, key: str) -> DataFrame:
    """left with `matched`, the key of the last right row of the same `by` at or before it (of ties the greatest key).

    One union and one window; nothing is multiplied.
    """
    both = left.select(by, time, F.col(key), F.lit(None).cast(right.schema[key].dataType).alias("_k"), F.lit(1).alias("_side"))
    both = both.unionByName(right.select(by, time, F.lit(None).cast(left.schema[key].dataType).alias(key), F.col(key).alias("_k"), F.lit(0).alias("_side")))
    w = Window.partitionBy(by).orderBy(time, "_side", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("matched", F.last("_k", ignorenulls=True).over(w)).where("_side = 1").drop("_k", "_side")


def by_quota(candidates: DataFrame, patterns: list[tuple[str, Column]], limit: int, key: str, newest: list[Column]) -> DataFrame:
    """(key, group, slot): up to `limit` documents, first ceil(limit / groups) of each group in turn, newest first,
    skipping what is taken; then the groups in turns until the limit.

    Only the newest `limit` of each group can be chosen, so no more than that many of each reach the driver.
    """
    per = -(-limit // len(patterns))
    lists: list[list] = []
    for _, flag in patterns:
        lists.append([r[0] for r in candidates.where(flag).orderBy(*newest, key).limit(limit).select(key).collect()])
    seen: dict = {}
    for (name, _), ids in zip(patterns, lists, strict=True):
        n = 0
        for x in ids:
            if n == per or len(seen) == limit:
                break
            if x not in seen:
                seen[x] = name
                n += 1
    at = [0] * len(lists)
    while len(seen) < limit:
        before = len(seen)
        for g, ids in enumerate(lists):
            while at[g] < len(ids) and ids[at[g]] in seen:
                at[g] += 1
            if at[g] < len(ids) and len(seen) < limit:
                seen[ids[at[g]]] = patterns[g][0]
        if len(seen) == before:
            break
    kind = candidates.schema[key].dataType.simpleString()
    return candidates.sparkSession.createDataFrame([(k, g, i + 1) for i, (k, g) in enumerate(seen.items())], f"`{key}` {kind}, `group` string, slot int")


def judgments(metadata: DataFrame, acts: list[tuple[str, str]], limit: int, min_year: int, landmarks: list[tuple[int, list[str]]] = ()) -> DataFrame:
    """The metadata of the chosen judgments, with `group` (the law or landmark they were chosen for), `slot` and `matched_acts`.

    Of those available in English with a readable date from `min_year` on: the newest by law, up to an equal quota each, then
    by turns. Landmarks (year, words of the title) come on top of the limit. Equal dates: by path. acts: (id, pattern).
    """
    from folioscope.functions.text import day_first_date, html_text

    d = metadata.withColumn("_date", day_first_date("decision_date")).withColumn("_text", html_text(F.coalesce("raw_html", F.lit(""))))
    d = d.where(F.coalesce("available_languages", F.lit("")).contains("ENG") & (F.year("_date") >= min_year))
    d = d.withColumn("matched_acts", F.array_compact(F.array(*[F.when(F.col("_text").rlike(p), F.lit(a)) for a, p in acts])))
    chosen = by_quota(d, [(a, F.array_contains("matched_acts", a)) for a, _ in acts], limit, "path", [F.desc("_date")])
    for n, (year, words) in enumerate(landmarks):
        has = d.where(F.year("_date") == year)
        for w in words:
            has = has.where(F.contains(F.upper("title"), F.lit(w)))
        more = has.join(chosen, "path", "left_anti").select("path", F.lit("landmark").alias("group"), F.lit(limit + n + 1).alias("slot"))
        chosen = chosen.unionByName(more)
    return d.join(F.broadcast(chosen), "path").drop("_text", "_date")  # the limit and the landmarks
