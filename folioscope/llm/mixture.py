"""Problem 9: a mixture in which each source has its target share of the tokens.

A document is a text; its sources are those that hold it, under whatever id. Documents of the same set of sources are
one pattern. The total is the largest at which every source that has documents can reach its share within its repeats (or
what is asked for, if less). Min-cost flow routes the tokens of the patterns to the sources' quotas, each further use of a
pattern costing more. The documents of a pattern lie on a circle in seeded hash order; the flows are consecutive arcs on
it, so each document is used as often as arcs begin at or pass its place, and uses differ by one at most. Last, what lies across
the ends of the arcs is made up for by single uses of the documents of nearest size.

Defined results: null, empty and blank-source documents have no part; repeated texts of a source count once; a source
without documents gets nothing and is reported with share 0, the others keep their proportions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.flow import Flow
from folioscope.llm.ranks import running
from folioscope.llm.tokens import with_counts
from folioscope.session import staged

SEED = 29
#: Sets of targeted sources that hold a common text.
PATTERNS_BOUND = 4_095


def routed(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[tuple[int, str], float], float]:
    """Tokens from each pattern (its number, a source) and the total; patterns are (sources, tokens)."""
    live = {s: targets[s] for ss, w in patterns for s in ss if w > 0 and s in targets and targets[s][0] > 0 and targets[s][1] > 0}
    scale = sum(share for share, _ in live.values())
    if not live:
        return {}, 0.0

    def attempt(size: float) -> tuple[dict[tuple[int, str], float], bool, float]:
        """(flows, whether all of `size` came through, the size that the cut in the way lets through)."""
        net, edges = Flow(), {}
        for p, (ss, w) in enumerate(patterns):
            inside = [s for s in ss if s in live]
            if not inside or w <= 0:
                continue
            net.edge("all", ("pattern", p), float(w) * min(live[s][1] for s in inside))
            for s in inside:
                edges[p, s] = [net.edge(("pattern", p), s, float(w), float(k * k)) for k in range(live[s][1])]
        for s, (share, _) in live.items():
            net.edge(s, "mix", size * share / scale)
        sent = net.solve("all", "mix")
        near = net.reach("all")
        open_shares = sum(share for s, (share, _) in live.items() if s in near) / scale
        fixed = sent - size * open_shares
        return {k: sum(net.flow_of(e) for e in v) for k, v in edges.items()}, sent >= size * (1 - 1e-9) - 1e-6, fixed / max(1 - open_shares, 1e-12)

    size = float(sum(w * max((live[s][1] for s in ss if s in live), default=0) for ss, w in patterns))
    if total is not None:
        size = min(size, float(total))
    # what lies in a cut's capacity without growing with the size bounds it; each cut is met once, so this ends
    for _ in range(2 ** min(len(live), 10) + 1):
        flows, full, least = attempt(size)
        if full or least >= size * (1 - 1e-12):
            break
        size = least
    return flows, size


def sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(text_key, doc_id, pattern array<string>, n_tokens), one row per distinct text of the targeted sources."""
    names = targets.select(F.trim("source").alias("source")).where("source != ''").distinct()
    d = documents.select("doc_id", "text", F.trim("source").alias("source")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    d = d.join(names, "source", "left_semi")
    counted = with_counts(d.select("doc_id", "source", F.sha2("text", 256).alias("text_key"), "text"))
    return counted.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.min("n_tokens").alias("n_tokens"))  # the set is bounded by the targets


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(source, doc_id, uses, n_tokens), one row per source and document used for it."""
    spark = documents.sparkSession
    texts = staged(sized(documents, targets), "sized")
    wanted = {r["source"].strip(): (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"]}  # a table of fixed size
    by_pattern = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("w")).orderBy("pattern")
    patterns = [(tuple(r["pattern"]), int(r["w"])) for r in by_pattern.limit(PATTERNS_BOUND + 1).collect()]
    if len(patterns) > PATTERNS_BOUND:  # ten targets have at most 1,023 sets
        raise ValueError("more sets of sources than the flow is solved for; give fewer targets")
    flows, _ = routed(patterns, wanted, total)
    rows = []
    for p, (ss, w) in enumerate(patterns):
        at = 0.0
        for s in ss:
            f = flows.get((p, s), 0.0)
            if f > 0.5:
                rows.append((list(ss), s, int(w), int(round(at)), int(round(at + f))))
                at += f
    arcs = spark.createDataFrame(rows, "pattern array<string>, source string, w bigint, lo bigint, hi bigint")
    placed = running(texts.where("n_tokens > 0"), ["pattern"], seed, "text_key", "n_tokens", "at")
    uses = F.expr("(hi - at + w - 1) div w - (lo - at + w - 1) div w")  # whole turns; at < w, so both are at least 0
    used = placed.join(F.broadcast(arcs), "pattern").select("source", "doc_id", uses.alias("uses"), "n_tokens").where("uses > 0")  # patterns x sources
    quota: dict[str, float] = {}
    for (_, s), f in flows.items():
        quota[s] = quota.get(s, 0.0) + f
    return levelled(used, texts, {s: (q, wanted[s][1]) for s, q in quota.items() if q > 0})


def levelled(used: DataFrame, texts: DataFrame, quota: dict[str, tuple[float, int]], rounds: int = 3) -> DataFrame:
    """Makes up for documents that lie across the ends of arcs: in each round each source gives up or takes on one use, of the
    document whose size comes nearest to what it has too much or too little, if that helps."""
    spark = used.sparkSession
    if not quota:
        return used
    small = F.broadcast(spark.createDataFrame([(s, float(q), c) for s, (q, c) in sorted(quota.items())], "source string, quota double, cap int"))  # the targets
    able = texts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode("pattern").alias("source")).join(small, "source")
    # joins by document are never broadcast: both sides grow with the documents
    caps = able.groupBy("doc_id").agg(F.min("cap").alias("least")).hint("merge")
    able = staged(able.join(caps, "doc_id"), "able")
    for _ in range(rounds):
        used = staged(used, "used")
        gaps = small.join(used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("got")), "source", "left").select("source", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("gap"))
        total = used.groupBy("doc_id").agg(F.sum("uses").alias("all_uses")).hint("merge")
        d = able.join(F.broadcast(gaps), "source").join(used.select("source", "doc_id", "uses").hint("merge"), ["source", "doc_id"], "left").join(total, "doc_id", "left").na.fill(0, ["uses", "all_uses"])
        step = F.when((F.col("gap") > 0) & (F.col("all_uses") < F.col("least")), 1).when((F.col("gap") < 0) & (F.col("uses") > 0), -1)
        d = d.withColumn("step", step).where("step is not null and abs(gap - step * n_tokens) < abs(gap)")
        pick = d.groupBy("source").agg(F.min_by(F.struct("doc_id", "n_tokens", "step"), F.struct(F.abs(F.col("gap") - F.col("step") * F.col("n_tokens")), "doc_id")).alias("p"))
        # two sources may pick the same document of both: the first of them keeps it
        pick = pick.groupBy("p.doc_id").agg(F.min(F.struct("source", "p.n_tokens", "p.step")).alias("q"))
        more = pick.select("q.source", "doc_id", F.col("q.step").cast("bigint").alias("uses"), "q.n_tokens")
        used = used.unionByName(more).groupBy("source", "doc_id").agg(F.sum("uses").alias("uses"), F.max("n_tokens").alias("n_tokens")).where("uses > 0")
    return used


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_uses, tokens, share) of every target."""
    got = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    everything = got.agg(F.sum("tokens").alias("everything"))
    t = targets.select(F.trim("source").alias("source"), "target_share", "max_repeats")
    out = t.join(got, "source", "left").crossJoin(everything)  # one row
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "most_uses", "tokens")]
    return out.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.try_divide("tokens", "everything"), F.lit(0.0)).alias("share"))
