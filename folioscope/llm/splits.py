"""Problem 6: train, dev and test sets that keep related records together.

Units are the connected components of records that share a group or a citation. Units of equal size and label profile are
a bundle. A bundle's own shares of rows cost nothing and those of all bundles just fill the quotas, so they are the min-cost
flow of rows. What rounding them down to whole units leaves over is routed by a flow of whole units, size by size, in which
bundles that differ by their labels alone are one node: it says how many of their units each split takes, these are dealt to
the bundles in turn, in seeded hash order, and so are the units of a bundle to the splits. Thus no number of bundles changes
the rule, and the driver sees only the pairs of size and units that occur.

Defined results: identical duplicate rows count once; null, empty and blank groups and citations relate nothing; a record
related to none is a unit of its own; an empty table gives an empty result. Units larger than a quota are put whole into
the split with the most room.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.flow import Flow
from folioscope.llm.graph import components
from folioscope.llm.ranks import running
from folioscope.session import staged

SHARES = (("train", 0.8), ("dev", 0.1), ("test", 0.1))
#: Kinds of units (size, label profile) up to which their shares are broadcast; more are joined by a shuffle, with equal results.
BUNDLES_BOUND = 2_000


def relations(gold: DataFrame) -> DataFrame:
    """(id, tie): what a record may share with others; spellings are made even."""
    # TESTDATA.md: group trimmed and lower-cased; citations without blanks, lower-cased
    group = F.when(F.trim("group") != "", F.concat(F.lit("g:"), F.lower(F.trim("group"))))
    cites = F.transform(F.col("expected_sources"), lambda s: F.lower(F.regexp_replace(s["neutral_citation"], r"\s+", "")))
    cites = F.transform(F.filter(cites, lambda c: c.isNotNull() & (c != "")), lambda c: F.concat(F.lit("c:"), c))
    ties = F.concat(F.filter(F.array(group), lambda g: g.isNotNull()), F.coalesce(cites, F.array().cast("array<string>")))
    return gold.where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct(ties)).alias("tie")).distinct()


def units(gold: DataFrame) -> DataFrame:
    """(id, unit) of each distinct id."""
    ties = relations(gold)
    found = components(ties.select(F.concat(F.lit("i:"), "id").alias("a"), F.col("tie").alias("b")))
    own = found.where(F.col("node").startswith("i:")).select(F.expr("substring(node, 3)").alias("id"), "component")
    ids = gold.where(F.col("id").isNotNull()).select("id").distinct()
    return ids.join(own, "id", "left").select("id", F.coalesce("component", F.concat(F.lit("i:"), F.col("id"))).alias("unit"))


def leaking(gold: DataFrame) -> DataFrame:
    """(id): records whose unit now holds two different splits."""
    u = units(gold)
    # TESTDATA.md: splits trimmed and lower-cased, nulls ignored
    now = gold.select("id", F.lower(F.trim("split")).alias("now"))
    bad = u.join(now, "id").groupBy("unit").agg(F.min("now").alias("a"), F.max("now").alias("b")).where("a != b").select("unit")
    return u.join(bad, "unit", "left_semi").select("id").distinct()


def _own(units: int, shares: tuple) -> list[float]:
    """A bundle's own shares of its units."""
    whole = math.fsum(share for _, share in shares)
    return [units * share / whole for _, share in shares]


def _floors(units: int, shares: tuple) -> list[int]:
    return [math.floor(x + 1e-9) for x in _own(units, shares)]


def quotas(bundles: list[tuple[int, int]], shares: tuple = SHARES, kinds: list[int] | None = None) -> list[list[int]]:
    """Units for each split of each entry of `bundles` (size, units); `kinds` says how many such bundles an entry stands for."""
    kinds = kinds or [1] * len(bundles)
    total = sum(s * n * m for (s, n), m in zip(bundles, kinds, strict=True))
    lack = dict(zip((name for name, _ in shares), _own(total, shares), strict=True))
    whole, alike = [], {}
    for e, ((s, n), m) in enumerate(zip(bundles, kinds, strict=True)):
        floors = _floors(n, shares)
        whole.append([x * m for x in floors])
        for name, x in zip(lack, floors, strict=True):
            lack[name] -= x * m * s
        if left := n - sum(floors):
            parts = tuple(round(x - f, 9) for x, f in zip(_own(n, shares), floors, strict=True))
            alike.setdefault(s, {}).setdefault((left, parts), []).append(e)
    for size in sorted(alike, reverse=True):
        same = dict(enumerate(alike[size].items()))
        many = {c: sum(kinds[e] for e in es) for c, (_, es) in same.items()}
        sent = rounded({c: left * many[c] for c, ((left, _), _) in same.items()}, size, {c: dict(zip(lack, parts, strict=True)) for c, ((_, parts), _) in same.items()}, lack, many)
        for c, (_, es) in same.items():
            at = 0
            for k, name in enumerate(lack):
                to, first = at + sent[c, name], 0
                for e in es:
                    whole[e][k] += _dealt(to, many[c], first, kinds[e]) - _dealt(at, many[c], first, kinds[e])
                    first += kinds[e]
                at = to
        for (_, name), n in sent.items():
            lack[name] -= n * size
    return whole


def _dealt(cards: int, players: int, first: int, some: int) -> int:
    """How many of so many cards, dealt to the players in turn, the `some` players from `first` on get."""
    return cards // players * some + min(max(cards % players - first, 0), some)


def rounded(left: dict[int, int], size: int, parts: dict[int, dict[str, float]], lack: dict[str, float], kinds: dict[int, int] | None = None) -> dict[tuple[int, str], int]:
    """Whole units (bundle, split) of the units of one size that rounding down has left over, by a min-cost flow of units.

    Capacities are whole, so the flow is: each further unit in a split costs what it adds to |rows given - rows wanted|, and
    among equals a unit goes where its bundle's flow was cut most. A bundle of `kinds` stands for so many that are cut alike:
    dealt in turn, no one of them gets two units in a split while another has none, so the costs are those of single ones.
    """
    kinds = kinds or dict.fromkeys(left, 1)
    grain = 2.0 ** min(36, 48 - size.bit_length())

    def even(cost: float) -> float:
        # a multiple of a power of two, so that sums of costs are exact and no way round looks cheaper than none
        return round(cost * grain) / grain

    net, edges, n = Flow(), {}, sum(left.values())
    for b, k in left.items():
        net.edge("units", ("bundle", b), k)
        for name in lack:
            edges[b, name] = [net.edge(("bundle", b), name, kinds[b], even(1e-3 * (1 - parts[b][name]))), net.edge(("bundle", b), name, k, even(2e-3))]
    for name, rows in lack.items():
        # convex: units that a split lacks gain their size, the one across its quota less, the rest lose it
        fits = min(n, max(0, math.floor(rows / size)))
        net.edge(name, "out", fits, size)
        net.edge(name, "out", 1, even(2 * size + abs(rows - (fits + 1) * size) - abs(rows - fits * size)))
        net.edge(name, "out", n, 3 * size)
    net.solve("units", "out")
    return {key: round(sum(net.flow_of(e) for e in es)) for key, es in edges.items()}


def assigned(gold: DataFrame, label: str = "language", seed: int = 17, shares: tuple = SHARES) -> DataFrame:
    """(id, unit, size, new_split)."""
    spark = gold.sparkSession
    u = staged(units(gold), "units")
    labels = gold.groupBy("id").agg(F.min(F.coalesce(F.col(label).cast("string"), F.lit(""))).alias("label"))
    per = u.join(labels, "id").groupBy("unit", "label").agg(F.count("*").alias("n"))
    profile = F.array_sort(F.collect_list(F.struct("label", "n")))  # one entry per label
    one = per.groupBy("unit").agg(F.sum("n").alias("size"), F.to_json(profile).alias("profile"))
    one = staged(one, "sizes")
    kinds = staged(one.groupBy("size", "profile").agg(F.count("*").alias("units")), "kinds")
    # at least size x units rows stand behind each entry, so that entries grow as the root of the rows times their logarithm
    equal = kinds.groupBy("size", "units").agg(F.count("*").alias("kinds")).orderBy(F.desc("size"), F.desc("units")).collect()
    whole = quotas([(r["size"], r["units"]) for r in equal], shares, [r["kinds"] for r in equal])
    rows = []
    for r, counts in zip(equal, whole, strict=True):
        floors = _floors(r["units"], shares)
        over = [n - x * r["kinds"] for n, x in zip(counts, floors, strict=True)]
        rows.append((*r, list(accumulate(floors)), list(accumulate(over))))
    dealt = spark.createDataFrame(rows, "size bigint, units bigint, kinds bigint, floors array<bigint>, over array<bigint>")
    # the ranks at which each split ends: whole shares, and of the units left over those that fall to the kind in its turn
    ends = F.expr("zip_with(floors, over, (f, o) -> f + (o - nth + kinds - 1) div kinds)")
    turns = running(kinds, ["size", "units"], seed, "profile", None, "nth").join(F.broadcast(dealt), ["size", "units"])
    turns = turns.select("size", "profile", ends.alias("ends"))
    few = kinds.limit(BUNDLES_BOUND + 1).count() <= BUNDLES_BOUND
    ranked = running(one, ["size", "profile"], seed, "unit", None, "rank")
    placed = ranked.join(F.broadcast(turns) if few else turns.hint("merge"), ["size", "profile"])
    names = F.array(*[F.lit(name) for name, _ in shares])
    placed = placed.withColumn("new_split", F.get(names, F.size(F.filter("ends", lambda e: e <= F.col("rank")))))
    return u.join(placed.select("unit", "size", "new_split"), "unit").select("id", "unit", "size", "new_split")
