"""Problem 2: near-duplicate texts, by b-bit MinHash.

Texts with the same words in the same order are one class, and only classes are compared. A class keeps HASHES minima
over its word sequences; bands of ROWS minima that agree make two classes a candidate pair. Of each minimum BITS low bits
are kept and packed; the share of equal ones, corrected for those that agree by chance, estimates the similarity, and pairs
far below the threshold are dropped. The rest is checked exactly on the texts.

With 28 bands of 3 minima a pair of similarity 0.6 is found with probability 0.999, one of 0.7 with 0.99999; the margin
of the estimate is over four standard deviations.

Rows of hot buckets and classes are never gathered by bucket (`with_sizes`) and are joined in blocks (`pairs_within`), so that none is
gathered in one task. Classes are told apart by 64-bit hashes. Defined results: rows without a key are in no pair and no group; null, empty and short texts (under `least` words) are in no pair; rows
delivered twice under one id are one row.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.blocks import mapped, mixed
from folioscope.llm.graph import components
from folioscope.session import staged

BANDS, ROWS, BITS = 28, 3, 4
HASHES = BANDS * ROWS
#: How far below the threshold an estimate may lie: over four standard deviations of the mean of HASHES trials.
MARGIN = 0.26
#: Classes in candidate pairs up to which these are sent to the texts, not the texts to them.
HEADS_BOUND = 500_000
#: Pairs of a cell of the exact check; their texts and word sequences are in a worker's memory at once.
PER_CELL = 500
#: Rows from which a bucket counts as hot, and the share of items, one in so many, among which hot buckets are looked for.
HOT, EVERY = 10_000, 100
PARTS = re.compile(r"[ \t\r\n]+")
_random = np.random.default_rng(20240607)
A = _random.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)
C = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return [w for w in PARTS.split(text.lower()) if w] if text else []


def _sequences(words: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of all texts, and where each text's begin; a text shorter than `width` has one of all its words."""
    flat = [w for ws in words for w in ws]
    codes, uniques = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    h = pd.util.hash_array(np.array(list(uniques), object), categorize=False).astype(np.uint64)[codes] if flat else np.zeros(0, np.uint64)
    n = np.array([len(ws) for ws in words], np.int64)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    m = np.maximum(n - width + 1, np.minimum(n, 1))
    starts = np.concatenate(([0], np.cumsum(m)))
    at = np.repeat(first - starts[:-1], m) + np.arange(starts[-1])
    stop = np.repeat(first + n, m)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = at + k
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(here < stop, h[np.minimum(here, max(len(h) - 1, 0))], np.uint64(k)) if len(h) else out)
    return out, starts


def signed(df: DataFrame, key: str, text: str = "text", least: int = 20, width: int = 3) -> DataFrame:
    """(key, class, bands array<bigint>, low binary) of the texts with at least `least` words."""

    def run(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        import xxhash

        words = [words_of(t) for t in texts]
        rows = np.array([i for i, w in enumerate(words) if len(w) >= least], np.int64)
        words = [words[i] for i in rows]
        classes = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for w in words], np.uint64).view(np.int64)
        if not len(rows):
            return rows, [pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.binary())]
        grams, starts = _sequences(words, width)
        x = grams & np.uint64(0xFFFFFFFF)
        minima = np.empty((len(rows), HASHES), np.uint64)
        for k in range(HASHES):
            y = x * A[k] + C[k]
            y ^= y >> np.uint64(29)
            minima[:, k] = np.minimum.reduceat(y & np.uint64(0xFFFFFFFF), starts[:-1])
        keys = np.empty((len(rows), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(rows), b + 1, np.uint64)
            for r in range(ROWS):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, b * ROWS + r])
            keys[:, b] = h
        low = (minima & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(rows), -1), axis=1)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        return rows, [pa.array(classes), bands, pa.array([p.tobytes() for p in packed], pa.binary())]

    return mapped(df, [key], text, "class bigint, bands array<bigint>, low binary", run)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by packed signatures: equal cells, less those equal by chance."""
    differ = np.unpackbits(a ^ b, axis=1).reshape(len(a), HASHES, BITS).any(axis=2)
    c = 2.0**-BITS
    return ((~differ).mean(axis=1) - c) / (1 - c)


def with_sizes(df: DataFrame, bucket: str, item: str, hot: int = HOT, every: int = EVERY, bound: int = HEADS_BOUND) -> DataFrame:
    """df with `n`, the rows of its bucket, without the rows that are alone in theirs.

    Hot buckets are looked for among the items of one hash in `every`, and only decide the way: their rows stay where they are
    and get sizes that were counted before a shuffle and are broadcast; the rows of the others are shuffled by bucket once.
    """
    seen = df.where(F.pmod(F.xxhash64(F.col(item), F.lit(77)), F.lit(every)) == 0).groupBy(bucket).agg(F.count("*").alias("n"))
    large = staged(seen.where(F.col("n") >= max(1, hot // every // 2)).select(bucket), "hot")
    n = large.limit(bound + 1).count()
    if n > bound:
        return df.join(df.groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1"), bucket)  # so many that each is small beside the whole
    rest = df if not n else df.join(F.broadcast(large), bucket, "left_anti")  # checked, as below
    counted = rest.withColumn("n", F.count("*").over(Window.partitionBy(bucket))).where("n > 1")
    if not n:
        return counted
    sizes = df.join(F.broadcast(large), bucket, "left_semi").groupBy(bucket).agg(F.count("*").alias("n")).where("n > 1")
    return counted.unionByName(df.join(F.broadcast(sizes), bucket).select(*counted.columns))


def pairs_within(df: DataFrame, bucket: str, item: str, block: int = 256, hot: int = HOT, every: int = EVERY, bound: int = HEADS_BOUND) -> DataFrame:
    """(a, b), a < b: items that share a bucket, each pair once per bucket.

    A bucket is cut into blocks of about `block` items by hash, and each item meets the blocks not before its own, so a
    bucket of m items is spread over (m / block)^2 / 2 keys, whatever m is.
    """
    many = with_sizes(df.select(bucket, item), bucket, item, hot, every, bound).withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64(F.col(item)), F.col("_blocks")).cast("int")
    many = many.withColumn("_own", own)
    left = many.select(bucket, F.col(item).alias("a"), F.col("_own").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_y"))
    right = many.select(bucket, F.col(item).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_x"), F.col("_own").alias("_y"))
    return left.join(right, [bucket, "_x", "_y"]).where("a < b").select("a", "b")


def _compared(hot: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(a, b): pairs of one hot bucket whose estimate isn't far below the threshold, block against block in numpy."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    rows = hot.select("band", "class", "low", blocks.alias("m"), own.alias("own"))
    left = rows.select("band", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("m") - 1)).alias("y"), "class", "low")
    # fresh names, as both sides come from the same rows
    right = rows.select(F.col("band").alias("to_band"), F.explode(F.sequence(F.lit(0), "own")).alias("to_x"), F.col("own").alias("to_y"), F.col("class").alias("to"), F.col("low").alias("to_low"))

    def of(pdf: pd.DataFrame, name: str, low: str) -> tuple[np.ndarray, np.ndarray]:
        packed = np.frombuffer(b"".join(pdf[low]), np.uint8).reshape(len(pdf), -1)
        return pdf[name].to_numpy(np.int64), np.stack((packed >> 4, packed & 15), axis=2).reshape(len(pdf), -1)

    def compare(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        (a, la), (b, lb) = of(p, "class", "low"), of(q, "to", "to_low")
        new = a[:, None] < b[None, :] if key[1] == key[2] else np.ones((len(a), len(b)), bool)
        same = np.zeros((len(a), len(b)), np.uint8)
        for c in range(HASHES):
            same += la[:, c, None] == lb[None, :, c]
        chance = 2.0**-BITS
        i, j = np.nonzero(new & ((same / HASHES - chance) / (1 - chance) >= threshold - MARGIN))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    return left.groupBy("band", "x", "y").cogroup(right.groupBy("to_band", "to_x", "to_y")).applyInPandas(compare, "a bigint, b bigint")


def candidates(s: DataFrame, threshold: float, few: int = 64) -> DataFrame:
    """(a, b) of classes that share a bucket and whose estimate isn't far below the threshold."""
    # equal in a class; a class of any size is one row before the bands are spread
    classes = staged(s.groupBy("class").agg(F.first("bands").alias("bands"), F.first("low").alias("low")), "classes")
    bands = classes.select(F.explode(F.array_distinct("bands")).alias("band"), "class")
    shared = staged(with_sizes(bands, "band", "class"), "shared")
    small = shared.where(F.col("n") <= few)
    pairs = small.select("band", F.col("class").alias("a")).join(small.select("band", F.col("class").alias("b")), "band").where("a < b").select("a", "b").distinct()
    low = classes.select("class", "low")
    both = pairs.join(low.select(F.col("class").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("class").alias("b"), F.col("low").alias("low_b")), "b")

    def near(batches):
        for x in batches:
            if x.num_rows:
                la, lb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("low_a", "low_b"))
                yield x.filter(pa.array(estimate(la, lb) >= threshold - MARGIN)).select(["a", "b"])

    close = both.mapInArrow(near, "a bigint, b bigint")
    hot = shared.where(F.col("n") > few).join(low, "class")
    return close.unionByName(_compared(hot, threshold)).distinct()


def linked_classes(s: DataFrame, df: DataFrame, key: str, text: str, threshold: float, width: int) -> DataFrame:
    """(a, b, similarity): pairs of different classes of at least the threshold, of the signed rows `s` of df.

    The exact check goes over cells of a square of hashes: a text is sent once to each cell that holds a pair of it,
    not once for each pair.
    """
    close = staged(candidates(s, threshold), "close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    heads = staged(s.select("class", key).join(wanted, "class", "left_semi").groupBy("class").agg(F.min(key).alias(key)), "heads")
    if heads.count() <= HEADS_BOUND:
        heads = F.broadcast(heads)  # checked; beyond the bound the texts are shuffled to them
    texts = df.select(key, F.col(text).alias("t")).join(heads, key).dropDuplicates(["class"]).select("class", "t")
    side = max(1, int((close.count() / PER_CELL) ** 0.5))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    placed = close.select("a", "b", cell(F.col("a")).alias("x"), cell(F.col("b")).alias("y"))
    needs = placed.select(F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.explode(F.array("a", "b")).alias("class")).distinct().join(texts, "class")

    def exact(key_: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for c, t in zip(q["class"].to_numpy(np.int64), q["t"], strict=True):
            w = [sys.intern(x) for x in words_of(t)]  # the same words come in many texts
            sets[c] = frozenset(zip(*(w[k:] for k in range(width)), strict=False)) or frozenset([tuple(w)])
        a, b, sim = [], [], []
        for i, j in zip(p["a"].to_numpy(np.int64), p["b"].to_numpy(np.int64), strict=True):
            common = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - common
            if common >= threshold * union - 1e-9:
                a.append(i)
                b.append(j)
                sim.append(common / union)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "similarity": np.array(sim, float)})

    return placed.groupBy("x", "y").cogroup(needs.groupBy("to_x", "to_y")).applyInPandas(exact, "a bigint, b bigint, similarity double")


def prepared(df: DataFrame, key: str, text: str, least: int, width: int) -> DataFrame:
    return staged(signed(df.where(F.col(key).isNotNull()), key, text, least, width), "signed")


def pairs(df: DataFrame, key: str, text: str = "text", threshold: float = 0.6, least: int = 20, width: int = 3) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of rows of at least the threshold, those of equal texts too."""
    s = prepared(df, key, text, least, width)
    links = staged(linked_classes(s, df, key, text, threshold, width), "links")
    members = s.select("class", key).distinct()
    apart = links.join(members.select(F.col("class").alias("a"), F.col(key).alias("x")), "a").join(members.select(F.col("class").alias("b"), F.col(key).alias("y")), "b")
    apart = apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = pairs_within(members, "class", key)
    return apart.unionByName(same).select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def groups(df: DataFrame, key: str, text: str = "text", threshold: float = 0.8, least: int = 5, width: int = 5) -> DataFrame:
    """(key, class_id, group_id, copies, links) of every row with at least `least` words.

    class_id is the least key of the rows with the same words, group_id that of the rows linked directly or through
    others; copies counts the rows of the class, links the other classes at or over the threshold.
    """
    s = prepared(df, key, text, least, width)
    links = staged(linked_classes(s, df, key, text, threshold, width), "links")
    joined = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    rows = s.select("class", key).distinct()
    classes = rows.groupBy("class").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    classes = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left")
    classes = classes.select("class", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("component", "class").alias("component"))
    heads = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return rows.join(classes.join(heads, "component"), "class").select(key, "class_id", "group_id", "copies", "links")
