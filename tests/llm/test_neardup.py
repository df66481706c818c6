import random

from folioscope.llm import neardup


def grams(t, width=3):
    w = neardup.words_of(t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, threshold=0.6, least=20):
    rows = sorted({(k, t) for k, t in rows if t and len(neardup.words_of(t)) >= least})
    sets = [(k, grams(t)) for k, t in rows]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a != b and len(x & y) >= threshold * len(x | y) - 1e-9}


def corpus(n=120, seed=4):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(n):
        base = [random.choice(words) for _ in range(random.randint(18, 120))]
        for _ in range(random.choice([1, 1, 2, 3])):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                at = random.randrange(len(t))
                random.choice([lambda: t.insert(at, "new"), lambda: t.pop(at), lambda: t.__setitem__(at, "other")])()
            k += 1
            rows.append((k, " ".join(t).title() if random.random() < 0.2 else "\n".join(t)))
    return rows


def check(spark, rows, few=None):
    df = spark.createDataFrame(rows, "rowid bigint, text string").selectExpr("*", "1 AS a", "2 AS class", "3 AS band")
    got = {(r.rowid_a, r.rowid_b) for r in neardup.pairs(df, "rowid").collect()}
    assert got == brute(rows)
    return got


def test_against_brute_force(spark):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "too short"), (1003, "w " * 19)]
    assert len(check(spark, [*rows, rows[0]])) > 50
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[0][1])], "rowid bigint, text string")
    assert {(r.rowid_a, r.rowid_b) for r in neardup.pairs(df, "rowid").collect()} == brute(rows)


def test_copies_and_very_long_texts(spark):
    base = " ".join(f"c{i}" for i in range(30))
    long = " ".join(f"z{i % 5000}" for i in range(60_000))
    rows = [(i, base) for i in range(40)] + [(100, base + " tail"), (200, long), (201, long + " end")]
    got = check(spark, rows)
    assert len(got) == 40 * 39 // 2 + 40 + 1


def test_hot_buckets(spark, monkeypatch):
    """Many different texts that share buckets, block against block."""
    base = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"edit{i}", *base[i % 60 :]])) for i in range(90)]
    plain = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda s, t: plain(s, t, few=8))
    whole = neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda hot, t: whole(hot, t, block=16))
    check(spark, rows)


def test_groups(spark):
    rows = corpus(40, 7)
    got = {r.rowid: r for r in neardup.groups(spark.createDataFrame(rows, "rowid bigint, text string"), "rowid").collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in rows if (w := neardup.words_of(t))}
    link = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in link:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: got[k].group_id for k in got} == {k: root(k) for k in sets}


def test_empty_table(spark):
    assert neardup.pairs(spark.createDataFrame([], "rowid bigint, text string"), "rowid").count() == 0


def test_estimate_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (4000, neardup.HASHES * neardup.BITS // 8), dtype=np.uint8)
    assert abs(neardup.estimate(a, rng.permutation(a)).mean()) < 0.01 and (neardup.estimate(a, a) == 1).all()


def test_a_bucket_of_a_third_of_all_rows_with_every_way_of_counting(spark):
    rows = [(i if i % 3 else 0, i) for i in range(900)]
    df = spark.createDataFrame(rows, "bucket bigint, item bigint").selectExpr("*", "'x' AS n", "1 AS _blocks")
    want = {(a, b) for a in range(0, 900, 3) for b in range(a + 3, 900, 3)}
    for hot, every, bound in ((10_000, 100, 10), (20, 1, 10), (100, 10, 10), (2, 1, 0)):
        got = [(r.a, r.b) for r in neardup.pairs_within(df, "bucket", "item", 64, hot, every, bound).collect()]
        assert len(got) == len(want) and set(got) == want
