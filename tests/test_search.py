import math
import random

from pyspark.sql import functions as F

from folioscope.operators import fusion, search
from folioscope.operators import select as sel


def test_bm25_against_plain_python(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 40)))) for i in range(60)] + [(99, None)]
    qs = [("q1", "w1 w2 w2 the"), ("q2", "nothing"), ("q3", "w5")]
    got = {(r.query_id, r.chunk): r.score for r in search.bm25(spark.createDataFrame(qs, "query_id string, question string"), spark.createDataFrame(docs, "chunk bigint, text string"), "chunk", k=None).collect()}
    n, avg = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs)
    want = {}
    for q, text in qs:
        for t in {x for x in text.split() if x != "the"}:
            df = sum(t in (d or "").split() for _, d in docs)
            for k, d in docs:
                tf = (d or "").split().count(t)
                if tf:
                    want[q, k] = want.get((q, k), 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.split()) / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_dense_blocks_agree_with_one_block(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, None)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = d.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    a = sorted(map(tuple, search.dense(q, d, 5).collect()))
    assert a == sorted(map(tuple, search.dense(q, d, 5, query_block=3, block=16).collect())) and len(a) == 12 * 5


def test_rrf_values_and_pins(spark):
    rows = [("q", "dense", 1, 3, 1), ("q", "dense", 1, 1, 2), ("q", "dense", 1, 2, 3), ("q", "keyword", 2, 1, 1), ("q", "keyword", 2, 3, 2)]
    lists = spark.createDataFrame(rows, "query_id string, list_name string, list_seq int, chunk bigint, rank int")
    pins = spark.createDataFrame([("q", 9, 1)], "query_id string, chunk bigint, pin int")
    got = [(r.chunk, r.score, r.ranks) for r in fusion.rrf(lists, pins).orderBy("fused").collect()]
    assert [c for c, _, _ in got] == [9, 3, 1, 2] and got[0][1] == 0 and got[0][2] == {"exact": 1}
    assert abs(got[1][1] - (1 / 62 + 1 / 61)) < 1e-9 and got[1][2] == {"dense": 1, "keyword": 2}


def test_statute_slots(spark):
    rows = [("q", i, "judgment", 20 + i, i) for i in range(1, 12)] + [("q", 50, "statute", 1, 12)]
    d = spark.createDataFrame(rows, "query_id string, chunk bigint, doc_type string, fused int, final int")
    order = [r.chunk for r in fusion.statute_slots(d).orderBy("slot").collect()]
    assert order[7] == 50 and order[:7] == [1, 2, 3, 4, 5, 6, 7] and sorted(order[8:]) == [8, 9, 10, 11]
    far = d.withColumn("fused", F.when(F.col("chunk") == 50, 25).otherwise(F.col("fused")))
    assert [r.chunk for r in fusion.statute_slots(far).orderBy("slot").collect()] == [*range(1, 12), 50]


def test_budget_skips_what_does_not_fit(spark):
    d = spark.createDataFrame([("q", i, n, i) for i, n in enumerate([5, 9, 4, 1, 1])], "query_id string, chunk bigint, size int, rank int")
    assert [r.chunk for r in fusion.within_budget(d, "size", 10, 3).orderBy("pos").collect()] == [0, 2, 3]


def test_quota_selection_by_turns(spark):
    rows = [(f"d{i:02}", i % 3 == 0, i % 2 == 0, i) for i in range(20)]
    d = spark.createDataFrame(rows, "path string, a boolean, b boolean, day int")
    got = sel.by_quota(d, [("a", F.col("a")), ("b", F.col("b"))], 6, "path", [F.desc("day")]).orderBy("slot").collect()
    assert [(r.path, r.group) for r in got] == [("d18", "a"), ("d15", "a"), ("d12", "a"), ("d16", "b"), ("d14", "b"), ("d10", "b")]
    assert sel.by_quota(d, [("a", F.col("a"))], 50, "path", [F.desc("day")]).count() == 7


def test_as_of_takes_the_last_before(spark):
    left = spark.createDataFrame([("u", 1, 10), ("u", 5, 11), ("v", 5, 12)], "k string, t int, id bigint")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 21), ("u", 5, 22)], "k string, t int, id bigint")
    assert {r.id: r.matched for r in sel.as_of(left, right, "k", "t", "id").collect()} == {10: None, 11: 22, 12: None}


def test_phrases_keep_stop_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Under the Transfer of Property Act, 1882 it"), (2, "transfer property act 1882"), (3, None)], "chunk bigint, text string")
    names = spark.createDataFrame([("Transfer of Property Act, 1882",)], "name string")
    assert [r.chunk for r in search.phrases(docs, names, "chunk", "name").collect()] == [1]
    monkeypatch.setattr(search, "PHRASES", 0)
    assert [r.chunk for r in search.phrases(docs, names, "chunk", "name").collect()] == [1]


def test_large_batches_are_joined_to_the_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} w1") for i in range(50)], "chunk bigint, text string")
    qs = spark.createDataFrame([("a", "w1 w2"), ("b", "w5"), ("c", "none")], "query_id string, question string")
    want = sorted(map(tuple, search.bm25(qs, docs, "chunk", k=4, where=F.col("chunk") > 9).collect()))
    monkeypatch.setattr(search, "TERMS_BOUND", 1)
    assert sorted(map(tuple, search.bm25(qs, docs, "chunk", k=4, where=F.col("chunk") > 9).select("query_id", "chunk", "score", "rank").collect())) == sorted(map(tuple, search.bm25(qs, docs, "chunk", k=4, where=F.col("chunk") > 9).select("query_id", "chunk", "score", "rank").collect())) == want


def test_phrases_count_like_terms(spark):
    docs = [(1, "the deed of sale and the deed of sale"), (2, "sale of a deed"), (3, "deed of sale"), (4, "fence"), (5, None)]
    d = spark.createDataFrame(docs, "chunk bigint, text string")
    q = spark.createDataFrame([("q", "deed"), ("r", "of")], "query_id string, question string")
    p = spark.createDataFrame([("q", "Deed of Sale"), ("r", "Deed of Sale"), ("r", "  ")], "query_id string, phrase string")
    got = {(r.query_id, r.chunk): r.score for r in search.bm25(q, d, "chunk", k=5, phrases=p).collect()}
    toks = {k: (t or "").split() for k, t in docs}
    n, avg = 5, sum(map(len, toks.values())) / 5
    w = lambda df, tf, k: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[k]) / avg))
    want = {("q", 1): w(3, 2, 1) + w(2, 2, 1), ("q", 2): w(3, 1, 2), ("q", 3): w(3, 1, 3) + w(2, 1, 3), ("r", 1): w(2, 2, 1), ("r", 3): w(2, 1, 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_selection_of_judgments(spark):
    card = "<strong>Coram : A. B. RAO<sup data-tooltip=\"Author\">*</sup>, C. D. SEN</strong> on the %s"
    rows = [(f"p{i}", f"Case {i} v. State", f"{i:02}-03-2021", card % ("Deeds Act" if i % 2 else "Fences Act"), "ENG,HIN") for i in range(1, 9)]
    rows += [("old", "LANDMARK V. STATE", "01-01-2019", card % "none", "ENG"), ("nodate", "x", "soon", card % "Deeds Act", "ENG"), ("hin", "x", "09-03-2021", card % "Deeds Act", "HIN"), ("null", None, None, None, None)]
    m = spark.createDataFrame(rows, "path string, title string, decision_date string, raw_html string, available_languages string")
    got = {r.path: (r.group, r.matched_acts) for r in sel.judgments(m, [("deeds", "Deeds Act"), ("fences", "Fences Act")], 3, 2019, [(2019, ["LANDMARK"])]).collect()}
    assert got == {"p7": ("deeds", ["deeds"]), "p5": ("deeds", ["deeds"]), "p8": ("fences", ["fences"]), "old": ("landmark", [])}


def test_phrases_count_in_every_plan(spark, monkeypatch):
    docs = [(1, "the deed of sale and the deed of sale"), (2, "sale of a deed"), (3, "deed of sale"), (4, "fence of fence of fence"), (5, None)]
    d = spark.createDataFrame(docs, "chunk bigint, text string")
    q = spark.createDataFrame([("q", "deed"), ("r", "of"), ("s", "fence")], "query_id string, question string")
    p = spark.createDataFrame([("q", "Deed of Sale"), ("r", "Deed of Sale"), ("r", "  "), ("s", "fence of fence"), ("s", "fence"), ("s", None)], "query_id string, phrase string")
    found = lambda: sorted((r.query_id, r.chunk, r.score, r["rank"]) for r in search.bm25(q, d, "chunk", k=5, where=F.col("chunk") != 2, phrases=p).collect())
    want = found()
    for name, bound in (("TERMS_BOUND", 1), ("PHRASES", 1)):
        with monkeypatch.context() as m:
            m.setattr(search, name, bound)
            assert found() == want
    with monkeypatch.context() as m:
        m.setattr(search.np, "unique", lambda x, **k: x[:0])  # as if two terms had one hash
        assert found() == want


def test_batches_of_any_size_stay_in_the_tasks(spark, monkeypatch):
    random.seed(5)
    words = [f"w{int(random.paretovariate(0.5)) % 40}" for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 19 : i * 19 + i % 19])) for i in range(200)], "chunk bigint, text string")
    qs = spark.createDataFrame([(f"q{i}", " ".join(f"w{(i * 7 + j) % 45}" for j in range(i % 6))) for i in range(40)], "query_id string, question string")
    held = F.col("chunk") % 3 == 0
    said = lambda **x: sorted((r.query_id, r.chunk, r.score, r["rank"], r.matched, r.third) for r in search.bm25(qs, docs, "chunk", k=5, where=F.col("chunk") % 2 == 0, flags={"third": held}, matched=True, **x).collect())
    with monkeypatch.context() as m:  # as with more different phrases than PHRASES: joined to the postings
        m.setattr(search, "PHRASES", -1)
        want = said()
    monkeypatch.setattr(search, "TERMS_BOUND", 1)
    monkeypatch.setattr(search, "_joined", None)
    assert said() == want and len(want) > 100
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "BLOCK_TERMS", 9)
    assert said() == want


def test_counts_in_a_band_without_its_pairs(spark):
    random.seed(6)
    rows = [(random.choice([1, 2, 3, i, i, i, None]), random.choice(["a", "b", None]), random.choice([None, 2.0, 4.0, round(random.uniform(-5, 5), 1), round(random.uniform(-5, 5), 1)])) for i in range(10, 160)]
    rows += [(900, "a", 2 - 2**-52), (901, "a", 4.0), (902, "c", 7.0)]
    d = spark.createDataFrame(rows, "k int, brand string, price double")
    want = {}
    for k, b, v in rows:
        if None not in (k, b, v) and (n := sum(c == b and j is not None and j != k and w is not None and v - 2 <= w <= v + 2 for j, c, w in rows)):
            want[k] = want.get(k, 0) + n
    got = sel.band_counts(d, "k", ["brand"], "price", 2.0).collect()
    assert {r.k: r.n for r in got} == want and len(got) == len(want)


def test_a_band_of_many_equal_values(spark, tmp_path):
    from folioscope.queries import relational

    spark.range(200_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "9.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in relational.range_join(spark, str(tmp_path)).groupBy("n").count().collect()] == [(199_999, 200_000)]
