"""Results that must not depend on how large the tables are."""

from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.plans import answer
from folioscope.queries import ledger, pipeline


def stored(spark, where, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_redelivered_rows_are_known_by_a_flag(spark, tmp_path):
    rows = [(1_000_007, 1, "a", "x"), (2_000_000, 2, "a", "y"), (3, 5, "a", "z"), (1_000_003, 5, "b", "z")]
    sf = stored(spark, tmp_path, chunks=(rows, "rowid bigint, doc_id bigint, locator string, text string"))
    assert {(r.fresh, r.n, r.docs) for r in ledger.replace_documents(spark, sf).collect()} == {(False, 2, 2), (True, 1, 1)}


def test_passages_with_long_numbers_stay_apart(spark):
    texts = ["rent rent rent due", "rent", *["other matter entirely"] * 8]
    p = spark.createDataFrame([("u", 1_000_000 + i, t, len(t.split())) for i, t in enumerate(texts)], "doc_id string, n bigint, text string, words int")
    t = spark.createDataFrame([("q", "When is rent due?", "u")], "query_id string, question string, doc_id string")
    assert [r.n for r in answer.selected_passages(p, t, 4, 0).collect()] == [1_000_000]


def test_answers_are_held_against_all_cited_chunks(spark, tmp_path):
    names = [f.name for f in spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").schema]
    chunks = spark.range(70).select(F.col("id").alias("rowid"), F.lit("statute").alias("doc_type"), F.lit("Deeds Act, 1908").alias("act_title"), F.lit("23").alias("section"), F.concat(F.lit("the parcel of lot "), "id", F.lit(" shall be fenced")).alias("text"))
    for c in names:
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    chunks.write.parquet(f"{tmp_path}/chunks.parquet")
    said = "It says “the parcel of lot 60 shall be fenced” of all lots [S61]."
    sf = stored(
        spark, tmp_path,
        phase1_acceptance=([(1, said, [("Deeds Act, 1908", "23")])], "result_id bigint, answer_markdown string, cited array<struct<act:string,section:string>>"),
        statutes=([("d", "The Deeds Act, 1908", "Deeds Act, 1908", ["Deeds Act"], None)], "id string, title string, short_title string, aliases array<string>, successor string"),
    )
    (r,) = pipeline.checked_answers(spark, sf).collect()
    assert (r.used, r.unknown, r.quotes, r.n_removed) == ("S61", "", "", 0)


def test_passages_of_other_documents_are_not_scored(spark, monkeypatch):
    texts = ["rent is due", "rent", "the deed of rent and rent", "fence", None]
    p = spark.createDataFrame([(f"u{d}", i, t, len((t or "").split())) for d in range(3) for i, t in enumerate(texts[d:])], "doc_id string, n bigint, text string, words int")
    t = spark.createDataFrame([("q", "When is rent due?", "u0"), ("q", "Rent of a fence?", "u2"), ("r", "fence rent", "u0")], "query_id string, question string, doc_id string")
    own = p.withColumn("pid", F.struct("doc_id", "n"))
    every = {(r.query_id, r.pid): r.score for r in search.bm25(t, own, "pid", k=None).collect()}
    monkeypatch.setattr(search, "_joined", None)
    pairs = t.select("query_id", "doc_id").join(own, "doc_id")
    got = {(r.query_id, r.pid): r.score for r in search.bm25_of(t, pairs, own, "pid").collect()}
    asked = {(r.query_id, r.pid) for r in pairs.collect()}
    assert got == {k: v for k, v in every.items() if k in asked} and 0 < len(got) < len(every)
    chosen = sorted(map(tuple, answer.selected_passages(p, t, 4, 0).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(answer, "bm25_of", lambda q, pairs, docs, key: search.bm25(q, docs, key, k=None))
    assert chosen == sorted(map(tuple, answer.selected_passages(p, t, 4, 0).collect())) != []
