from pyspark.sql import functions as F

from folioscope.streaming import ledger

M = "url string, seq bigint, sha256 string"


def test_upserts_resume_and_are_idempotent(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = lambda r: spark.createDataFrame(r, M).coalesce(1).write.mode("append").parquet(source)
    held = lambda: {r.url: (r.seq, r.sha256) for r in spark.read.parquet(out).collect()}
    sink = ledger.upsert(out, "url", "seq", 4)

    def run():
        ledger.follow(ledger.read(spark, source, M, 1), sink, mark).awaitTermination()

    rows([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")])
    run()
    rows([("a", 5, "x5"), ("c", 4, "w")])
    rows([("a", 3, "late")])
    run()
    want = {"a": (5, "x5"), "b": (2, "y"), "c": (4, "w")}
    assert held() == want
    run()
    assert held() == want
    # a batch that is run again after a failure changes nothing
    sink(spark.createDataFrame([("a", 5, "x5"), ("c", 4, "w")], M), 1)
    assert held() == want
    sink(spark.createDataFrame([], M), 9)
    assert held() == want


def test_windows_and_sessions(spark):
    e = spark.sql("select * from values (timestamp'2024-01-01 00:05:00', 'view', 1.0D, 7L), (timestamp'2024-01-01 00:59:00', 'view', 2.0D, 7L), (timestamp'2024-01-01 01:00:00', 'view', 4.0D, 7L) t(ts, event_type, value, user_id)")
    w = {r.start.hour: (r.n, r.total) for r in ledger.windows(e).collect()}
    assert w == {0: (2, 3.0), 1: (1, 4.0)}
    assert sorted(r.n for r in ledger.sessions(e).collect()) == [1, 2]
    assert ledger.windows(e, slide="30 minutes").agg(F.sum("n")).first()[0] == 6
