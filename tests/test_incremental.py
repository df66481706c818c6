import shutil

import pytest
from pyspark.sql import functions as F

from folioscope.operators import incremental as inc

M = "seq bigint, source string, url string, sha256 string"
D = "doc_id bigint, source_url string, raw_sha256 string, doc_type string, parser_version string, indexed_at timestamp"
V = "doc_type string, parser_version string, released_at timestamp"
A, B = "a" * 64, "b" * 64


def tables(spark, extra_m=(), extra_d=()):
    m = [(1, "s", "u1", A), (2, "s", "u2", "sha256:" + A.upper()), (3, "s", "u3", A), (9, "s", "u3", B), (4, "s", "u4", None), (5, "s", "u5", A), (6, "s", "u6", A), (7, "s", "u7", A + " "), (7, "s", "u7", A + " "), (8, "s", None, A), (10, "s", "u1", None), (11, "s", "u8", ""), (2, "s", "u9", A), *extra_m]
    t = "2026-01-01 00:00:00"
    d = [(1, "u1", " " + A.upper(), "statute", "v2", t), (2, "u2", A, "statute", "v2", t), (3, "u3", A, "statute", "v2", t), (5, "u5", A, "statute", "v1", t), (6, "u6", A, "statute", "v2", None), (7, "u7", A, "statute", None, t), (20, None, A, "statute", "v2", t), *extra_d]
    v = [("statute", "v1", "2025-01-01 00:00:00"), ("statute", "v2", "2025-06-01 00:00:00"), ("form", "f1", "2025-01-01 00:00:00")]
    cast = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema.replace("timestamp", "string")).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")])
    return cast(m, M).withColumn("part", F.lit("x")).withColumn("fingerprint", F.lit("y")), cast(d, D).withColumn("state", F.lit(1)), cast(v, V)


WANT = {("u3", "changed"), ("u5", "parser"), ("u6", "not indexed"), ("u7", "parser"), ("u9", "new")}


def got(state):
    return {(r.source_url, r.reason) for r in state.results(inc.OUT).collect()}


def test_due_documents(spark):
    assert {(r.source_url, r.reason) for r in inc.due_documents(*tables(spark)).collect()} == WANT
    empty = [t.limit(0) for t in tables(spark)]
    assert inc.due_documents(*empty).count() == 0


def test_runs_make_only_what_changed(spark, tmp_path):
    state = inc.PartitionedState(spark, str(tmp_path / "s"))
    first = inc.indexing_run(state, *tables(spark))
    assert first and got(state) == WANT
    assert inc.indexing_run(state, *tables(spark)) == []
    # rows in another order and spread otherwise change nothing
    m, d, v = tables(spark)
    assert inc.indexing_run(state, m.orderBy(F.desc("seq")).repartition(5), d.repartition(3), v) == []
    more = tables(spark, [(30, "s", "new-url", B)])
    assert len(inc.indexing_run(state, *more)) == 1
    assert got(state) == WANT | {("new-url", "new")}
    # indexed since: the partition becomes empty of it
    done = tables(spark, [(30, "s", "new-url", B)], [(99, "new-url", B, "statute", "v2", "2026-02-01 00:00:00")])
    assert len(inc.indexing_run(state, *done)) == 1 and got(state) == WANT
    # a new parser makes every partition due
    newer = (*done[:2], done[2].unionByName(spark.sql("select 'statute' doc_type, 'v3' parser_version, timestamp'2026-03-01 00:00:00' released_at")))
    parts = inc.fingerprints([(newer[0], inc.partition_of(F.col("url"))), (newer[1], inc.partition_of(F.col("source_url")))]).count()
    assert len(inc.indexing_run(state, *newer)) == parts >= len(first)
    assert {u for u, _ in got(state)} >= {"u1", "u2"}


def test_a_failed_run_leaves_the_old_results_and_the_next_makes_them(spark, tmp_path, monkeypatch):
    state = inc.PartitionedState(spark, str(tmp_path / "s"))
    inc.indexing_run(state, *tables(spark))
    more = tables(spark, [(30, "s", "new-url", B), (31, "s", "other-url", B)])

    def broken(*_):
        raise RuntimeError("worker lost")

    monkeypatch.setattr(inc, "due_documents", broken)
    with pytest.raises(RuntimeError):
        inc.indexing_run(state, *more)
    assert got(state) == WANT
    monkeypatch.undo()
    inc.indexing_run(state, *more)
    assert got(state) == WANT | {("new-url", "new"), ("other-url", "new")}


def test_a_failure_while_writing(spark, tmp_path):
    state = inc.PartitionedState(spark, str(tmp_path / "s"))
    inc.indexing_run(state, *tables(spark))
    now = inc.fingerprints([(tables(spark)[0], inc.partition_of(F.col("url"), 8))], 8, "other")

    @F.udf("string")
    def fails(_):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        state.laid_out(64).run(now, inc.OUT, lambda parts: parts.select(F.lit("x").alias("source_url"), fails("part").alias("reason"), "part"))
    assert got(state) == WANT
    shutil.rmtree(tmp_path / "s")
    assert got(state) == set()


def test_fingerprints_tell_swapped_values_and_nulls(spark):
    one = lambda rows: {r.part: r.fingerprint for r in inc.fingerprints([(spark.createDataFrame(rows, "k string, v string"), F.lit(0))]).collect()}
    assert one([("a", "b")]) != one([("b", "a")]) and one([("a", None)]) != one([(None, "a")]) and one([("a", "b")] * 2) != one([("a", "b")])
    assert one([("a", "1"), ("b", "2")]) == one([("b", "2"), ("a", "1")])


def test_partitions_follow_the_rows():
    assert inc.leaves(10) == 64 and inc.leaves(64_000_000) == 64 and inc.leaves(64_000_001) == 128 and inc.leaves(10**10) == 16384
    # a held number stays until partitions are twice or a quarter of what they should be
    assert inc.leaves(120_000_000, 64) == 64 and inc.leaves(130_000_000, 64) == 256 and inc.leaves(40_000_000, 128) == 128 and inc.leaves(10_000_000, 128) == 64


def test_a_small_delta_remakes_the_leaves_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "LEAF_ROWS", 12)
    state = inc.PartitionedState(spark, str(tmp_path / "s"))
    rows = spark.range(2_000).selectExpr("id seq", "'s' source", "concat('u', id) url", f"'{A}' sha256")
    _, d, v = tables(spark)
    first = inc.indexing_run(state, rows, d, v)
    assert state.held() == 256 and len(first) == 256
    changed = rows.selectExpr("seq", "source", "url", f"if(seq < 20, '{B}', sha256) sha256")
    again = inc.indexing_run(state, changed, d, v)
    assert 15 <= len(again) <= 20  # one per cent of the rows, about as many leaves
    assert inc.indexing_run(state, changed, d, v) == []
    # the tables grow: another layout beside the old one, which holds until the new one is committed
    more = changed.unionByName(spark.range(2_000, 6_500).selectExpr("id seq", "'s' source", "concat('u', id) url", f"'{A}' sha256"))
    inc.indexing_run(state, more, d, v)
    assert state.held() == 1024 and state.results(inc.OUT).count() == inc.due_documents(more, d, v).count()
    assert inc.PartitionedState(spark, str(tmp_path / "s")).path == state.path


def test_results_made_by_other_code_are_made_again(spark, tmp_path, monkeypatch):
    state = inc.PartitionedState(spark, str(tmp_path / "s"))
    first = inc.indexing_run(state, *tables(spark))
    monkeypatch.setattr(inc, "RULES", "other")
    assert inc.indexing_run(state, *tables(spark)) == first
