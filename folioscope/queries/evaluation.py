"""Queries of the evaluation of retrieval and answers, and of request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import evaluate as ev
from folioscope.operators import search, store
from folioscope.queries.search import _FINAL, _SCORED, _chunks, _final, _pool
from folioscope.session import table


def _match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gold").groupBy(F.col("id").alias("query_id")).agg(F.max("match").alias("match"))


def _ranked(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    c = _chunks(spark, sf).select("chunk", "act_title", F.col("section").alias("chunk_section"), "citation")
    return _pool(spark, sf, k).join(c, "chunk").select("query_id", "rank", "act_title", "chunk_section", "citation")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return ev.expected(table(spark, sf, "gold"))


def expected_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = ev.source_ranks(_ranked(spark, sf), _sources(spark, sf))
    return d.select("query_id", F.col("seq").cast("bigint").alias("seq"), F.col("best").cast("bigint").alias("best"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.retrieval_metrics(ev.source_ranks(_ranked(spark, sf), _sources(spark, sf)), _match(spark, sf))


def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def summary_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Means over all questions, by split and by language."""
    g = table(spark, sf, "gold").groupBy(F.col("id").alias("query_id")).agg(F.min(F.lower(F.trim("split"))).alias("split"), F.min("language").alias("language"))
    d = _metrics(spark, sf).join(g, "query_id")
    d = d.groupingSets([[], [F.col("split")], [F.col("language")]], F.col("split"), F.col("language"))
    return d.agg(F.grouping_id().alias("slice"), F.count("*").alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr")).select(F.col("slice").cast("bigint").alias("slice"), "split", "language", "n", "recall_5", "mrr")


def intent_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").groupBy(F.col("id").alias("query_id")).agg(F.min("intent").alias("intent"))
    return _metrics(spark, sf).join(g, "query_id").groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg("recall_10"), 6).alias("recall_10"), F.round(F.coalesce(F.avg("mrr"), F.lit(0.0)), 6).alias("mrr"))


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold").groupBy(F.col("id").alias("query_id")).agg(F.bool_or("should_abstain").alias("should"))
    return _final(spark, sf).groupBy("query_id").agg(F.max("rerank_score").alias("best")).join(g, "query_id")


def abstention_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(_gates(spark, sf).withColumn("did", F.col("best") < 0.35), "should", "did")


def gate_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sweep(_gates(spark, sf), "should", "best")


def answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen-odd measures of the stored answers in one pass."""
    a = table(spark, sf, "phase1_acceptance")
    cited = F.size(F.coalesce("cited", F.array().cast("array<struct<act:string,section:string>>"))) > 0
    answered = ~F.col("abstained")
    return a.agg(
        F.count("*").alias("n"), F.count_if(answered).alias("answered"), F.count_if(answered & cited).alias("with_citation"), F.count_if("passed").alias("passed"),
        F.round(F.avg(F.when(answered, F.col("input_tokens"))), 6).alias("tokens_in"), F.round(F.avg(F.when(answered, F.col("output_tokens"))), 6).alias("tokens_out"),
        F.round(F.median(F.when(answered, F.col("seconds"))), 6).alias("p50_s"), F.count_if(F.size("warnings") > 0).alias("warned"), F.round(F.max("top_dense"), 6).alias("best_dense"),
    )


def model_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Median and p95 by place in the sorted list, by model."""
    a = table(spark, sf, "phase1_acceptance").where("not abstained and latency_ms is not null")
    w = Window.partitionBy("model")
    d = a.withColumn("r", F.row_number().over(w.orderBy("latency_ms", "result_id"))).withColumn("n", F.count("*").over(w))
    at = F.greatest(F.lit(1), (F.col("n") * 0.95).cast("int"))
    return d.groupBy("model").agg(F.count("*").alias("n"), F.median("latency_ms").alias("p50"), F.max(F.when(F.col("r") == at, F.col("latency_ms"))).alias("p95"))


def must_mention(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the best chunk of a question holds all that must be mentioned."""
    g = table(spark, sf, "gold").groupBy(F.col("id").alias("query_id")).agg(F.first("must_mention", True).alias("m"))
    c = _chunks(spark, sf).select("chunk", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    d = _pool(spark, sf, 1).join(c, "chunk").join(g.where("size(m) > 0"), "query_id")
    return d.select("query_id", F.forall("m", lambda x: F.contains(F.col("t"), F.lower(x))).alias("hit"))


def answer_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of the stored answers: how many, how many different, runs cut."""
    a = table(spark, sf, "phase1_acceptance").where("answer_markdown is not null")
    m = tx.markers("answer_markdown")
    return a.select("result_id", F.size(m).cast("bigint").alias("n"), F.size(F.array_distinct(m)).cast("bigint").alias("n_distinct"), F.length(tx.trim_marker_runs("answer_markdown")).cast("bigint").alias("after"))


def latency_p50_p95(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = Window.partitionBy("event_type")
    d = e.withColumn("r", F.row_number().over(w.orderBy("value", "event_id"))).withColumn("n", F.count("*").over(w))
    at = F.greatest(F.lit(1), (F.col("n") * 0.95).cast("int"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("p50"), F.max(F.when(F.col("r") == at, F.col("value"))).alias("p95"))


def rolling_last_500(spark: SparkSession, sf: str) -> DataFrame:
    e = store.newest(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 500)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("event_id").alias("first"))


def ttl_cache_live(spark: SparkSession, sf: str) -> DataFrame:
    """Last entry of each user, if it is younger than 72 hours at the given time."""
    e = store.last_wins(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", "event_id")
    d = e.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 72 HOURS"))
    return store.live(d, F.to_timestamp(F.lit("2024-01-29 00:00:00"))).select("user_id", "event_id")


def fifo_evict(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("props").alias("n"), F.sum(F.length("props")).alias("chars"), F.countDistinct(F.get_json_object("props", "$.k")).alias("keys"))


def repeat_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Different answers by question."""
    a = table(spark, sf, "phase1_acceptance")
    return a.groupBy("question").agg(F.count("*").alias("runs"), F.countDistinct(F.sha2(F.coalesce("answer_markdown", F.lit("")), 256)).alias("n_distinct"))


def verification_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """For each question its best chunk's excerpt, to be verified by hand."""
    c = _chunks(spark, sf).select("chunk", "locator", tx.excerpt(F.coalesce("text", F.lit("")), 120).alias("excerpt"))
    return _pool(spark, sf, 1).join(c, "chunk").select("query_id", "locator", "excerpt")


def stage_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The rank of the expected sources at every stage."""
    c = _chunks(spark, sf).select("chunk", "act_title", F.col("section").alias("chunk_section"), "citation")
    d = _final(spark, sf).join(c, "chunk").select("query_id", "fused", "rerank", "final", "act_title", "chunk_section", "citation")
    hits = _sources(spark, sf).join(d, "query_id").where(ev.is_hit())
    return hits.groupBy("query_id").agg(*[F.min(x).cast("bigint").alias(x) for x in ("fused", "rerank", "final")])


QUERIES = {
    f.__name__: f
    for f in (expected_sources, recall_mrr, summary_grouping_sets, intent_summary, abstention_confusion, gate_calibration, answer_summary, model_latency, must_mention, answer_markers, latency_p50_p95, rolling_last_500, ttl_cache_live, fifo_evict, json_props, repeat_stability, verification_sheet, stage_trace)
}

_BEST = (
    _SCORED
    + """, ex AS (SELECT query_id, unnest(range(len(e))) AS seq, unnest(e) AS s FROM (SELECT id AS query_id, first(expected_sources) AS e FROM gold GROUP BY 1)),
rk AS (SELECT query_id, rank, act_title, section, citation FROM hits h JOIN chunks c ON c."rowid" = h.chunk),
best AS (SELECT ex.query_id, ex.seq, min(rk.rank) AS best FROM ex LEFT JOIN rk ON rk.query_id = ex.query_id AND ((ex.s.act = rk.act_title AND ex.s.section = rk.section) OR (ex.s.act IS NULL AND contains(coalesce(rk.citation, ''), ex.s.neutral_citation))) GROUP BY 1, 2),
mt AS (SELECT id AS query_id, max(match) AS match FROM gold GROUP BY 1),
me AS (SELECT query_id, round(CASE WHEN coalesce(max(match), 'all') = 'any' THEN coalesce((min(best) <= 5)::INT, 0) ELSE count(*) FILTER (best <= 5) / count(*) END, 6)::DOUBLE AS recall_5,
 round(CASE WHEN coalesce(max(match), 'all') = 'any' THEN coalesce((min(best) <= 10)::INT, 0) ELSE count(*) FILTER (best <= 10) / count(*) END, 6)::DOUBLE AS recall_10, round(coalesce(1 / min(best), 0), 6)::DOUBLE AS mrr FROM best JOIN mt USING (query_id) GROUP BY 1)
"""
)
_GATES = _FINAL + ", gt AS (SELECT query_id, max(rs) AS best, bool_or(should_abstain) AS should FROM fin JOIN gold ON id = query_id GROUP BY 1) "
SQL = {
    "expected_sources": _BEST + "SELECT * FROM best",
    "recall_mrr": _BEST + "SELECT * FROM me",
    "summary_grouping_sets": _BEST
    + ", g2 AS (SELECT id AS query_id, min(lower(trim(split))) AS split, min(language) AS language FROM gold GROUP BY 1) SELECT grouping(split, language) AS slice, split, language, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr FROM me JOIN g2 USING (query_id) GROUP BY GROUPING SETS ((), (split), (language))",
    "intent_summary": _BEST + ", g2 AS (SELECT id AS query_id, min(intent) AS intent FROM gold GROUP BY 1) SELECT intent, count(*) AS n, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr FROM me JOIN g2 USING (query_id) GROUP BY 1",
    "abstention_confusion": _GATES
    + ", c AS (SELECT count(*) FILTER (should AND best < 0.35) AS tp, count(*) FILTER (NOT should AND best < 0.35) AS fp, count(*) FILTER (should AND NOT best < 0.35) AS fn FROM gt) SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c",
    "gate_calibration": _GATES + "SELECT p / 100 AS threshold, count(*) FILTER (should AND best < p / 100) AS tp, count(*) FILTER (NOT should AND best < p / 100) AS fp, count(*) FILTER (should AND NOT best < p / 100) AS fn FROM gt, range(5, 80, 5) AS r(p) GROUP BY 1",
    "answer_summary": "SELECT count(*) AS n, count(*) FILTER (NOT abstained) AS answered, count(*) FILTER (NOT abstained AND len(cited) > 0) AS with_citation, count(*) FILTER (passed) AS passed, round(avg(input_tokens) FILTER (NOT abstained), 6) AS tokens_in, round(avg(output_tokens) FILTER (NOT abstained), 6) AS tokens_out, round(median(seconds) FILTER (NOT abstained), 6) AS p50_s, count(*) FILTER (len(warnings) > 0) AS warned, round(max(top_dense), 6) AS best_dense FROM phase1_acceptance",
    "model_latency": "SELECT model, count(*) AS n, median(latency_ms) AS p50, list_sort(list(latency_ms))[greatest(1, (count(*) * 0.95)::DOUBLE - 0.5 + 1e-9)::INT] AS p95 FROM phase1_acceptance WHERE NOT abstained AND latency_ms IS NOT NULL GROUP BY 1",
    "must_mention": _SCORED + ", m AS (SELECT id AS query_id, first(must_mention) AS m FROM gold GROUP BY 1) SELECT query_id, len(list_filter(m, lambda x: NOT contains(lower(coalesce(text, '')), lower(x)))) = 0 AS hit FROM hits JOIN chunks c ON c.\"rowid\" = chunk JOIN m USING (query_id) WHERE rank = 1 AND len(m) > 0",
    "answer_markers": "SELECT result_id, len(m) AS n, len(list_distinct(m)) AS n_distinct, length(regexp_replace(answer_markdown, '((?:\\[S\\d+\\]){3})(?:\\[S\\d+\\]){3,}', '\\1', 'g')) AS after FROM (SELECT result_id, answer_markdown, list_transform(regexp_extract_all(answer_markdown, '\\[\\s*[Ss]\\s*(\\d{1,3})\\s*\\]', 1), lambda x: x::INT) AS m FROM phase1_acceptance WHERE answer_markdown IS NOT NULL)",
    "latency_p50_p95": "SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, list_sort(list(value))[greatest(1, (count(*) * 0.95)::DOUBLE - 0.5 + 1e-9)::INT] AS p95 FROM events GROUP BY 1",
    "rolling_last_500": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 500 GROUP BY 1",
    "ttl_cache_live": "SELECT user_id, event_id FROM (SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts FROM events GROUP BY 1) WHERE ts + INTERVAL 72 HOURS > TIMESTAMP '2024-01-29'",
    "fifo_evict": "SELECT user_id, count(*) AS n, min(event_id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY 1",
    "json_props": "SELECT event_type, count(props) AS n, sum(length(props))::BIGINT AS chars, count(DISTINCT json_extract_string(props, '$.k')) AS keys FROM events GROUP BY 1",
    "repeat_stability": "SELECT question, count(*) AS runs, count(DISTINCT sha256(coalesce(answer_markdown, ''))) AS n_distinct FROM phase1_acceptance GROUP BY 1",
    "verification_sheet": _SCORED
    + """, fx AS (SELECT query_id, locator, trim(regexp_replace(coalesce(text, ''), '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS t FROM hits JOIN chunks c ON c."rowid" = chunk WHERE rank = 1),
hx AS (SELECT *, left(t, 120) AS h FROM fx), kx AS (SELECT *, greatest(CASE WHEN contains(h, '.') THEN 121 - strpos(reverse(h), '.') ELSE 0 END, CASE WHEN contains(h, ';') THEN 121 - strpos(reverse(h), ';') ELSE 0 END, CASE WHEN contains(h, ':') THEN 121 - strpos(reverse(h), ':') ELSE 0 END) AS cut, CASE WHEN contains(h, ' ') THEN 120 - strpos(reverse(h), ' ') ELSE 120 END AS blank FROM hx)
SELECT query_id, locator, CASE WHEN length(t) <= 120 THEN t ELSE left(h, CASE WHEN cut > 60 THEN cut ELSE blank END) || ' …' END AS excerpt FROM kx""",
    "stage_trace": _FINAL
    + """, ex AS (SELECT query_id, unnest(e) AS s FROM (SELECT id AS query_id, first(expected_sources) AS e FROM gold GROUP BY 1))
SELECT ex.query_id, min(fused) AS fused, min(rerank) AS rerank, min(final) AS final FROM ex JOIN fin USING (query_id) JOIN chunks c ON c."rowid" = fin.chunk WHERE (ex.s.act = c.act_title AND ex.s.section = c.section) OR (ex.s.act IS NULL AND contains(coalesce(c.citation, ''), ex.s.neutral_citation)) GROUP BY 1""",
}
