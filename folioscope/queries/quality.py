"""Queries of data quality and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import quality as dq
from folioscope.session import table

TODAY = "2026-07-01"


def _n(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    p = dq.problems(c, TODAY)
    return c.select(F.col("rowid").alias("chunk"), F.array_join(F.array_sort(p), "|").alias("problems"))


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return dq.reasons(dq.gated(table(spark, sf, "chunks"), TODAY)[1])


def accepted_counts(spark: SparkSession, sf: str) -> DataFrame:
    ok, bad = dq.gated(table(spark, sf, "chunks"), TODAY)
    return ok.select("doc_type", F.lit("ok").alias("verdict")).unionByName(bad.select("doc_type", F.lit("bad").alias("verdict"))).groupBy("doc_type", "verdict").agg(F.count("*").alias("n"))


FIELDS = ["title", "licence", "language", "script", "locator", "text", "act_title", "section", "citation", "judges"]


def completeness_grades(spark: SparkSession, sf: str) -> DataFrame:
    return dq.completeness(table(spark, sf, "chunks").where("doc_type is not null"), "doc_type", FIELDS)


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = dq.completeness(table(spark, sf, "chunks").where("doc_type is not null"), "doc_type", ["title", "locator", "text"])
    return g.groupBy("doc_type").agg(F.every(F.col("grade") == "green").alias("passed"), F.min("filled").alias("least"))


def token_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return dq.quantiles(table(spark, sf, "chunks"), "doc_type", "token_count")


def order_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return dq.quantiles(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


def value_counts_ends(spark: SparkSession, sf: str) -> DataFrame:
    return dq.value_ends(table(spark, sf, "chunks"), ["language", "licence", "source_name", "text_source"])


def manifest_profile(spark: SparkSession, sf: str) -> DataFrame:
    return dq.profile(table(spark, sf, "manifest"))


def mode_page_source(spark: SparkSession, sf: str) -> DataFrame:
    return dq.mode(table(spark, sf, "page_info"), ["doc_id"], "text_source", "number")


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("doc_type", "language", F.explode_outer("domain_tags").alias("tag"))
    return c.groupBy("doc_type", "language", "tag").agg(F.count("*").alias("n"))


def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Texts delivered again within and across documents."""
    c = table(spark, sf, "chunks").where("text is not null").select("doc_id", F.sha1("text").alias("h"))
    per = c.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - F.col("d")).alias("within"), F.sum(F.col("d") - 1).alias("across"))


def date_ranges(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.functions.text import day_first_date, iso_date

    c = table(spark, sf, "chunks").where("doc_type = 'judgment'")
    d = F.coalesce(iso_date("decision_date"), day_first_date("decision_date"))
    return c.groupBy("court").agg(F.min(d).cast("string").alias("first"), F.max(d).cast("string").alias("last"), F.count_if(d.isNull() & F.col("decision_date").isNotNull()).alias("unparsed"), F.count("*").alias("n"))


def locator_forms(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("locator") == "header", "header").when(F.col("locator").rlike("^para"), "para").when(F.col("locator").rlike(r"^pp?\."), "page").otherwise("other")
    return table(spark, sf, "chunks").groupBy("doc_type", form.alias("form")).agg(F.count("*").alias("n"))


def ocr_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "page_info").distinct()
    return p.groupBy("text_source").agg(F.round(F.avg("ocr_confidence"), 6).alias("mean"), F.round(F.avg(F.col("usable").cast("double")), 6).alias("usable"), F.count("*").alias("n"))


def leaking_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dq.leaking_groups(table(spark, sf, "gold"))


def furniture_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, digits aside, that stand in at least two and a quarter of the chunks of a document."""
    from folioscope.functions.text import furniture_key

    c = table(spark, sf, "chunks").where("text is not null").select("doc_id", F.col("rowid").alias("chunk"), F.explode(F.split("text", "\n")).alias("line"))
    k = c.withColumn("key", furniture_key("line")).where("key != ''")
    total = c.groupBy("doc_id").agg(F.countDistinct("chunk").alias("total"))
    n = k.groupBy("doc_id", "key").agg(F.countDistinct("chunk").alias("n"))
    return n.join(total, "doc_id").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * 0.25)).select("doc_id", "key", "n")


QUERIES = {
    f.__name__: f
    for f in (validate_rows, reject_reasons, accepted_counts, completeness_grades, quality_gate, token_quantiles, order_quantiles, value_counts_ends, manifest_profile, mode_page_source, tag_counts, duplicate_report, date_ranges, locator_forms, ocr_confidence, leaking_groups, furniture_lines)
}


def _missing(name: str, kind: str | None = None, text: bool = True, enum: bool = False) -> str:
    on = "true" if kind is None else f"doc_type = '{kind}'"
    gone = f"({name} IS NULL OR trim({name}) = '')" if text else f"({name} IS NULL OR len({name}) = 0)" if name == "domain_tags" else f"({name} IS NULL)"
    out = f"CASE WHEN {on} AND {gone} THEN 'missing {name}' END"
    if text and not enum:
        held = ", ".join(f"'{x}'" for x in dq.tx.PLACEHOLDERS)
        out += f", CASE WHEN {on} AND lower(trim({name})) IN ({held}) THEN 'placeholder value in {name}' END"
    return out


_TEXTLESS = {"doc_id", "token_count", "domain_tags", "act_year"}
_ISO = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS DATE) END"
_CHECKS = ", ".join(
    [_missing(x, None, x not in _TEXTLESS, x in dq.ENUMS) for x in dq.COMMON]
    + [_missing(x, k, x not in _TEXTLESS) for k, xs in dq.BY_TYPE.items() for x in xs]
    + [
        f"CASE WHEN coalesce(status, '') NOT IN ({', '.join(repr(x) for x in dq.STATUSES)}) THEN 'status not allowed' END",
        "CASE WHEN NOT regexp_matches(coalesce(source_url, ''), '^(https|s3)://') THEN 'source_url not https or s3' END",
        "CASE WHEN coalesce(text_source, '') NOT IN ('layer', 'ocr', 'metadata') THEN 'text_source not allowed' END",
        "CASE WHEN token_count <= 0 THEN 'token_count not positive' END",
        "CASE WHEN text_source IN ('layer', 'ocr') AND (page_start IS NULL OR page_end IS NULL) THEN 'missing pages' END",
        "CASE WHEN text_source = 'ocr' AND ocr_confidence IS NULL THEN 'missing ocr_confidence' END",
        "CASE WHEN doc_type = 'judgment' AND len(list_filter(regexp_split_to_array(coalesce(case_title, ''), '(?i)\\s+(?:v\\.|vs\\.?|versus)\\s+'), lambda p: lower(trim(p, ' .')) IN ('', " + ", ".join(f"'{x}'" for x in dq.tx.PLACEHOLDERS) + "))) > 0 THEN 'placeholder party' END",
        f"CASE WHEN doc_type = 'judgment' AND {_ISO.format('decision_date')} IS NULL THEN 'decision_date not ISO' END",
        f"CASE WHEN doc_type = 'judgment' AND {_ISO.format('decision_date')} > DATE '{TODAY}' THEN 'decision_date in the future' END",
        f"CASE WHEN doc_type = 'judgment' AND court = 'Supreme Court of India' AND {_ISO.format('decision_date')} < DATE '1950-01-28' THEN 'decision_date before the court' END",
        f"CASE WHEN doc_type = 'statute' AND act_year NOT BETWEEN 1800 AND {TODAY[:4]} THEN 'impossible act_year' END",
        f"CASE WHEN retrieved_at <> '' AND {_ISO.format('left(retrieved_at, 10)')} IS NULL THEN 'retrieved_at not ISO' END",
        f"CASE WHEN {_ISO.format('left(retrieved_at, 10)')} > DATE '{TODAY}' THEN 'retrieved_at in the future' END",
    ]
)
_CHECKED = f"WITH p AS (SELECT \"rowid\" AS chunk, doc_type, CASE WHEN doc_type IN ('statute', 'judgment', 'procedure', 'form') THEN list_sort(list_filter([{_CHECKS}], lambda x: x IS NOT NULL)) ELSE ['doc_type not allowed'] END AS problems FROM chunks) "


def _filled(fields: list[str]) -> str:
    def one(c: str) -> str:
        bad = f"{c} IS NULL OR len({c}) = 0" if c == "judges" else f"{c} IS NULL OR trim({c}) = '' OR lower({c}) IN ('[]', '{{}}', 'null')"
        return f"SELECT doc_type, '{c}' AS field, avg(CASE WHEN {bad} THEN 0.0 ELSE 100.0 END) AS filled FROM chunks WHERE doc_type IS NOT NULL GROUP BY 1"

    return " UNION ALL ".join(one(c) for c in fields)


_GRADE = "CASE WHEN filled > 99 THEN 'green' WHEN filled >= 95 THEN 'yellow' WHEN filled >= 80 THEN 'orange' ELSE 'red' END"


def _profile(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (lower(trim({c})) IN ('', 'none', 'nan', '<na>', '-')) AS n_empty, count(DISTINCT {c}) AS n_distinct, count({c}) - count(DISTINCT {c}) AS n_repeated FROM manifest" for c in names)


def _quantiles(t: str, by: str, v: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"round(quantile_cont({v}, {q}), 6) AS {n}" for q, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))) + f", max({v}) AS most FROM {t} GROUP BY 1"


SQL = {
    "validate_rows": _CHECKED + "SELECT chunk, array_to_string(problems, '|') AS problems FROM p",
    "reject_reasons": _CHECKED + "SELECT reason, count(*) AS n FROM (SELECT split_part(unnest(problems), ':', 1) AS reason FROM p) GROUP BY 1",
    "accepted_counts": _CHECKED + "SELECT doc_type, CASE WHEN len(problems) = 0 THEN 'ok' ELSE 'bad' END AS verdict, count(*) AS n FROM p GROUP BY 1, 2",
    "completeness_grades": f"SELECT doc_type, field, round(filled, 6) AS filled, {_GRADE} AS grade FROM ({_filled(FIELDS)})",
    "quality_gate": f"SELECT doc_type, bool_and(filled > 99) AS passed, min(round(filled, 6)) AS least FROM ({_filled(['title', 'locator', 'text'])}) GROUP BY 1",
    "token_quantiles": _quantiles("chunks", "doc_type", "token_count"),
    "order_quantiles": _quantiles("orders", "o_orderpriority", "o_totalprice"),
    "value_counts_ends": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS top, row_number() OVER (PARTITION BY field ORDER BY n, value DESC) AS bottom FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '(null)') AS value, count(*) AS n FROM chunks GROUP BY 2" for c in ("language", "licence", "source_name", "text_source"))
    + ")) WHERE top <= 10 OR bottom <= 5",
    "manifest_profile": _profile(["source", "url", "local_path", "sha256", "retrieved_at", "licence", "source_page", "extra"]),
    "mode_page_source": "SELECT doc_id, arg_max(text_source, (n, -first)) AS text_source FROM (SELECT doc_id, text_source, count(*) AS n, min(number) AS first FROM page_info WHERE text_source IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "tag_counts": "SELECT doc_type, language, tag, count(*) AS n FROM (SELECT doc_type, language, unnest(CASE WHEN domain_tags IS NULL OR len(domain_tags) = 0 THEN [NULL] ELSE domain_tags END) AS tag FROM chunks) GROUP BY ALL",
    "duplicate_report": "SELECT sum(n)::BIGINT AS n_rows, sum(n - d)::BIGINT AS within, sum(d - 1)::BIGINT AS across FROM (SELECT sha1(text) AS h, count(*) AS n, count(DISTINCT doc_id) AS d FROM chunks WHERE text IS NOT NULL GROUP BY 1)",
    "date_ranges": f"WITH d AS (SELECT court, decision_date, coalesce({_ISO.format('decision_date')}, CASE WHEN regexp_full_match(trim(decision_date), '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime(trim(decision_date), '%d-%m-%Y')::DATE END) AS d FROM chunks WHERE doc_type = 'judgment') SELECT court, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last, count(*) FILTER (d IS NULL AND decision_date IS NOT NULL) AS unparsed, count(*) AS n FROM d GROUP BY 1",
    "locator_forms": "SELECT doc_type, CASE WHEN locator = 'header' THEN 'header' WHEN regexp_matches(locator, '^para') THEN 'para' WHEN regexp_matches(locator, '^pp?\\.') THEN 'page' ELSE 'other' END AS form, count(*) AS n FROM chunks GROUP BY 1, 2",
    "ocr_confidence": "SELECT text_source, round(avg(ocr_confidence), 6) AS mean, round(avg(usable::INT), 6) AS usable, count(*) AS n FROM (SELECT DISTINCT * FROM page_info) GROUP BY 1",
    "leaking_groups": "SELECT lower(trim(\"group\")) AS grp, count(DISTINCT lower(trim(split))) AS n_splits FROM gold WHERE \"group\" IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1",
    "furniture_lines": """WITH c AS (SELECT doc_id, "rowid" AS chunk, unnest(string_split(text, chr(10))) AS line FROM chunks WHERE text IS NOT NULL),
t AS (SELECT doc_id, count(DISTINCT chunk) AS total FROM c GROUP BY 1),
k AS (SELECT doc_id, regexp_replace(trim(regexp_replace(line, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '\\d+', '#', 'g') AS key, count(DISTINCT chunk) AS n FROM c GROUP BY 1, 2)
SELECT doc_id, key, n FROM k JOIN t USING (doc_id) WHERE key <> '' AND n >= greatest(2.0, total * 0.25)""",
}
