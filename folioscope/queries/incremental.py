"""Queries of problem 1."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import incremental as inc
from folioscope.session import shared_dir, table


def _state(spark: SparkSession, sf: str, name: str) -> inc.PartitionedState:
    """One state per set of tables; a later call finds it and makes only what changed."""
    where = hashlib.sha256(sf.encode()).hexdigest()[:16]
    return inc.PartitionedState(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{where}")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    state = _state(spark, sf, "indexing")
    inc.indexing_run(state, table(spark, sf, "manifest"), table(spark, sf, "documents"), table(spark, sf, "parser_versions"))
    return state.results(inc.OUT).select("source_url")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    state = _state(spark, sf, "indexing")
    inc.indexing_run(state, table(spark, sf, "manifest"), table(spark, sf, "documents"), table(spark, sf, "parser_versions"))
    return state.results(inc.OUT).groupBy("reason").agg(F.count("*").alias("n_urls"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}

_DUE = """
WITH m AS (SELECT url, seq, regexp_replace(lower(trim(sha256)), '^sha-?256\\s*[:=-]?\\s*', '') AS sha FROM manifest WHERE url IS NOT NULL),
newest AS (SELECT url AS source_url, arg_max(sha, seq) AS sha FROM m WHERE sha <> '' GROUP BY 1),
v AS (SELECT doc_type, arg_max(parser_version, (released_at, parser_version)) AS cur FROM parser_versions GROUP BY 1),
d AS (SELECT source_url, regexp_replace(lower(trim(raw_sha256)), '^sha-?256\\s*[:=-]?\\s*', '') AS raw, parser_version, indexed_at, cur FROM documents LEFT JOIN v USING (doc_type)),
j AS (SELECT n.source_url, CASE WHEN d.source_url IS NULL THEN 'new' WHEN d.raw IS DISTINCT FROM n.sha THEN 'changed'
  WHEN d.parser_version IS NULL OR d.parser_version IS DISTINCT FROM d.cur THEN 'parser' WHEN d.indexed_at IS NULL THEN 'not indexed' END AS reason
  FROM newest n LEFT JOIN d USING (source_url))
"""
SQL = {"p1_found": _DUE + "SELECT source_url FROM j WHERE reason IS NOT NULL", "p1_reasons": _DUE + "SELECT reason, count(*) AS n_urls FROM j WHERE reason IS NOT NULL GROUP BY 1"}
