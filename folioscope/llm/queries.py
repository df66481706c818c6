"""The queries of the problems tagged llm, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import encoding, mixture, neardup, pieces, repeat, scans, sentences, splits, tokens
from folioscope.session import spread, staged, table


#: Reviewed records up to which they are broadcast; more are joined by a shuffle.
SAMPLE_BOUND = 200_000


def _source() -> Column:
    """The source a chunk came from, as part of its address."""
    return F.regexp_extract("source_url", "//[^/]+/([^/]+)/", 1)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs(spread(table(spark, sf, "chunks")), "rowid")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(spread(table(spark, sf, "chunks")), "rowid")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    sample = table(spark, sf, "review_sample").distinct()
    few = sample.limit(SAMPLE_BOUND + 1).count() <= SAMPLE_BOUND
    sample = F.broadcast(sample) if few else sample.hint("merge")
    chunks = table(spark, sf, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("rowid").alias("record_id"), "text")  # rowid is unique
    answers = table(spark, sf, "phase1_acceptance").select(F.lit("answer").alias("record_kind"), F.col("result_id").alias("record_id"), F.col("answer_markdown").alias("text"))
    both = sample.where("record_kind = 'chunk'").join(chunks, ["record_kind", "record_id"]).unionByName(sample.where("record_kind = 'answer'").join(answers, ["record_kind", "record_id"]))
    return sentences.split(both, ["record_kind", "record_id"])


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("rowid").alias("record_id"), "text")
    answers = table(spark, sf, "phase1_acceptance").select(F.lit("answer").alias("record_kind"), F.col("result_id").alias("record_id"), F.col("answer_markdown").alias("text"))
    return sentences.split(chunks.unionByName(answers), ["record_kind", "record_id"])


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.cut_texts(spread(table(spark, sf, "chunks")), ["rowid", "locator", "section"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.cut_texts(spread(table(spark, sf, "chunks")), ["rowid"]).where("piece = 1").select("rowid").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.defects(spread(table(spark, sf, "chunks")), table(spark, sf, "page_info"))


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired(spread(table(spark, sf, "chunks")), table(spark, sf, "page_info"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leaking(table(spark, sf, "gold"))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assigned(table(spark, sf, "gold"))


def _repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Both fields of chunks that are prose: each source has its own chains for each."""
    c = spread(table(spark, sf, "chunks")).select("rowid", _source().alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("said")) for f in ("text", "title")])).alias("x"))
    return encoding.repaired(c.select("rowid", "source", "x.*"), "rowid", "said", "source", "field", lambda df: staged(df, "suspects"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).where("field = 'text'").select("rowid").distinct()


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _repaired(spark, sf).select("rowid", "source", "field", "chain", "posterior", "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.with_ids(spread(table(spark, sf, "documents")), "doc_id")


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.decoded(p8_ids(spark, sf), "doc_id")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixture(spread(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.reached(p9_mixture(spark, sf), table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeat.repetitive(spread(table(spark, sf, "documents")), "doc_id").select("doc_id")


def p10_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return repeat.repetition(spread(table(spark, sf, "documents")), "doc_id")


def p10_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return repeat.likelihood(spread(table(spark, sf, "documents")), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [p2_found, p2_groups, p3_found, p3_sentences, p4_found, p4_pieces, p5_found, p5_paragraphs, p6_found, p6_splits, p7_found, p7_repaired, p8_ids, p8_roundtrip, p9_mixture, p9_shares, p10_found, p10_repetition, p10_likelihood]
    return {f.__name__: f for f in made}
