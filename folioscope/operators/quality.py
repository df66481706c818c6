"""Data quality: validation with reasons, completeness grades, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as tx

#: The record contract.
DOC_TYPES = ["statute", "judgment", "procedure", "form"]
STATUSES = ["in_force", "repealed", "partially_in_force", "unknown", "n/a"]
TEXT_SOURCES = ["layer", "ocr", "metadata"]
COMMON = ["chunk_id", "doc_id", "doc_type", "title", "source_name", "source_url", "licence", "retrieved_at", "authority", "jurisdiction", "language", "script", "locator", "text", "token_count", "status", "domain_tags", "text_source"]
BY_TYPE = {"statute": ["act_title", "act_year", "section", "section_heading"], "judgment": ["case_title", "court", "decision_date"], "procedure": ["issuing_body", "valid_as_of"], "form": ["issuing_body", "valid_as_of"]}
ENUMS = ["status", "doc_type", "text_source"]


def empty(df: DataFrame, name: str) -> Column:
    """Null, blank, or an empty list."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return tx.blank(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.col(name).isNull() | (F.size(name) == 0)
    return F.col(name).isNull()


def problems(df: DataFrame, today: str, founded: str = "1950-01-28", court: str = "Supreme Court of India") -> Column:
    """What is wrong with a record, as an array of reasons; empty if nothing is. `today` is an ISO date."""
    now, checks = F.to_date(F.lit(today)), []
    named = lambda reason, bad: F.when(F.coalesce(bad, F.lit(False)), F.lit(reason))

    def required(name: str, only: Column | None = None) -> list[Column]:
        applies = F.lit(True) if only is None else only
        gone = empty(df, name)
        out = [named(f"missing {name}", applies & gone)]
        if name not in ENUMS and isinstance(df.schema[name].dataType, T.StringType):
            out.append(named(f"placeholder value in {name}", applies & ~gone & tx.placeholder(name)))
        return out

    for name in COMMON:
        checks += required(name)
    for kind, names in BY_TYPE.items():
        for name in names:
            checks += required(name, F.col("doc_type") == kind)
    judgment, date = F.col("doc_type") == "judgment", tx.iso_date("decision_date")
    parties = F.transform(F.split(F.coalesce("case_title", F.lit("")), r"(?i)\s+(?:v\.|vs\.?|versus)\s+"), lambda p: F.lower(F.trim(p, F.lit(" ."))))
    checks += [
        named("status not allowed", ~F.coalesce(F.col("status"), F.lit("")).isin(STATUSES)),
        named("source_url not https or s3", ~F.coalesce(F.col("source_url"), F.lit("")).rlike("^(https|s3)://")),
        named("text_source not allowed", ~F.coalesce(F.col("text_source"), F.lit("")).isin(TEXT_SOURCES)),
        named("token_count not positive", F.col("token_count") <= 0),
        named("missing pages", F.col("text_source").isin("layer", "ocr") & (F.col("page_start").isNull() | F.col("page_end").isNull())),
        named("missing ocr_confidence", (F.col("text_source") == "ocr") & F.col("ocr_confidence").isNull()),
        named("placeholder party", judgment & F.exists(parties, lambda p: (p == "") | p.isin(tx.PLACEHOLDERS))),
        named("decision_date not ISO", judgment & date.isNull()),
        named("decision_date in the future", judgment & (date > now)),
        named("decision_date before the court", judgment & (F.col("court") == court) & (date < F.to_date(F.lit(founded)))),
        named("impossible act_year", (F.col("doc_type") == "statute") & ~F.col("act_year").between(1800, int(today[:4]))),
        named("retrieved_at not ISO", (F.col("retrieved_at") != "") & tx.iso_date(F.left("retrieved_at", F.lit(10))).isNull()),
        named("retrieved_at in the future", tx.iso_date(F.left("retrieved_at", F.lit(10))) > now),
    ]
    known = F.coalesce(F.col("doc_type").isin(DOC_TYPES), F.lit(False))
    return F.when(~known, F.array(F.lit("doc_type not allowed"))).otherwise(F.array_compact(F.array(*checks)))


def gated(df: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with problems): a record with a problem is refused, not let through with a warning."""
    d = df.withColumn("problems", problems(df, today))
    return d.where(F.size("problems") == 0).drop("problems"), d.where(F.size("problems") > 0)


def reasons(rejected: DataFrame, column: str = "problems") -> DataFrame:
    """(reason, n): by what stands before the first colon."""
    one = rejected.select(F.explode(column).alias("p"))
    return one.groupBy(F.split_part("p", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def grade(full: Column) -> Column:
    return F.when(full > 99, "green").when(full >= 95, "yellow").when(full >= 80, "orange").otherwise("red")


def completeness(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, field, filled per cent, grade): one pass over the rows for all fields."""
    one = df.groupBy(by).agg(*[F.avg(F.when(empty(df, c) | (F.lower(F.col(c).cast("string")).isin("[]", "{}", "null") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(False)), 0.0).otherwise(100.0)).alias(c) for c in columns])
    long = one.unpivot([by], columns, "field", "filled")
    return long.select(by, "field", F.round("filled", 6).alias("filled"), grade(F.col("filled")).alias("grade"))


def value_ends(df: DataFrame, columns: list[str], first: int = 10, last: int = 5) -> DataFrame:
    """(field, value, n, place): commonest and rarest values, nulls as (null); place counts from either end."""
    long = reduce(DataFrame.unionByName, [df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n") for c in columns])
    by = Window.partitionBy("field")
    top = F.row_number().over(by.orderBy(F.desc("n"), "value"))
    bottom = F.row_number().over(by.orderBy("n", F.desc("value")))
    d = long.withColumn("top", top).withColumn("bottom", bottom).where((F.col("top") <= first) | (F.col("bottom") <= last))
    return d.select("field", "value", "n", F.col("top").cast("bigint").alias("top"), F.col("bottom").cast("bigint").alias("bottom"))


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p5, p50, p95, most) by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    d = df.groupBy(by).agg(p.alias("p"), F.max(value).alias("most"))
    return d.select(by, *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "most")


def mode(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, value): the commonest value, of ties the one that came first in `order`."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("o"))).alias(value))


def profile(df: DataFrame) -> DataFrame:
    """(field, n, n_null, n_empty, n_distinct, n_repeated) of the text columns, for metadata of unknown quality."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # a literal column name: one aggregation over all columns, then unpivoted
    parts = []
    for c in names:
        gone = F.lower(F.trim(F.col(c))).isin("", "none", "nan", "<na>", "-")
        parts += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}\u0001n_null"), F.count(F.when(gone, 1)).alias(f"{c}\u0001n_empty"), F.countDistinct(c).alias(f"{c}\u0001n_distinct"), F.count(c).alias(f"{c}\u0001n_full")]
    one = df.agg(F.count("*").alias("n"), *parts)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), *[F.col(f"`{c}\u0001{k}`").alias(k) for k in ("n_null", "n_empty", "n_distinct", "n_full")]) for c in names])
    d = one.select("n", F.explode(rows).alias("r"))
    return d.select("r.field", "n", "r.n_null", "r.n_empty", "r.n_distinct", (F.col("r.n_full") - F.col("r.n_distinct")).alias("n_repeated"))


def leaking_groups(gold: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """(group, n_splits) of groups that lie in more than one split."""
    d = gold.where(F.col(group).isNotNull()).groupBy(F.lower(F.trim(group)).alias("grp")).agg(F.countDistinct(F.lower(F.trim(split))).alias("n_splits"))
    return d.where("n_splits > 1")
