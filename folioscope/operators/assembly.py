"""Chunks of laws and judgments from the structure of their lines: paragraphs, packing, locators, identities.

Paragraphs are islands of lines; packing is the fold of `passages.packed`; everything else are windows over pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.functions import text as tx
from folioscope.operators import passages, splitting

# What opens a paragraph of a law, and what closes a clause before it.
OPENS = r"^(\(\w{1,6}\)|\[\(\w{1,6}\)|Provided|Explanation|Illustrations?\b|“|\[“)"
CLOSES = r"[.:;—–\-\]]\s*$|[.:;]”\s*$"
#: How far a line must stand right of the one before it, and of the base margin, to begin a paragraph.
INDENT, BASE_INDENT = 8.0, 10
#: A paragraph in more pieces than this has lost its numbering and is located by page.
MOST_PARTS = 3


def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, para, text, page_start, page_end) of the lines (by, line_no, text, page, x0, bold_prefix).

    A paragraph begins at a line indented beside the one before it on its page; or, after a line that closes a clause, where
    one opens: with a label, a bold prefix, or right of the base margin (the commonest, of ties the first).
    """
    each = Window.partitionBy(*by).orderBy("line_no")
    margins = lines.groupBy(*by, F.bround("x0").alias("x")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    base = margins.groupBy(*by).agg(F.max_by("x", F.struct("n", -F.col("first"))).alias("base"))
    before = lambda c: F.lag(c).over(each)
    indented = (F.col("x0") > before("x0") + INDENT) & (F.col("page") == before("page"))
    right = (F.col("x0") >= F.col("base") + BASE_INDENT) & (F.col("x0") > before("x0") - 1)
    opens = F.col("text").rlike(OPENS) | (F.coalesce("bold_prefix", F.lit("")) != "") | F.coalesce(right, F.lit(False))
    new = F.coalesce(indented | before("text").rlike(CLOSES) & opens, F.lit(False))
    d = lines.join(base, by, "left").withColumn("new", new.cast("int")).withColumn("para", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])  # one paragraph
    return d.groupBy(*by, "para").agg(tx.join_lines(said).alias("text"), F.min_by("page", "line_no").alias("page_start"), F.max_by("page", "line_no").alias("page_end"))


def pieces(paras: DataFrame, by: list[str], budget: int, carry: list[str]) -> DataFrame:
    """(by, piece, of, text, and of each carried column its least, greatest and number of nulls), packed under a budget of words."""
    keyed = paras.withColumn("_by", F.struct(*by))
    d = passages.packed(keyed, "_by", "para", "text", budget, carry=carry)
    return d.withColumn("of", F.count("*").over(Window.partitionBy("_by"))).withColumn("piece", F.row_number().over(Window.partitionBy("_by").orderBy("piece"))).select("_by.*", "piece", "of", "text", *[c for c in d.columns if c.startswith(tuple(f"{x}_" for x in carry))])


def states(names: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(state, name, code) of the states that names (state) has: by way of an older name to its code; unknown ones have an empty code."""
    d = names.select("state").distinct().join(aliases.select(F.col("alias").alias("state"), F.col("name").alias("_now")), "state", "left").withColumn("name", F.coalesce("_now", "state")).drop("_now")
    return d.join(codes.select("name", "code"), "name", "left").select("state", "name", F.coalesce("code", F.lit("")).alias("code"))


def identified(d: DataFrame) -> DataFrame:
    return d.withColumn("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("locator"), F.col("text"))).withColumn("token_count", tx.word_count("text"))


def statute_chunks(lines: DataFrame, acts: DataFrame, codes: DataFrame, aliases: DataFrame, jurisdiction: str = "IN", budget: int = 450) -> DataFrame:
    """(doc_id, chunk_id, locator, section, section_heading, part, chapter, jurisdiction, status, act_title, text, embed_text, page_start, page_end, token_count, notes).

    acts: (doc_id, act_title, status, not_in_force array<string>), one row a law; codes (name, code) and aliases (alias, name) of
    states. A section of which a part isn't in force is partially in force; a state's block has the state's jurisdiction.
    """
    known = [r[0] for r in codes.select("name").unionByName(aliases.select(F.col("alias").alias("name"))).distinct().collect()]  # a register of fixed size
    u = splitting.statute_units(lines, known)
    by = ["doc_id", "unit", "block"]
    paras = paragraphs(u.select("doc_id", "line_no", "unit", "block").join(lines.select("doc_id", "line_no", "text", "page", "x0", "bold_prefix"), ["doc_id", "line_no"]), by)
    d = pieces(paras, by, budget, ["page_start", "page_end"]).join(u.drop("line_no").distinct(), by).join(acts, "doc_id")
    d = d.join(states(u.where("block > 0").select("state"), codes, aliases), "state", "left")
    d = d.join(splitting.linked_notes(lines, u.where("block = 0")), ["doc_id", "unit"], "left")
    rule = F.regexp_extract("num", r" r\. (.*)$", 1)
    place = F.when(F.col("kind") == "section", F.concat(F.lit("s. "), "num")).when(F.col("kind").isin("rule", "schedule"), F.col("num")).otherwise("Preamble")
    tail = F.when(F.col("kind") == "section", F.concat(F.lit("s. "), "num", F.lit(" — "), "heading")).when(F.col("kind") == "rule", F.concat(F.lit("r. "), rule, F.lit(" — "), "heading")).when(F.col("kind") == "schedule", F.col("num")).otherwise("Long title and preamble")
    in_state = F.col("block") > 0
    said = F.coalesce(F.nullif("name", F.lit("")), F.lit("unnamed"))
    place = F.when(in_state, F.concat(place, F.lit(", State amendment ("), said, F.lit(")"))).otherwise(place)
    tail = F.when(in_state, F.concat(tail, F.lit(" > State amendment: "), said)).otherwise(tail)
    part_of = F.when(F.col("of") > 1, F.format_string(" (part %d of %d)", "piece", "of")).otherwise("")
    partly = F.exists(F.coalesce("not_in_force", F.array().cast("array<string>")), lambda p: F.regexp_extract(p, r"^\w+", 0) == F.col("num")) & (F.col("kind") == "section")
    d = d.withColumn("part", tx.tidy_label("part")).withColumn("chapter", tx.tidy_label("chapter"))
    path = F.concat_ws(" > ", "act_title", "part", "chapter", tail)
    d = d.select(
        "doc_id", F.concat(place, part_of).alias("locator"), F.col("num").alias("section"), F.col("heading").alias("section_heading"), "part", "chapter", F.when(in_state, F.coalesce("code", F.lit(""))).otherwise(jurisdiction).alias("jurisdiction"),
        F.when(partly, "partially_in_force").otherwise(F.col("status")).alias("status"), "act_title", "text", F.concat(path, part_of, F.lit("\n"), "text").alias("embed_text"), F.col("page_start_min").alias("page_start"), F.col("page_end_max").alias("page_end"), F.when(~in_state, F.col("notes")).alias("notes"),
    )
    return identified(d)


def judgment_chunks(lines: DataFrame, cases: DataFrame, budget: int = 450) -> DataFrame:
    """(doc_id, chunk_id, locator, para_start, para_end, text, embed_text, page_start, page_end, token_count): a header of what is known of the case, then its paragraphs.

    cases: (doc_id, case_title, court, decision_date, judges array<string>, author, citation, neutral_citation, disposal_nature, cnr).
    A piece is located by its numbers; pieces of one number are counted; a number in more than MOST_PARTS pieces, or none, gives the page.
    """
    j = splitting.judgment_paragraphs(lines).join(lines.select("doc_id", "line_no", "text", "page"), ["doc_id", "line_no"])
    said = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])  # one paragraph
    paras = j.groupBy("doc_id", "para").agg(tx.join_lines(said).alias("text"), F.max("number").alias("number"), F.min_by("page", "line_no").alias("page_start"), F.max_by("page", "line_no").alias("page_end"))
    p = pieces(paras, ["doc_id"], budget, ["number", "page_start", "page_end"])
    only = (F.col("number_nulls") == 0) & (F.col("number_min") == F.col("number_max"))
    p = p.withColumn("only", F.when(only, F.col("number_min")))
    own = Window.partitionBy("doc_id", "only")
    p = p.withColumn("n", F.when(F.col("only").isNotNull(), F.count("*").over(own))).withColumn("k", F.row_number().over(own.orderBy("piece")))
    located = F.col("number_min").isNotNull() & ~F.coalesce(F.col("n") > MOST_PARTS, F.lit(False))
    pages = F.when(F.col("page_start_min") == F.col("page_end_max"), F.concat(F.lit("p. "), F.col("page_start_min").cast("string"))).otherwise(F.format_string("pp. %d-%d", "page_start_min", "page_end_max"))
    label = F.concat(splitting.paragraph_label(F.col("number_min"), F.col("number_max")), F.when(F.col("n") > 1, F.format_string(" (part %d of %d)", "k", "n")).otherwise(""))
    p = p.select("doc_id", F.when(located, label).otherwise(pages).alias("locator"), *[F.when(located, F.col(f"number_{m}") % 1000).alias(f"para_{x}") for m, x in (("min", "start"), ("max", "end"))], "text", F.col("page_start_min").alias("page_start"), F.col("page_end_max").alias("page_end"))
    cites = F.nullif(F.concat_ws("; ", F.nullif("citation", F.lit("")), F.nullif("neutral_citation", F.lit(""))), F.lit(""))
    c = cases.withColumn("_path", F.concat(tx.versus("case_title"), F.lit(" ("), "court", F.lit(", "), "decision_date", F.lit(")")))
    none = lambda x: F.lit(None).cast("int").alias(x)
    head = c.select("doc_id", F.lit("header").alias("locator"), none("para_start"), none("para_end"), tx.case_header(F.col("case_title"), F.col("court"), F.col("decision_date"), F.col("judges"), F.col("author"), cites, F.col("disposal_nature"), F.col("cnr")).alias("text"), none("page_start"), none("page_end"))
    d = head.unionByName(p).join(c.select("doc_id", "_path"), "doc_id")
    tail = F.when(F.col("locator") == "header", "case header").otherwise(F.col("locator"))
    return identified(d.withColumn("embed_text", F.concat("_path", F.lit(" > "), tail, F.lit("\n"), "text")).drop("_path"))
