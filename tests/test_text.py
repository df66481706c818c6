import pytest
from pyspark.sql import functions as F

from folioscope.functions import ids, scripts, vectors
from folioscope.functions import text as tx


def value(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make("t").alias("x")).first().x


CASES = [
    (tx.match_expression, 'What\'s "section 23" - NOT (registration) OR deed?', '"section" OR "23" OR "registration" OR "deed"'),
    (tx.match_expression, "the of and", None),
    (tx.slug, " s. 23(1) ", "s-23-1"),
    (tx.slug, "—", "x"),
    (tx.nice_title, "OF THE TIME OF PRESENTATION", "Of the Time of Presentation"),
    (tx.versus, "A versus B", "A v. B"),
    (tx.html_text, "<p>a&amp;b<br/>c &lt;</p>", "a&b c <"),
    (tx.straight, "“A  b”\n’C", "\"a b\" 'c"),
    (tx.trim_marker_runs, "x [S1][S2][S3][S4][S5][S6][S7]. y [S2][S4].", "x [S1][S2][S3]. y [S2][S4]."),
    (tx.tidy_markers, "a [none] b [] c .", "a b c."),
    (tx.section_numbers, "17(1)(b), 24, 25 and 26A", ["17", "24", "25", "26A"]),
    (tx.clause_sentences, "One (a). Two; Three: four! “Five.” Six", ["One (a).", "Two;", "Three: four!", "“Five.”", "Six"]),
    (tx.markers, "a [S1] b [ s12 ]", [1, 12]),
    (tx.excerpt, "short", "short"),
    (tx.estimated_tokens, "a b c d", 7),
    (scripts.dominant, "भूमि न्यायालय deed", "Deva"),
    (scripts.dominant, "12 .", "Zyyy"),
    (tx.iso_date, "2024-02-30", None),
]


@pytest.mark.parametrize(("make", "text", "want"), CASES)
def test_functions(spark, make, text, want):
    assert value(spark, make, text) == want


def test_excerpt_cuts_at_a_clause_or_a_blank(spark):
    assert value(spark, lambda c: tx.excerpt(c, 20), "Alpha beta gamma. delta epsilon") == "Alpha beta gamma. …"
    assert value(spark, lambda c: tx.excerpt(c, 12), "Alpha beta gamma delta") == "Alpha beta …"


def test_join_lines_keeps_compounds(spark):
    got = spark.sql("select array('the Inspector-', 'General of Registration', '', '  and  more') l").select(tx.join_lines(F.col("l")).alias("x")).first().x
    assert got == "the Inspector-General of Registration and more"


def test_roman(spark):
    assert [r.x for r in spark.sql("select explode(array(1, 4, 39, 50, 88)) n").select(tx.roman("n").alias("x")).collect()] == ["I", "IV", "XXXIX", "L", "LXXXVIII"]


def test_identities_and_vectors(spark):
    import hashlib

    row = spark.createDataFrame([("https://x/1#en", "s. 4", "text", [3.0, 4.0])], "u string, l string, t string, v array<float>")
    r = row.select(ids.chunk_id(ids.document_id(F.col("u")), F.col("l"), F.col("t")).alias("c"), vectors.norm("v").alias("n"), vectors.normalised("v").alias("u1"), vectors.hash_embedder(32)("t").alias("e")).first()
    assert r.c == f"{hashlib.sha256(b'https://x/1#en').hexdigest()[:12]}:s-4:{hashlib.sha1(b'text').hexdigest()[:8]}"
    assert r.n == 5 and r.u1 == [0.6, 0.8] and abs(sum(x * x for x in r.e) - 1) < 1e-5


def test_cards_and_headers(spark):
    html = '<p><strong>Coram : A. B. RAO<sup data-tooltip="Author">*</sup>, C. D. SEN</strong></p>'
    d = spark.createDataFrame([(html, "Rao versus .", ".", "PART I — OF THE DEEDS"), (None, "A v. B", "B", None)], "h string, t string, r string, l string")
    got = d.select(tx.coram("h").alias("c"), tx.case_title("t", "r").alias("t"), tx.tidy_label("l").alias("l")).collect()
    assert (got[0].c.judges, got[0].c.author, got[0].t, got[0].l) == (["A. B. RAO", "C. D. SEN"], "A. B. RAO", "Rao", "PART I — Of the Deeds")
    assert (got[1].c.judges, got[1].c.author, got[1].t, got[1].l) == ([], None, "A v. B", None)
    h = d.select(tx.case_header(F.lit("A v. B"), F.lit("C"), F.lit("2001-01-01"), F.array(F.lit("X")), F.lit("X"), F.lit(""), F.lit(None).cast("string"), F.lit("N1")).alias("h")).first().h
    assert h == "A v. B\nC — decided 2001-01-01\nBench: X (author: X)\nCNR: N1"


def test_unicode_forms(spark):
    from folioscope.functions import unicode

    d = spark.createDataFrame([("e\u0301tE\u0300  Straße",), (None,), ("plain",)], "t string")
    got = [(r.a, r.b) for r in d.select(unicode.nfc("t").alias("a"), unicode.folded_case("t").alias("b")).collect()]
    assert got == [("étÈ  Straße", "étè strasse"), (None, None), ("plain", "plain")]


def test_lay_terms_and_states(spark):
    from folioscope.operators import registry

    entries = [("eviction", ["thrown out", "kicked-out"]), ("bail", ["get out of jail", "जमानत"]), ("none", [])]
    d = spark.createDataFrame([("He was Thrown  out and thrown-out",), ("the जमानत।",), ("throwing out",), (None,)], "t string")
    got = [(r.m, r.w) for r in d.select(registry.matched(F.coalesce("t", F.lit("")), entries).alias("m"), registry.rewritten(F.col("t"), registry.matched(F.coalesce("t", F.lit("")), entries)).alias("w")).collect()]
    assert got == [(["eviction"], "He was Thrown  out and thrown-out (eviction)"), (["bail"], "the जमानत। (bail)"), ([], "throwing out"), ([], None)]


def test_years_bands_and_warnings(spark):
    assert tx.year_list("2016-2018") == [2016, 2017, 2018] and tx.year_list("2021, 2019,2019-2020") == [2019, 2020, 2021]
    d = spark.createDataFrame([(10.0, 100.0, ["x", None]), (50.0, 100.0, ["Removed 1"]), (90.0, 100.0, None)], "t double, h double, w array<string>")
    assert [tuple(r) for r in d.select(tx.in_band(F.col("t"), F.col("h")), tx.free_of("w", ["Removed"])).collect()] == [(True, True), (False, False), (True, True)]
    one = spark.createDataFrame([("a\n\n**Details:** gone\nstill\n\n**Next** b ",), ("**Details** all",), (None,)], "t string")
    assert [r[0] for r in one.select(tx.without_section("t", "Details")).collect()] == ["a\n\n**Next** b", "", None]
