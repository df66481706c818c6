import random

from pyspark.sql import functions as F

from folioscope.llm import scans

WORDS = "the seasonal policy wholly withheld any aggrieved tannery whereas review of statutory salvage reluctantly disputed occupied deposit against surveyor former invoice pending unless within adjoining long-standing vice-chairman by-law injury shall under cover clerk reasonable permanent".split()
COUNTS = {w: 500 for w in WORDS}


def reader():
    return scans.Reader(dict(COUNTS))


def test_each_defect_alone():
    r, title = reader(), "Lowwharf Trusts Act, 1944"
    assert scans.decode("the sea-\nsonal policy", title, r)[0] == {"hyphen"}
    assert scans.decode("the sea¬\nLOWWHARF TRUSTS ACT, 1944\nvii\nsonal policy", title, r)[0] == {"hyphen", "header", "pageno"}
    assert scans.decode("withheld any long-\nstanding review of vice-\nchairman", title, r)[0] == set()
    assert scans.decode("a9ainst the siirveyor", title, r)[0] == {"chars"}
    assert scans.decode("the pcrma-\nnent review", title, r)[0] == {"chars", "hyphen"}
    for line in ("vii", "145", "- 119 -", "p. 622", "[403]", "Page 9 of 12"):
        assert scans.decode(f"the policy\n{line}\nwithheld", title, r)[0] == {"pageno"}, line
    for line in ("TARROW LAW REPORTS", "331    LOWWHARF TRUSTS AC", "The Lindmoor Reporter", "[1958] 4 T.L.R.    Lowwharf Trusts Act, 1944"):
        assert scans.decode(f"the policy\n{line}\nwithheld", title, r)[0] == {"header"}, line
    for line in ("ORDER", "SCHEDULE II", "(1945)", "1945.", "the year 1945", "records.example.org/deed/8.pdf", "Ex. P.45 and 28(9)"):
        assert scans.decode(f"the policy\n{line}\nwithheld", title, r)[0] == set(), line


def test_repair_reads_confusions_hyphens_splits_and_merges():
    r = reader()
    text = "the sea-\nLOWWHARF TRUSTS ACT, 1944\nvii\nsonal^ po1icy | withheld anyaggrieved tannery un der long-\nstanding review."
    _, paras = scans.decode(text, "Lowwharf Trusts Act, 1944", r)
    assert paras == ["the seasonal policy withheld any aggrieved tannery under long-standing review."]


def test_paragraphs_by_dynamic_programming():
    lines = ["(1) the policy withheld any aggrieved tannery whereas the", "review of the salvage ended.", "(2) the clerk disputed the occupied deposit against the", "surveyor and then", "stopped."]
    assert scans.paragraphs(lines) == [(0, 2), (2, 5)]
    assert scans.paragraphs([]) == [] and scans.paragraphs(["one"]) == [(0, 1)]


CHUNKS = "rowid bigint, doc_id bigint, title string, text string, text_source string, page_start int, page_end int"


def tables(spark):
    random.seed(9)
    clean = [(100 + i, 50, "T", " ".join(random.choice(WORDS) for _ in range(80)), "layer", 1, 1) for i in range(60)]
    rows = [
        (1, 1, "Some Title Act, 1950", "the sea-\nsonal policy", "ocr", 1, 2), (2, 1, "Some Title Act, 1950", "the sea-\nsonal policy", "ocr", 3, 3), (3, 2, None, "a9ainst the clerk", "layer", None, None),
        (4, 1, "x", "a9ainst", "metadata", 1, 1), (5, 1, "x", None, "ocr", 1, 1), (6, 1, "x", "", "ocr", 1, 1), (7, 3, "x", " \n \n", "layer", 2, 1), (8, 3, "x", "the policy\n- 4 -\n" * 3000, "ocr", 1, 1),
    ]
    pages = [(1, 3, False), (1, 3, False), (1, 1, True), (2, 1, None)]
    return spark.createDataFrame(clean + rows + rows[:1], CHUNKS).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)), spark.createDataFrame(pages, "doc_id bigint, number int, usable boolean")


def test_defects_with_words_broadcast_or_joined(spark):
    chunks, pages = tables(spark)
    want = {(1, "hyphen"), (3, "chars"), (8, "pageno")}
    for bound in (scans.WORDS_BOUND, 12, 0):
        got = scans.defects(chunks, pages, bound).collect()
        assert len(got) == len(want) and {(r.rowid, r.defect) for r in got} == want
    assert scans.defects(chunks.limit(0), pages).count() == 0


def test_repaired_paragraphs(spark):
    chunks, pages = tables(spark)
    got = {(r.rowid, r.paragraph): r.text for r in scans.repaired(chunks, pages).where("rowid < 8").collect()}
    assert got == {(1, 1): "the seasonal policy", (3, 1): "against the clerk"}


def test_words_of_texts_with_broken_lines_count(spark):
    lined = "PARISH NOTES\nthe lindmoor court, the\nunion sea-\nPARISH NOTES\n12\nsonal court"
    chunks = spark.createDataFrame([(i, "Parish Notes", t) for i, t in enumerate([lined] * 3 + ["the court"] * 3 + [None])], "rowid bigint, title string, text string")
    assert {r.word: r.n for r in scans.words(chunks).collect()} == {"the": 9, "lindmoor": 3, "court": 9, "union": 3}


def test_misread_forms_that_are_counted_are_still_read():
    r = scans.Reader(COUNTS | {"surveyor": 900, "siirveyor": 4, "salvag": 4})
    assert scans.decode("the siirvey-\nor of siirveyor", "T", r) == ({"chars", "hyphen"}, ["the surveyor of surveyor"])
    r = scans.Reader({"délai": 900, "déla": 4})
    assert scans.decode("déla! délai", "T", r)[1] == ["délai délai"]
    r = scans.Reader({"model": 900, "mode": 400})
    assert scans.decode("mode! model", "T", r)[1] == ["mode! model"]


def test_repaired_with_words_broadcast_or_joined(spark):
    chunks, pages = tables(spark)
    hard = ["withheld un der review", "the sea-\n12\nsonal anyaggrieved ow¬\nLOWWHARF TRUSTS ACT, 1944\nner po1icy", "the pcrma-\nvii\nnent long-\n- 3 -\nstanding vice-\nchairman’s clcrk's a"]
    more = chunks.sparkSession.createDataFrame([(20 + i, 9, "Lowwharf Trusts Act, 1944", t, "ocr", 1, 1) for i, t in enumerate(hard)], CHUNKS)
    chunks = chunks.drop("word", "n").unionByName(more)
    a, b, c = (sorted(map(tuple, scans.repaired(chunks, pages, bound).collect())) for bound in (scans.WORDS_BOUND, 0, 12))
    assert a == b == c and (20, 1, "withheld under review") in b and any(r == 21 and x.startswith("the seasonal any aggrieved") for r, _, x in b)
