import pytest

from folioscope.operators import registry, search
from folioscope.plans import answer
from folioscope.plans.retrieve import MODES, retrieve

CHUNKS = (
    "chunk bigint, doc_id string, doc_type string, title string, act_title string, section string, section_heading string, case_title string, court string, decision_date string, citation string, "
    "jurisdiction string, locator string, para_start int, token_count int, status string, source_name string, source_url string, retrieved_at string, text string"
)


def chunk(i, kind, text, act=None, section=None, heading=None, case=None, locator="x", doc=None):
    return (i, doc or f"d{i}", kind, case or act or "T", act, section, heading, case, "C" if case else None, "2001-01-01" if case else None, None, "IN", locator, None, len(text.split()), "in_force", "S", "https://x", "2026-01-01T00:00:00", text)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        chunk(1, "statute", "A lease of land shall be registered within four months of its execution.", "Deeds Act, 1908", "23", "Time for presenting"),
        chunk(2, "statute", "A fine is due for late deeds.", "Deeds Act, 1908", "25", "Fine"),
        chunk(3, "judgment", "The lease was not registered. The deed was late.", case="Rao v. Collector", locator="para 2", doc="j1"),
        chunk(4, "judgment", "Rao v. Collector: header", case="Rao v. Collector", locator="header", doc="j1"),
        chunk(5, "statute", "The Old Deeds Act, 1880 is repealed.", "Deeds Act, 1908", "93", "Repeals"),
        chunk(6, "form", "Form for a fence."),
    ]
    c = spark.createDataFrame(rows, CHUNKS)
    s = spark.createDataFrame([("deeds-1908", "The Deeds Act, 1908", "Deeds Act, 1908", ["Deeds Act"], "in_force", None, None), ("old-1880", "The Old Deeds Act, 1880", "Old Deeds Act, 1880", [], "repealed", "1908-01-01", "deeds-1908")], "id string, title string, short_title string, aliases array<string>, status string, repealed_from string, successor string")
    q = spark.createDataFrame([("sec", "What does section 25 of the Deeds Act, 1908 say?"), ("case", "What was held in Rao v. Collector on deeds?"), ("old", "Is the Old Deeds Act, 1880 in force?"), ("none", "zebra quark"), ("gone", "section 99 of the Deeds Act on late deeds")], "query_id string, question string")
    return q, c, s


def order(r, query):
    return [x.chunk for x in r.candidates.where(f"query_id = '{query}'").orderBy("final").collect()]


def test_full_mode_pins_what_is_named(corpus):
    r = retrieve(*corpus, "full")
    assert order(r, "sec")[0] == 2 and order(r, "case")[:2] == [4, 3] and order(r, "old")[0] == 5 and order(r, "none") == []
    gate = {x.query_id: (x.gate, x.abstained) for x in r.gate.collect()}
    assert gate["sec"] == ("exact", False) and gate["none"] == ("none", True)
    assert [(x.query_id, x.note) for x in r.notes.collect()] == [("gone", "Section 99 of Deeds Act, 1908 was not found.")]


@pytest.mark.parametrize("mode", MODES)
def test_all_modes_rank(spark, corpus, mode):
    q, c, s = corpus
    from pyspark.sql import functions as F

    from folioscope.functions.vectors import hash_embedder

    encode = hash_embedder(16)
    qv, cv = q.select("query_id", encode("question").alias("embedding")), c.select("chunk", encode("text").alias("embedding"))
    r = retrieve(q, c, s, mode, query_vectors=qv, chunk_vectors=cv)
    d = r.candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.max("final").alias("m")).collect()
    assert d and all(x.n == x.m for x in d)
    gates = {x.query_id: (x.gate, x.abstained) for x in r.gate.collect()}
    if mode in ("dense", "hybrid"):  # hashed vectors are near nothing
        assert gates["sec"] == ("dense", True) and gates["none"] == ("dense", True)
    elif mode == "keyword":
        assert gates["sec"] == ("none", False) and gates["none"] == ("none", True)
    if mode in ("dense", "keyword"):
        raw = search.bm25(q, c, "chunk", k=50) if mode == "keyword" else None
        if raw is not None:
            assert {(x.query_id, x.chunk) for x in raw.collect()} <= {(x.query_id, x.chunk) for x in r.candidates.collect()}
    with pytest.raises(ValueError, match="mode"):
        retrieve(q, c, s, "other")


def test_answers_are_grounded_in_their_context(corpus):
    q, c, s = corpus
    r = retrieve(q, c, s, "full")
    blocks = answer.context(r.candidates.select("query_id", "chunk", "fused", "final", "doc_type", "token_count"), c.drop("doc_type", "token_count").join(c.select("chunk", "doc_type", "token_count"), "chunk"))
    got = {x.query_id: x for x in answer.answered(r.gate, blocks, registry.names_of(s)).collect()}
    assert got["none"].abstained and got["none"].answer is None and got["none"].confidence == "low"
    assert "A fine is due for late deeds. [S" in got["sec"].answer and got["sec"].used and got["sec"].warnings == []
    assert all(x.verbatim for x in answer.cards(blocks).collect())
    notes = answer.repeal_notes(r.classified.selectExpr("query_id", "explode(acts) as act"), s).collect()
    assert [(x.query_id, x.note) for x in notes] == [("old", "Old Deeds Act, 1880 is repealed from 1908-01-01; it was replaced by Deeds Act, 1908.")]


def test_a_generator_without_marks_falls_back(corpus):
    q, c, s = corpus
    r = retrieve(q, c, s, "full")
    blocks = answer.context(r.candidates.select("query_id", "chunk", "fused", "final", "doc_type", "token_count"), c.drop("doc_type", "token_count").join(c.select("chunk", "doc_type", "token_count"), "chunk"))
    bare = lambda b: b.select("query_id").distinct().selectExpr("query_id", "'**Short answer:** This claim has no mark at all.' as answer")
    got = {x.query_id: x for x in answer.answered(r.gate, blocks, None, bare).collect()}
    assert got["sec"].answer.startswith("**What the sources say:**") and got["sec"].confidence == "low"


def test_passages_of_an_upload(spark):
    p = spark.createDataFrame([("u", i, t, len(t.split())) for i, t in enumerate(["Opening words here", "rent is due monthly", "the term is long", "rent may rise", "other matter entirely"], 1)], "doc_id string, n int, text string, words int")
    t = spark.createDataFrame([("q", "When is rent due?", "u")], "query_id string, question string, doc_id string")
    assert sorted(r.n for r in answer.selected_passages(p, t, 100).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.n for r in answer.selected_passages(p, t, 10).collect()) == [1, 2, 4]


def test_lay_terms_reach_legal_wording(corpus):
    _, c, s = corpus
    q = c.sparkSession.createDataFrame([("lay", "penalty when papers come in late")], "query_id string, question string")
    plain, wide = (retrieve(q, c, s, "hybrid", lay_terms=t) for t in (None, [("fine is due", ["penalty"])]))
    assert order(wide, "lay")[0] == 2 and {x.chunk: x.score for x in wide.candidates.collect()}[2] >= {x.chunk: x.score for x in plain.candidates.collect()}[2]
