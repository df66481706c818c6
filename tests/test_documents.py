import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import passages, quality, splitting, store
from folioscope.sources import files, sinks

LINES = "doc_id string, line_no int, text string, page int, x0 double, size double, bold_prefix string, markers array<string>"


def lines(spark, rows):
    full = [(r[0], i, *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LINES)


def L(text, page=1, x0=72.0, size=12.0, bold="", markers=()):
    return ("law", text, page, x0, size, bold, list(markers))


LAW = [
    L("ARRANGEMENT OF SECTIONS", x0=200.0), L("1. Short title."), L("2. Definitions of terms."), L("3. Omitted."), L("4. Rule-making."), L("THE SCHEDULE", x0=200.0), L("9. Not a section."),
    L("ACT NO. 5 OF 1950"), L("An Act to test."), L("PART I", x0=200.0), L("PRELIMINARY", x0=200.0), L("1. Short title.—(1) This is it.", bold="1. Short title.", markers=["1"]),
    L("1. Subs. by Act 2, s. 3.", size=8.0), L("continued note", size=8.0, x0=90.0),
    L("“9. Quoted.—not a start", 2), L("2. Definitions of.—In this Act", 2, bold="2. Definitions of."), L("terms wrap-", 2), L("ping goes on.", 2), L("STATE AMENDMENT", 2, bold="STATE AMENDMENT"), L("Tarrow", 2, bold="Tarrow"), L("In section 2 omit.", 2),
    L("4. Rule-making.—The Board may.", 3, bold="4. Rule-making."), L("THE FIRST SCHEDULE", 3, 200.0), L("ORDER XXXIX", 3, 200.0), L("INJUNCTIONS", 3, 200.0), L("1. Cases.—Where so.", 3, bold="1. Cases."), L("STATEMENT OF OBJECTS AND REASONS", 4), L("This is dropped.", 4),
]


def test_statute_sections_notes_and_state_blocks(spark):
    d = lines(spark, LAW)
    u = splitting.statute_units(d, ["Tarrow"])
    texts = {(r.kind, r.num, r.block): r for r in splitting.unit_texts(d, u).collect()}
    assert set(texts) == {("preamble", "Preamble", 0), ("section", "1", 0), ("section", "2", 0), ("section", "2", 1), ("section", "4", 0), ("schedule", "First Schedule", 0), ("rule", "O. XXXIX r. 1", 0)}
    two = texts["section", "2", 0]
    assert two.heading == "Definitions of terms" and two.text.endswith("terms wrap-ping goes on.") and two.part == "Part I — Preliminary" and (two.page_start, two.page_end) == (2, 2)
    assert texts["section", "2", 1].state == "Tarrow" and texts["section", "2", 1].text == "Tarrow In section 2 omit."
    assert texts["rule", "O. XXXIX r. 1", 0].chapter == "Order XXXIX — INJUNCTIONS" and "“9. Quoted" in texts["section", "1", 0].text
    notes = {r.unit: [(n.marker, n.text) for n in r.notes] for r in splitting.linked_notes(d, u).collect()}
    assert list(notes.values()) == [[("1", "Subs. by Act 2, s. 3. continued note")]]
    assert [(r.num, r.heading) for r in splitting.missing_sections(d).collect()] == [("3", "Omitted.")]
    assert splitting.statute_units(lines(spark, LAW[:5])).count() == 0


def J(text, page=1, x0=72.0):
    return ("case", text, page, x0, 12.0, None, [])


def test_judgment_paragraphs(spark):
    rows = [
        J("Counsel list 1. Not this."), J("The Judgment of the Court"), J("was delivered by"), J("A. B. RAO, J."), J("1. Leave granted."), J("2. The facts are these and"), J("7. a quoted item goes on."), J("3. The law."),
        J("An indented start.", x0=90.0), J("3.1 A sub-number."), J("5. Four was missed."), J("C. D. SEN, J."), J("1. I agree."), J("2. Order."), J("Result of the case: allowed."), J("3. Not this."),
    ]
    got = splitting.judgment_paragraphs(lines(spark, rows)).orderBy("line_no").collect()
    by = {}
    for r in got:
        by.setdefault((r.para, r.number, r.opinion), []).append(rows[r.line_no][1])
    numbers = [k[1] for k in by]
    assert numbers == [None, 1, 2, 3, 3, 3, 5, 1001, 1002] and got[0].line_no == 3 and got[-1].line_no == 13
    assert by[2, 2, 1] == ["2. The facts are these and", "7. a quoted item goes on."]
    assert splitting.judgment_paragraphs(lines(spark, rows[4:8])).count() == 0
    labels = spark.sql("select * from values (3, 5), (1002, 1002), (4, 4), (7, 1001), (null, null) as t(a, b)").select(splitting.paragraph_label(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in labels] == ["paras 3-5", "para 2 (opinion 2)", "para 4", "paras 7-1 (opinion 1)", None]
    one = [J("A. B. RAO, J. 1. Leave granted.", 2), J("2. Next."), J("C. D. SEN, J. 1. I agree.")]
    got = splitting.judgment_paragraphs(lines(spark, [J("x"), *one])).orderBy("line_no").collect()
    assert [(r.line_no, r.number, r.opinion) for r in got] == [(1, 1, 1), (2, 2, 1), (3, 1001, 2)]
    misread = [J("The Qrder of the Com1 was delivered by"), J("RAO, J."), J("1. Leave granted."), J("headnote of the case was passed"), J("no number here")]
    assert [r.line_no for r in splitting.judgment_paragraphs(lines(spark, misread)).orderBy("line_no").collect()][0] == 1
    counsel = [J("X, Adv. for the appellant."), J("Text begins."), J("And goes on."), J("Y, Adv. for the respondent.")]
    assert [r.line_no for r in splitting.judgment_paragraphs(lines(spark, counsel)).orderBy("line_no").collect()] == [1, 2, 3]


def test_packing(spark):
    p = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a b c", "d e", "f g h i", "One two. Three four. Five six seven eight nine ten eleven.", "z"])], "doc string, n int, t string")
    got = [(r.piece, r.text, r.n) for r in passages.packed(p, "doc", "n", "t", 6).orderBy("piece").collect()]
    assert got == [(0, "a b c\nd e", 5), (1, "f g h i", 4), (2, "One two. Three four.", 4), (3, "Five six seven eight nine ten eleven.", 7), (4, "z", 1)]


def test_upload_passages(spark):
    rows = [("u", i, p, t, o) for i, (p, t, o) in enumerate([(1, "LEASE DEED", False), (1, "1. The rent " + "word " * 150, False), (2, "2. The term " + "word " * 100, True), (2, "", False), (4, "3. Short.", False)])]
    got = passages.upload_passages(spark.createDataFrame(rows, "doc_id string, line_no int, page int, text string, ocr boolean")).orderBy("n").collect()
    assert [r.locator for r in got] == ["clause 1 · p. 1", "clauses 2-3 · pp. 2-4 · OCR"] and all(r.words <= 200 for r in got)
    labels = spark.createDataFrame([("clause", ["3.1", "3.2", "3.10"]), ("section", ["6", "1"]), ("para", ["7"]), ("para", []), ("para", ["4", "3", "2", "1"])], "w string, n array<string>").select(passages.number_label(F.col("w"), F.col("n"))).collect()
    assert [r[0] for r in labels] == ["clauses 3.1-3.10", "sections 6, 1", "para 7", None, "paras 4, 3, 2 …"]
    long = [("v", i, 1 + i // 40, "7.5 It " + "w " * 18 if not i else "w " * 20, False, "") for i in range(30)] + [("v", 90, 2, "SIGNED AND SEALED", False, ""), ("v", 91, 2, "Article 9 ends", False, ""), ("v", 92, 2, "Bold line", False, "Bold line")]
    got = passages.upload_passages(spark.createDataFrame(long, "doc_id string, line_no int, page int, text string, ocr boolean, bold_prefix string")).orderBy("n").collect()
    assert [(r.locator, r.words) for r in got] == [("para 7.5 · p. 1", 200), ("para 7.5 · p. 1", 200), ("para 7.5 · p. 1", 200), ("para 9 · p. 2", 8)]
    assert passages.relabelled("x [S1][S2]", {"S1": "D1", "S2": "S1"}) == "x [D1][S1]"


def test_rows_of_fragments(spark):
    f = spark.createDataFrame([("d", 1, 50.0, 10.0, 10.0, "world"), ("d", 1, 0.0, 12.0, 10.0, "hello"), ("d", 1, 0.0, 30.0, 10.0, "next")], "doc_id string, page int, left double, top double, height double, text string")
    assert [r.text for r in passages.merged_rows(f).orderBy("row").collect()] == ["hello world", "next"]
    f = spark.createDataFrame([("d", 1, 0.0, 10.0, 30.0, "tall"), ("d", 1, 20.0, 12.0, 4.0, "a"), ("d", 1, 40.0, 30.0, 8.0, "b"), ("d", 1, 0.0, 60.0, 8.0, None)], "doc_id string, page int, left double, top double, height double, text string")
    assert [r.text for r in passages.merged_rows(f).orderBy("row").collect()] == ["tall a b", ""]


def test_validation_reasons(spark):
    base = dict(chunk_id="c", doc_id="d", doc_type="statute", title="t", source_name="s", source_url="https://x", licence="l", retrieved_at="2026-01-01", authority="a", jurisdiction="IN", language="en", script="Latn", locator="s. 1", text="x", token_count=1, status="in_force", domain_tags=["a"], text_source="layer", page_start=1, page_end=1, ocr_confidence=None, act_title="A", act_year=1900, section="1", section_heading="h", case_title=None, court=None, decision_date=None, issuing_body=None, valid_as_of=None)
    schema = ", ".join(f"{k} {'int' if k in ('token_count', 'page_start', 'page_end', 'act_year') else 'double' if k == 'ocr_confidence' else 'array<string>' if k == 'domain_tags' else 'string'}" for k in base)
    cases = [
        ({}, []), ({"title": " TBD "}, ["placeholder value in title"]), ({"section": ""}, ["missing section"]), ({"doc_type": "poem"}, ["doc_type not allowed"]), ({"token_count": 0, "act_year": 1700}, ["token_count not positive", "impossible act_year"]),
        ({"text_source": "ocr", "page_end": None}, ["missing pages", "missing ocr_confidence"]), ({"retrieved_at": "2027-01-01"}, ["retrieved_at in the future"]), ({"domain_tags": []}, ["missing domain_tags"]),
        ({"doc_type": "judgment", "case_title": "Rao v. .", "court": "Supreme Court of India", "decision_date": "1949-01-01"}, ["placeholder party", "decision_date before the court"]),
    ]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    assert [r.p for r in df.select(quality.problems(df, "2026-07-01").alias("p")).collect()] == [w for _, w in cases]


def test_stored_documents_are_replaced_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "rowid bigint, doc_id string, text string")
    new = spark.createDataFrame([(10, "a", "x2"), (11, "a", "x2"), (12, "a", "x3")], "rowid bigint, doc_id string, text string")
    once = store.replaced(old, new, "doc_id", ["doc_id", "text"], "rowid")
    twice = store.replaced(once, new, "doc_id", ["doc_id", "text"], "rowid")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(2, "b", "y"), (10, "a", "x2"), (12, "a", "x3")]
    want, have = (spark.createDataFrame(r, "k string, h string") for r in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("z", "0")]))
    assert {r.k: r.state for r in store.three_way(want, have, "k", "h").collect()} == {"a": "current", "b": "stale", "c": "missing", "z": "orphan"}


def test_ledger_and_sinks(spark, tmp_path):
    p = str(tmp_path / "ledger")
    sinks.append_ledger(spark.createDataFrame([("s", "u1", "h1")], "source string, url string, sha256 string"), p)
    (tmp_path / "ledger" / "zz.json").write_text('\n{"source": "s", "url": "u1", "sha256": "h2"}\nnot json\n{"source": "t", "url": "u2"}\n')
    d = files.ledger(spark, p)
    assert {r.url: r.sha256 for r in store.last_wins(d.withColumn("seq", F.struct(F.col("seq.f").contains("zz"), "seq")), "url", "seq").collect()} == {"u1": "h2", "u2": None}
    sinks.swapped(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t"), ["k"])
    sinks.swapped(spark.createDataFrame([(2, "c")], "k int, v string"), str(tmp_path / "t"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    assert sinks.markdown(spark.sql("select 1 a, cast(null as string) b"), "T").splitlines()[-1] == "| 1 | — |"


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>")
    return b.getvalue()


def test_file_kinds_words_and_tables(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Deed</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:lastRenderedPageBreak/><w:t>Second</w:t></w:r></w:p>'
    for name, content in {"a.docx": docx(body), "b.pdf": b"%PDF-1.7 x", "c.png": b"\x89PNG\r\n\x1a\n", "d.docx": b"PK\x03\x04 broken word/", "e.txt": b"plain"}.items():
        (tmp_path / name).write_bytes(content)
    got = files.contents(spark, str(tmp_path))
    kinds = {r.n: r.k for r in got.select(F.regexp_extract("path", "([^/]+)$", 1).alias("n"), files.kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.docx": "docx", "b.pdf": "pdf", "c.png": "image", "d.docx": "docx", "e.txt": None}
    rows = files.docx_lines(got.where("path like '%docx'")).collect()
    assert [(r.page, r.text, r.heading) for r in rows if r.problem is None] == [(1, "Deed", True), (1, "a | b", False), (2, "Second", False)]
    assert [r.problem for r in rows if r.problem] == ["BadZipFile"]


def test_ocr_words_to_lines(spark):
    w = spark.createDataFrame([("d", 5, 1, 1, 1, 1, 30, 5, 10, 10, 90.0, "world"), ("d", 5, 1, 1, 1, 1, 0, 4, 10, 10, 80.0, "hello"), ("d", 5, 1, 1, 1, 2, 0, 20, 10, 10, -1.0, "noise"), ("d", 4, 1, 1, 1, 1, 0, 0, 0, 0, 99.0, "")], "doc_id string, level int, page_num int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string")
    r = files.ocr_lines(w, 0.5).collect()
    assert len(r) == 1 and (r[0].text, r[0].left, r[0].bottom, r[0].confidence) == ("hello world", 0.0, 7.5, 0.85)


def test_registry_and_sidecars(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("- id: a-1\n  title: The A Act, 1900\n  short_title: A Act, 1900\n  aliases: [AA]\n  in_force_from: 1900-01-01\n")
    r = files.registry(spark, str(tmp_path / "s.yaml")).first()
    assert (r.id, r.aliases, r.in_force_from, r.successor) == ("a-1", ["AA"], "1900-01-01", None)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "case7.json").write_text(json.dumps({"case_title": "A v. B"}, indent=1))
    assert files.sidecars(spark, str(tmp_path / "j")).select("stem", "case_title").first() == ("case7", "A v. B")
