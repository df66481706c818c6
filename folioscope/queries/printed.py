"""Queries of printed laws, reports and uploads: the operators over lines of an invented law, an invented case and an invented deed.

The tables hold no printed lines, so these few are given here; the rows that must come out were checked by hand against the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import assembly, passages, splitting

LINES = "doc_id string, line_no int, text string, page int, x0 double, size double, bold_prefix string, markers array<string>"


def _line(text: str, page: int = 1, x0: float = 72.0, size: float = 12.0, bold: str = "", marks: tuple = ()) -> tuple:
    return text, page, x0, size, bold, list(marks)


LAW = [
    _line("THE MERE FERRIES ACT, 1931", x0=200.0), _line("ARRANGEMENT OF SECTIONS", x0=200.0), _line("1. Short title."), _line("2. Definitions of terms used."), _line("3. [Repealed.]"), _line("4. Tolls and the keeping of boats."), _line("4A. Night crossings."),
    _line("ACT NO. 7 OF 1931", x0=200.0), _line("An Act to regulate the ferries of the Mere."), _line("PART I", x0=200.0), _line("PRELIMINARY", x0=200.0),
    _line("1. Short title.—This Act may be called the Mere Ferries Act.", bold="1. Short title."), _line("2. Definitions of.—In this Act—", bold="2. Definitions of.", marks=("1",)), _line("(a) “boat” includes a raft;"), _line("(b) “toll” is what a ferry-"), _line("man takes."),
    _line("1. Subs. by Act 2 of 1940, s. 3.", size=8.0), _line("and again in 1951.", x0=90.0, size=8.0),
    _line("PART II. OF TOLLS", 2, 200.0), _line("“9. Quoted.—not a start", 2), _line("4. Tolls and the keeping of boats.—(1) A toll is due at the bank.", 2, bold="4. Tolls and the keeping of boats."), _line("(2) No toll is due from a judge.", 2, marks=("1", "*")), _line("Provided that judges pay at night.", 2),
    _line("STATE AMENDMENT", 2, bold="STATE AMENDMENT"), _line("Old Tarrow", 2, bold="Old Tarrow"), _line("In section 4, omit “judge”.", 2), _line("1. Ins. by Act 9 of 1960.", 2, size=8.0), _line("* A note by the printer.", 2, size=8.0), _line("*. Omitted.", 2, size=8.0),
    _line("4A. Night crossings.—No boat crosses by night.", 3, bold="4A. Night crossings."), _line("THE FIRST SCHEDULE", 3, 200.0), _line("ORDER II", 3, 200.0), _line("OF BOATS", 3, 200.0), _line("1. Lamps.—Each boat has a lamp.", 3, bold="1. Lamps."), _line("STATEMENT OF OBJECTS AND REASONS", 4, 200.0), _line("This is no law.", 4),
]
CASE = [
    _line("X, Adv. for the appellant."), _line("The Judgment of the Court"), _line("was delivered by"), _line("A. B. LORNE, J."), _line("1. Leave granted."), _line("2. The ferry was taken and"), _line("7. a quoted item goes on."), _line("3. The toll was paid."),
    _line("An indented start.", x0=90.0), _line("3.1 A sub-number."), _line("5. Four was missed.", 2), _line("C. D. SEDGE, J.", 2), _line("1. I agree.", 2), _line("2. Order.", 2), _line("Result of the case: allowed.", 2),
]
DEED = ["DEED OF LEASE", "1. The rent of the boat is due monthly.", "2. The term is " + "long " * 190 + "indeed.", "It ends in May.", "3. No cattle."]


def _lines(spark: SparkSession, rows: list[tuple], doc: str) -> DataFrame:
    return spark.createDataFrame([(doc, i, *r) for i, r in enumerate(rows)], LINES)


def statute_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = _lines(spark, LAW, "law")
    return splitting.unit_texts(d, splitting.statute_units(d, ["Old Tarrow"])).select("kind", "num", "block", "heading", "part", "chapter", "state", "text", "page_start", "page_end")


def statute_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.footnotes(_lines(spark, LAW, "law")).select("page", "marker", "note")


def contents_missing(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.missing_sections(_lines(spark, LAW, "law")).select("num", "heading")


def section_notes(spark: SparkSession, sf: str) -> DataFrame:
    d = _lines(spark, LAW, "law")
    u = splitting.statute_units(d, ["Old Tarrow"])
    n = splitting.linked_notes(d, u).join(u.where("block = 0").select("doc_id", "unit", "num").distinct(), ["doc_id", "unit"])
    return n.select("num", F.explode("notes").alias("n")).select("num", "n.page", "n.marker", F.col("n.text").alias("note"))


def margin_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = _lines(spark, LAW, "law")
    u = splitting.statute_units(d, ["Old Tarrow"]).where("kind = 'section' and block = 0")
    p = assembly.paragraphs(u.select("doc_id", "line_no", "num").join(d, ["doc_id", "line_no"]), ["doc_id", "num"])
    return p.select("num", "para", "text", "page_start", "page_end")


def statute_chunks(spark: SparkSession, sf: str) -> DataFrame:
    acts = spark.createDataFrame([("law", "Mere Ferries Act, 1931", "in_force", ["4A(1)"])], "doc_id string, act_title string, status string, not_in_force array<string>")
    codes, aliases = spark.createDataFrame([("Tarrow", "XX-TW")], "name string, code string"), spark.createDataFrame([("Old Tarrow", "Tarrow")], "alias string, name string")
    c = assembly.statute_chunks(_lines(spark, LAW, "law"), acts, codes, aliases, "XX", 10)
    return c.select("chunk_id", "locator", "section", "part", "chapter", "jurisdiction", "status", F.split("embed_text", "\n")[0].alias("path"), "token_count", F.coalesce(F.size("notes"), F.lit(0)).alias("n_notes"))


def judgment_lines(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.judgment_paragraphs(_lines(spark, CASE, "case")).drop("doc_id")


def judgment_chunks(spark: SparkSession, sf: str) -> DataFrame:
    case = ("case", "Lorne versus Ferrymen", "Court of the Mere", "1961-05-04", ["A. B. Lorne", "C. D. Sedge"], "A. B. Lorne", "[1961] 2 M.R. 7", "1961:MR:7", None, "M-7")
    cases = spark.createDataFrame([case], "doc_id string, case_title string, court string, decision_date string, judges array<string>, author string, citation string, neutral_citation string, disposal_nature string, cnr string")
    c = assembly.judgment_chunks(_lines(spark, CASE, "case"), cases, 8)
    return c.select("chunk_id", "locator", "para_start", "para_end", "text", "page_start", "page_end", F.split("embed_text", "\n")[0].alias("path"))


def deed_passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("deed", i, 1 + i // 3, t, i == 4, None) for i, t in enumerate(DEED)]
    d = spark.createDataFrame(rows, "doc_id string, line_no int, page int, text string, ocr boolean, bold_prefix string")
    return passages.upload_passages(d).select("n", "locator", "page_start", "page_end", "words", F.left("text", F.lit(20)).alias("start"))


QUERIES = {f.__name__: f for f in (statute_sections, statute_footnotes, contents_missing, section_notes, margin_paragraphs, statute_chunks, judgment_lines, judgment_chunks, deed_passages)}
#: The rows that must come out, by query: columns, then rows.
EXPECTED = {
    "statute_sections": (
        "kind VARCHAR, num VARCHAR, block INTEGER, heading VARCHAR, part VARCHAR, chapter VARCHAR, state VARCHAR, text VARCHAR, page_start INTEGER, page_end INTEGER",
        """
        ('preamble', 'Preamble', 0, 'Long title and preamble', NULL, NULL, NULL, 'An Act to regulate the ferries of the Mere.', 1, 1),
        ('rule', 'O. II r. 1', 0, 'Lamps', 'First Schedule', 'Order II — OF BOATS', NULL, '1. Lamps.—Each boat has a lamp.', 3, 3),
        ('schedule', 'First Schedule', 0, 'THE FIRST SCHEDULE', 'Part II — Of Tolls', NULL, NULL, 'THE FIRST SCHEDULE', 3, 3),
        ('section', '1', 0, 'Short title', 'Part I — Preliminary', NULL, NULL, '1. Short title.—This Act may be called the Mere Ferries Act.', 1, 1),
        ('section', '2', 0, 'Definitions of terms used', 'Part I — Preliminary', NULL, NULL, '2. Definitions of.—In this Act— (a) “boat” includes a raft; (b) “toll” is what a ferry-man takes. “9. Quoted.—not a start', 1, 2),
        ('section', '4', 0, 'Tolls and the keeping of boats', 'Part II — Of Tolls', NULL, NULL, '4. Tolls and the keeping of boats.—(1) A toll is due at the bank. (2) No toll is due from a judge. Provided that judges pay at night.', 2, 2),
        ('section', '4', 1, 'Tolls and the keeping of boats', 'Part II — Of Tolls', NULL, 'Old Tarrow', 'Old Tarrow In section 4, omit “judge”.', 2, 2),
        ('section', '4A', 0, 'Night crossings', 'Part II — Of Tolls', NULL, NULL, '4A. Night crossings.—No boat crosses by night.', 3, 3)
        """,
    ),
    "statute_footnotes": (
        "page INTEGER, marker VARCHAR, note VARCHAR",
        """
        (1, '1', 'Subs. by Act 2 of 1940, s. 3. and again in 1951.'),
        (2, '*', 'Omitted.'),
        (2, '1', 'Ins. by Act 9 of 1960. * A note by the printer.')
        """,
    ),
    "contents_missing": (
        "num VARCHAR, heading VARCHAR",
        """
        ('3', '[Repealed.]')
        """,
    ),
    "section_notes": (
        "num VARCHAR, page INTEGER, marker VARCHAR, note VARCHAR",
        """
        ('2', 1, '1', 'Subs. by Act 2 of 1940, s. 3. and again in 1951.'),
        ('4', 2, '*', 'Omitted.'),
        ('4', 2, '1', 'Ins. by Act 9 of 1960. * A note by the printer.')
        """,
    ),
    "margin_paragraphs": (
        "num VARCHAR, para INTEGER, text VARCHAR, page_start INTEGER, page_end INTEGER",
        """
        ('1', 0, '1. Short title.—This Act may be called the Mere Ferries Act.', 1, 1),
        ('2', 0, '2. Definitions of.—In this Act—', 1, 1),
        ('2', 1, '(a) “boat” includes a raft;', 1, 1),
        ('2', 2, '(b) “toll” is what a ferry-man takes.', 1, 1),
        ('2', 3, '“9. Quoted.—not a start', 2, 2),
        ('4', 0, '4. Tolls and the keeping of boats.—(1) A toll is due at the bank.', 2, 2),
        ('4', 1, '(2) No toll is due from a judge.', 2, 2),
        ('4', 2, 'Provided that judges pay at night.', 2, 2),
        ('4A', 0, '4A. Night crossings.—No boat crosses by night.', 3, 3)
        """,
    ),
    "statute_chunks": (
        "chunk_id VARCHAR, locator VARCHAR, section VARCHAR, part VARCHAR, chapter VARCHAR, jurisdiction VARCHAR, status VARCHAR, path VARCHAR, token_count INTEGER, n_notes INTEGER",
        """
        ('law:first-schedule:1fcdf1a6', 'First Schedule', 'First Schedule', 'Part II — Of Tolls', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > First Schedule', 3, 0),
        ('law:o-ii-r-1:5fbe392b', 'O. II r. 1', 'O. II r. 1', 'First Schedule', 'Order II — Of Boats', 'XX', 'in_force', 'Mere Ferries Act, 1931 > First Schedule > Order II — Of Boats > r. 1 — Lamps', 6, 0),
        ('law:preamble:9ccdecf8', 'Preamble', 'Preamble', NULL, NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Long title and preamble', 9, 0),
        ('law:s-1-part-1-of-2:dcf4ef66', 's. 1 (part 1 of 2)', '1', 'Part I — Preliminary', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part I — Preliminary > s. 1 — Short title (part 1 of 2)', 1, 0),
        ('law:s-1-part-2-of-2:e369572d', 's. 1 (part 2 of 2)', '1', 'Part I — Preliminary', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part I — Preliminary > s. 1 — Short title (part 2 of 2)', 10, 0),
        ('law:s-2-part-1-of-3:c0e189a8', 's. 2 (part 1 of 3)', '2', 'Part I — Preliminary', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part I — Preliminary > s. 2 — Definitions of terms used (part 1 of 3)', 10, 1),
        ('law:s-2-part-2-of-3:2eef0d62', 's. 2 (part 2 of 3)', '2', 'Part I — Preliminary', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part I — Preliminary > s. 2 — Definitions of terms used (part 2 of 3)', 7, 1),
        ('law:s-2-part-3-of-3:7db1d2e2', 's. 2 (part 3 of 3)', '2', 'Part I — Preliminary', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part I — Preliminary > s. 2 — Definitions of terms used (part 3 of 3)', 4, 1),
        ('law:s-4-part-1-of-4:0c8ed7a5', 's. 4 (part 1 of 4)', '4', 'Part II — Of Tolls', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4 — Tolls and the keeping of boats (part 1 of 4)', 1, 2),
        ('law:s-4-part-2-of-4:42a2bd30', 's. 4 (part 2 of 4)', '4', 'Part II — Of Tolls', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4 — Tolls and the keeping of boats (part 2 of 4)', 13, 2),
        ('law:s-4-part-3-of-4:8aca11d8', 's. 4 (part 3 of 4)', '4', 'Part II — Of Tolls', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4 — Tolls and the keeping of boats (part 3 of 4)', 8, 2),
        ('law:s-4-part-4-of-4:12a41435', 's. 4 (part 4 of 4)', '4', 'Part II — Of Tolls', NULL, 'XX', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4 — Tolls and the keeping of boats (part 4 of 4)', 6, 2),
        ('law:s-4-state-amendment-tarrow:fb89cee1', 's. 4, State amendment (Tarrow)', '4', 'Part II — Of Tolls', NULL, 'XX-TW', 'in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4 — Tolls and the keeping of boats > State amendment: Tarrow', 7, 0),
        ('law:s-4a:615b474c', 's. 4A', '4A', 'Part II — Of Tolls', NULL, 'XX', 'partially_in_force', 'Mere Ferries Act, 1931 > Part II — Of Tolls > s. 4A — Night crossings', 7, 0)
        """,
    ),
    "judgment_lines": (
        "line_no INTEGER, para INTEGER, number INTEGER, opinion INTEGER",
        """
        (10, 6, 5, 1),
        (11, 6, 5, 1),
        (12, 7, 1001, 2),
        (13, 8, 1002, 2),
        (3, 0, NULL, 1),
        (4, 1, 1, 1),
        (5, 2, 2, 1),
        (6, 2, 2, 1),
        (7, 3, 3, 1),
        (8, 4, 3, 1),
        (9, 5, 3, 1)
        """,
    ),
    "judgment_chunks": (
        "chunk_id VARCHAR, locator VARCHAR, para_start INTEGER, para_end INTEGER, text VARCHAR, page_start INTEGER, page_end INTEGER, path VARCHAR",
        """
        ('case:header:7137c0d3', 'header', NULL, NULL, 'Lorne versus Ferrymen' || chr(10) || 'Court of the Mere — decided 1961-05-04' || chr(10) || 'Bench: A. B. Lorne, C. D. Sedge (author: A. B. Lorne)' || chr(10) || 'Citation: [1961] 2 M.R. 7; 1961:MR:7' || chr(10) || 'CNR: M-7', NULL, NULL, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > case header'),
        ('case:para-1:ebed86e9', 'para 1', 1, 1, 'A. B. LORNE, J.' || chr(10) || '1. Leave granted.', 1, 1, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 1'),
        ('case:para-2-part-1-of-2:e97031e5', 'para 2 (part 1 of 2)', 2, 2, '2.', 1, 1, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 2 (part 1 of 2)'),
        ('case:para-2-part-2-of-2:2cb97268', 'para 2 (part 2 of 2)', 2, 2, 'The ferry was taken and 7. a quoted item goes on.', 1, 1, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 2 (part 2 of 2)'),
        ('case:para-3-part-1-of-2:851c2f97', 'para 3 (part 1 of 2)', 3, 3, '3. The toll was paid.' || chr(10) || 'An indented start.', 1, 1, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 3 (part 1 of 2)'),
        ('case:para-3-part-2-of-2:50252d97', 'para 3 (part 2 of 2)', 3, 3, '3.1 A sub-number.', 1, 1, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 3 (part 2 of 2)'),
        ('case:para-5:33237963', 'para 5', 5, 5, '5. Four was missed. C. D. SEDGE, J.', 2, 2, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > para 5'),
        ('case:paras-1-2-opinion-2:6147d69b', 'paras 1-2 (opinion 2)', 1, 2, '1. I agree.' || chr(10) || '2. Order.', 2, 2, 'Lorne v. Ferrymen (Court of the Mere, 1961-05-04) > paras 1-2 (opinion 2)')
        """,
    ),
    "deed_passages": (
        "n INTEGER, locator VARCHAR, page_start INTEGER, page_end INTEGER, words INTEGER, start VARCHAR",
        """
        (1, 'clause 1 · p. 1', 1, 1, 12, 'DEED OF LEASE' || chr(10) || '1. The'),
        (2, 'clause 2 · pp. 1-2 · OCR', 1, 2, 199, '2. The term is long '),
        (3, 'clause 3 · p. 2 · OCR', 2, 2, 3, '3. No cattle.')
        """,
    ),
}


def _sql(columns: str, rows: str) -> str:
    names = [c.split()[0] for c in columns.split(", ")]
    return "SELECT " + ", ".join(f'"{n}"::{c.split()[1]} AS "{n}"' for n, c in zip(names, columns.split(", "), strict=True)) + f" FROM (VALUES {rows}) AS t({', '.join(names)})"


SQL = {name: _sql(*x) for name, x in EXPECTED.items()}
