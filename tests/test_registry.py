import pytest

from folioscope.operators import citations, registry

ROWS = [
    ("cpa-1986", "The Consumer Protection Act, 1986", "Consumer Protection Act, 1986", ["CPA 1986"], "repealed", "cpa-2019"),
    ("cpa-2019", "The Consumer Protection Act, 2019", "Consumer Protection Act, 2019", ["Consumer Protection Act", "COPRA"], "in_force", None),
    ("registration-1908", "The Registration Act, 1908", "Registration Act, 1908", ["Registration Act"], "in_force", None),
    ("crpc-1973", "The Code of Criminal Procedure, 1973", "Code of Criminal Procedure, 1973", ["CrPC", "Cr.P.C."], "repealed", "bnss-2023"),
]


@pytest.fixture(scope="module")
def statutes(spark):
    return spark.createDataFrame(ROWS, "id string, title string, short_title string, aliases array<string>, status string, successor string")


@pytest.fixture(scope="module")
def names(statutes):
    return registry.names_of(statutes)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("under the Consumer Protection Act 1986 he", ["cpa-1986"]), ("Consumer  Protection Act, 2019", ["cpa-2019"]), ("the consumer protection act?", ["cpa-2019"]),
        ("Section 438 Cr.P.C. and CrPC", ["crpc-1973", "crpc-1973"]), ("xCrPC CrPCs .CrPC", []), ("", []), ("The Registration Act, 1908 v. Registration Act", ["registration-1908"] * 2),
    ],
)
def test_longest_name_from_the_left(names, text, want):
    assert [ids[0] for _, _, ids in names.find(text)] == want


def test_successors_are_searched_too(names):
    assert names.find("Consumer Protection Act, 1986")[0][2] == ("cpa-1986", "cpa-2019")


def test_classification(spark, names):
    q = [("1", "What does section 23 of the Registration Act say?"), ("2", "Order 39 Rule 1 CPC?"), ("3", "The police arrested my brother in 2023 under the Consumer Protection Act 1986"), ("4", "hello"), ("5", None)]
    q += [("6", "Is the Registration Act different in New Tarrow since 3.4.1999 and 12/11/2001? The bail is due tomorrow in Tarrow."), ("7", "bail under the Registration Act, then police")]
    states = [("XX-TW", ["Tarrow"]), ("XX-NT", ["New Tarrow"]), ("XX-ZZ", ["Zed"])]
    got = {r.query_id: r for r in registry.classified(spark.createDataFrame(q, "query_id string, question string"), names, states=states).collect()}
    assert got["6"].years == ["1999", "1999-04-03", "2001", "2001-11-12"] and got["6"].jurisdictions == ["XX-NT", "XX-TW"] and got["6"].high_stakes and not got["4"].high_stakes
    assert got["7"].domain == "property_land" and got["3"].high_stakes and got["5"].jurisdictions == []
    assert (got["1"].intent, got["1"].acts, got["1"].domain) == ("statute_lookup", ["registration-1908"], "property_land")
    assert got["2"].rules == ["O. XXXIX r. 1"] and got["2"].intent == "statute_lookup"
    assert got["3"].domain == "consumer" and got["3"].years == ["2023"]
    assert (got["4"].intent, got["4"].domain) == ("explain", "other") and got["5"].mentions == []


def test_nearest_law_of_a_section(spark, names):
    q = spark.createDataFrame([("1", "CrPC s. 4(1) and then under section 23A of the Registration Act"), ("2", "section 5 alone"), ("3", None)], "query_id string, question string")
    got = [(r.query_id, r.act, r.section, r.sub) for r in registry.section_refs(registry.with_mentions(q, "question", names), "query_id", "question").orderBy("query_id", "seq").collect()]
    assert got == [("1", "crpc-1973", "4", "(1)"), ("1", "registration-1908", "23A", None), ("2", None, "5", None)]


S1 = {"text": "Under section 23 a document “shall be presented within four months” of its date. The Collector v. Rao decided so in 2001.", "title": "T", "act_title": "Registration Act, 1908", "doc_type": "statute", "section": "23", "locator": "s. 23", "status": "in_force", "successor": None}
S2 = {"text": "Section 438 of the CrPC allows bail. (1980) 2 SCC 565 applies. See Order XXI too.", "title": "U", "act_title": None, "doc_type": "judgment", "section": None, "locator": "para 3", "status": "n/a", "successor": None}
S3 = {"text": "It says nothing.", "title": "V", "act_title": "Code of Criminal Procedure, 1973", "doc_type": "statute", "section": "9", "locator": "s. 9", "status": "repealed", "successor": "bnss-2023"}
GOOD = "It “shall be presented within four months” [S1]."
#: Answer -> what must come out.
CASES = [
    ("It holds [S1, S2]. And [S1][S9]. None [N/A]. Range [S1-S2].", {"text": "It holds [S1][S2]. And [S1]. None. Range [S1][S2].", "unknown": ["S9"], "used": ["S1", "S2"]}),
    ("Wide [S1-S30] and odd [ s02 ] marks [].", {"text": "Wide [S1] and odd [S2] marks.", "unknown": ["S30"]}),
    (GOOD, {"text": GOOD, "quotes": []}),
    ("First one stays [S1]. It “shall be presented within five months” [S1]. Last one stays [S2].", {"text": "First one stays [S1]. Last one stays [S2].", "quotes": ["shall be presented within five months"]}),
    ("It “shall be presented … four months” [S1].", {"quotes": []}), ("It “shall … within … four months” [S1].", {"quotes": ["shall … within … four months"]}), ("It “shall be presented within four months” [S2].", {"quotes": ["shall be presented within four months"]}),
    ("Section 23 says so [S1].", {"authorities": []}), ("Section 88 says so [S1].", {"authorities": ["section 88"]}), ("Sections 23, 24(1) and 438 say so.", {"authorities": ["section 24"]}),
    ("Section 438 of the CrPC allows it [S2].", {"authorities": []}), ("Section 23 of the CrPC allows it [S1].", {"authorities": ["section 23 of the Code of Criminal Procedure, 1973"]}), ("The CrPC's section 438 allows it [S2].", {"authorities": []}),
    ("Section 23 of the Registration Act is it [S1].", {"authorities": []}), ("Order XXI allows it [S2]. Order XXII doesn't [S2].", {"authorities": ["Order XXII"]}),
    ("As (1980) 2 SCC 565 held [S2]. As (1981) 2 SCC 565 held [S2].", {"authorities": ["(1981) 2 SCC 565"]}), ("It, as Collector v. Rao had it, so [S1]. It, as Singh v. Rao had it, so [S1].", {"authorities": ["Singh v. Rao"]}),
    ("The Registration Act, 1908 holds [S1]. The Registration Act, 1909 holds [S1]. Consumer Protection Act, 1986 holds [S1].", {"authorities": ["The Registration Act, 1909", "Consumer Protection Act, 1986"]}),
    ("**Short answer:** Section 99 applies here [S1].\nThe rest stays.", {"text": "**Short answer:**\nThe rest stays.", "removed": ["**Short answer:** Section 99 applies here [S1]."]}),
    ("See No. 5 of A. B. Rao here. Next one.", {"text": "See No. 5 of A. B. Rao here. Next one."}),
    ("**Short answer:** This is a claim without any mark. This one has a mark indeed [S1]. The sources do not say more here.\n**Other:** Nothing is counted under this heading.", {"unsupported": 1, "unsupported_share": 0.5}),
    ("It is old [S3].", {"used": ["S3"], "warnings": ["[S3] Code of Criminal Procedure, 1973 is repealed; it was replaced by bnss-2023. It may still govern events or proceedings from before the repeal."]}),
    (None, {"text": "", "used": [], "unknown": [], "warnings": []}), ("", {"text": "", "removed": []}), ("  \n", {"text": ""}),
]


def test_answers_against_their_sources(spark, names, statutes):
    a = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "k int, a string")
    kinds = "k int, sid int, " + ", ".join(f"{c} string" for c in S1) + ", numbers string, n int, piece string"
    src = spark.createDataFrame([(i, sid, *s.values(), "x", 1, "y") for i in range(len(CASES)) for sid, s in enumerate((S1, S2, S3), 1)], kinds)
    done = citations.validate(a, src, "k", "a", names)
    got = {r.k: r for r in citations.warnings(done, citations.repealed(done, src, statutes, "k")).collect()}
    assert len(got) == len(CASES)
    bad = [(t, {c: getattr(got[i], c) for c in want}) for i, (t, want) in enumerate(CASES) if {c: getattr(got[i], c) for c in want} != want]
    assert not bad


def test_answers_without_sources(spark, names):
    a = spark.createDataFrame([(1, "It holds [S3]. “A quotation of some length” stands. Section 3 too.")], "k bigint, a string")
    src = spark.createDataFrame([], "k bigint, sid int, text string")
    for n in (names, None):
        r = citations.warnings(citations.validate(a, src, "k", "a", n)).first()
        assert r.text == "It holds." and r.warnings[0] == "Removed 1 citation(s) to sources that were not provided: S3." and r.authorities == ["section 3"] and len(r.removed) == 2
    assert citations.validate(a.limit(0), src, "k", "a").count() == 0
