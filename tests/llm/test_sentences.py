import pytest

from folioscope.llm import sentences

CASES = [
    ("The clerk sold it. Dr. A. K. Rao bought No. 5 for Rs. 3,000.50 at 4.5 per cent. per annum. It ended.", ["The clerk sold it.", "Dr. A. K. Rao bought No. 5 for Rs. 3,000.50 at 4.5 per cent. per annum.", "It ended."]),
    ("12. The deed said, “It is void. It was signed.” The next rose.", ["12. The deed said, “It is void. It was signed.”", "The next rose."]),
    ("“Was it served?” the officer asked. No.", ["“Was it served?” the officer asked.", "No."]),
    ("It holds [S1]. As to costs, none. [S2][S3] See s. 4(2) of X v. Y and records.example.org/deed/8.pdf. End", ["It holds [S1].", "As to costs, none. [S2][S3]", "See s. 4(2) of X v. Y and records.example.org/deed/8.pdf.", "End"]),
    ("26. Codicil of allotment.—\n(1) The rule; thus: it goes … on.\n\n- bullet one!", ["26. Codicil of allotment.—", "(1) The rule; thus: it goes … on.", "- bullet one!"]),
    ("यह सं. 4 है। वह डॉ. को दिया “एक। दो।”, ऐसा कहकर गया। अंत।", ["यह सं. 4 है।", "वह डॉ. को दिया “एक। दो।”, ऐसा कहकर गया।", "अंत।"]),
    ("法院驳回。“文书。利息。”等语已经维持？提出23.5。", ["法院驳回。", "“文书。利息。”等语已经维持？", "提出23.5。"]),
    ("اپیل درست۔ ”غلط۔ حد۔“ کہہ کر گیا؟ ختم۔", ["اپیل درست۔", "”غلط۔ حد۔“ کہہ کر گیا؟", "ختم۔"]),
    ("பிரிவு எண். 4 ரூ. 5 திரு. நெவர் பதிவு. அடுத்த வரி.", ["பிரிவு எண். 4 ரூ. 5 திரு. நெவர் பதிவு.", "அடுத்த வரி."]),
    ("Le bail art. 5 selon p. ex. le droit. La vente 3,50 fr. le soir! Fin", ["Le bail art. 5 selon p. ex. le droit.", "La vente 3,50 fr. le soir!", "Fin"]),
    ("He met Ltd. men at 5 a.m. (1) Then left.The end", ["He met Ltd. men at 5 a.m.", "(1) Then left.", "The end"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    got = sentences.sentences(text)
    assert [text[a:b] for a, b in got] == want


def test_spans_cover_all_but_blanks_and_defined_cases(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(50, None), (51, ""), (52, " \n\t "), (53, "word " * 100_000), (54, "no stop"), (54, "no stop")]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 AS start_at", "2 AS end_at")
    got = {}
    for r in sentences.split(df, ["id"]).collect():
        got.setdefault(r.id, []).append((r.start_at, r.end_at))
    texts = dict(rows)
    assert not {50, 51, 52} & set(got) and len(got[54]) == 2
    for k, spans in got.items():
        if k != 54:
            spans.sort()
            assert "".join(texts[k].split()) == "".join("".join(texts[k][a:b].split()) for a, b in spans)
            assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert sentences.split(df.limit(0), ["id"]).count() == 0


def test_languages_of_one_script_have_their_own_tables():
    assert sentences.table_of("Le juge a dit dans la salle que le contrat est nul devant les parties.") == "fr"
    assert sentences.table_of("O juiz disse perante os autores que o contrato foi nulo segundo o acordo.") == "pt"
    assert sentences.table_of("यह अधिकारी ने नगर में कहा और निर्णय मान्य है।") == "hi" and sentences.table_of("न्यायालयाच्या निर्णयानुसार जमीन व भाडे मान्य आहे.") == "mr"
    assert sentences.table_of("قانون کے مطابق") == "ur" and sentences.table_of("法院认为合同无效。") == "zh" and sentences.table_of("The court.") == "en"


def test_far_context_and_many_citation_marks():
    marks = " [S1]" * 60
    t = f"The deed was read.{marks} The next one stands. " + "a" * 500 + " 5. b goes on."
    assert [t[a:b] for a, b in sentences.sentences(t)][:2] == [f"The deed was read.{marks}", "The next one stands."]
