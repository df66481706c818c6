import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import encoding

CLEAN = {
    "en": "The clerk’s “survey” of the Redmoor–Ashby plot … cost £31 and 8½ acres under § 4.",
    "fr": "L'arrêté exécuté le différend « très » où l'enchère à. La succession révoquée, été DÉCLARÉ À LA PREUVE OÙ",
    "pt": "A decisão são até já o litígio AÇÃO DECISÃO PORÇÃO ÂMBITO n.º 5 art. 11.º também",
    "hi": "न्यायालय भूमि निरीक्षण। समझौता",
    "zh": "法院田地“文书。利息。”等语，通知",
    "ur": "دستاویز نوٹس زمین حلف دفعہ۔ رجسٹر سمجھوتہ",
}


def wrong(text, codec):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("lang", CLEAN)
@pytest.mark.parametrize("codec", ["latin-1", "cp1252", "cp1250", "cp1251", "mac_roman"])
def test_one_layer_is_read_again(lang, codec):
    llr, fixed = encoding.evidence(wrong(CLEAN[lang], codec))
    assert llr[1:].max() > 8
    assert CLEAN[lang] in [x for x, y in zip(fixed, llr, strict=True) if y == llr[1:].max()]


def test_two_layers_one_byte_and_lost():
    twice = wrong(wrong(CLEAN["en"], "cp1252"), "cp1252")
    llr, fixed = encoding.evidence(twice)
    assert fixed[int(llr.argmax())] == CLEAN["en"]
    old = "Contra a notificação já é sã".encode("latin-1").decode("cp437")
    llr, fixed = encoding.evidence(old)
    assert fixed[int(llr.argmax())] == "Contra a notificação já é sã"
    for lost in ("cadastr�", "???? ?? ????? ??", "cadastr?e"):
        assert encoding.evidence(lost)[0][-1] > 0


@pytest.mark.parametrize("text", [*CLEAN.values(), "Really? Yes. What??", "a", "", "Ends in sea-\nsonal and pera¬\nnte lití\xad\nio", "ação | pe~ti", "Is it? no"])
def test_clean_text_shows_nothing(text):
    llr, _ = encoding.evidence(text)
    assert llr[1:].max() <= 4 or text == "What??"


def test_weak_evidence_is_pooled_and_repaired(spark):
    random.seed(6)
    rows = [(i, "s1", random.choice([CLEAN["fr"], CLEAN["en"], CLEAN["hi"], None, "", "plain"])) for i in range(300)]
    bad = [(1000 + i, "s2", wrong(CLEAN["en"], "cp1252")) for i in range(20)] + [(1100, "s2", "M. Zel" + wrong("é", "cp1252") + "vaux sold"), (1101, None, wrong(CLEAN["ur"], "cp1250")), (1102, "s1", "x" * 200_000 + "�")]
    df = spark.createDataFrame(rows + bad + bad[:1], "rowid bigint, source string, text string").selectExpr("*", "0 AS n", "1 AS weight", "2 AS llr", "3 AS score")
    got = encoding.repaired(df, "rowid", "text", "source", F.lit("text")).collect()
    assert {r.rowid for r in got} == {b[0] for b in bad}
    fixed = {r.rowid: r.text for r in got}
    assert fixed[1000] == CLEAN["en"] and fixed[1100] == "M. Zelévaux sold" and fixed[1101] == CLEAN["ur"]
    assert encoding.repaired(df.limit(0), "rowid", "text", "source", F.lit("text")).count() == 0
