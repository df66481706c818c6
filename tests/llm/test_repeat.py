import random

from folioscope.llm import repeat
from folioscope.llm.blocks import words_of


def brute(text, run=5):
    w = words_of((text or "").lower())
    seen, again = set(), [False] * len(w)
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            again[i : i + run] = [True] * run
        seen.add(g)
    return len(w), sum(again)


def test_against_brute_force(spark):
    random.seed(3)
    texts = [None, "", "   ", "one", "a b c d", "a b c d e", "a a a a a a a", "法院法院法院法院法院法院 ok", "A b C d E a B c D e"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(500, texts[-1]), (500, texts[-1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS share", "0 AS n_words")
    got = sorted((r.doc_id, r.n_words, r.n_repeated) for r in repeat.repetition(df, "doc_id").collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)
    found = {r.doc_id for r in repeat.repetitive(df, "doc_id").collect()}
    assert found == {i for i, t in rows if brute(t)[0] >= 20 and brute(t)[1] / brute(t)[0] >= 0.3}
    assert repeat.repetition(df.limit(0), "doc_id").count() == 0


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(300_000)) + " " + " ".join(str(i) for i in range(100))
    r = repeat.repetition(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id").first()
    assert (r.n_words, r.n_repeated) == (300_100, 100)


def test_likelihood_tells_repetition_from_clean_text(spark):
    random.seed(1)
    words = [f"w{i}" for i in range(200)]
    clean = [(i, " ".join(random.choice(words) for _ in range(80))) for i in range(60)]
    spam = [(100 + i, " ".join([" ".join(random.choice(words) for _ in range(8))] * 10)) for i in range(10)]
    got = {r.doc_id: r.repetitive for r in repeat.likelihood(spark.createDataFrame([*clean, *spam, (900, None), (901, "")], "doc_id bigint, text string"), "doc_id").collect()}
    assert all(got[i] for i, _ in spam) and not any(got[i] for i, _ in clean) and not got[900] and not got[901] and len(got) == 72
