import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from folioscope.llm import pieces
from folioscope.llm.blocks import words_of


@given(st.integers(1, 80), st.data())
def test_doubling_gives_the_greedy_cuts(n, data):
    limit = data.draw(st.integers(1, 15))
    overlap = data.draw(st.integers(0, limit - 1))
    strong = np.array(sorted(data.draw(st.sets(st.integers(1, n)))), int)
    weak = np.array(sorted(data.draw(st.sets(st.integers(1, n)))), int)
    table = pieces.successors(n, strong, weak, limit, overlap)
    path = [0]
    while path[-1] < n:
        assert table[path[-1]] > path[-1]
        path.append(table[path[-1]])
    assert list(pieces.cuts(n, strong, weak, limit, overlap)) == path


@given(st.lists(st.sampled_from(["word", "end.", "next,", "\n", "法院", "。", "a"]), max_size=120))
def test_pieces_cover_the_text(parts):
    text = " ".join(parts)
    made = pieces.pieces(text, 10, 3)
    words = words_of(text)
    assert all(1 <= n <= 10 and len(words_of(text[a:b])) == n for a, b, n in made)
    if words:
        assert words_of(text[made[0][0] : made[-1][1]]) == words
    for (_, b, _), (c, _, _) in zip(made, made[1:], strict=False):
        assert len(words_of(text[c:b])) == 3
    assert made or not words


def test_cut_at_sentences_and_defined_cases(spark):
    sentence = "The clerk measured the plot in the year. "
    rows = [(1, sentence * 200), (2, None), (3, ""), (4, "short"), (5, "x " * 1000), (5, "x " * 1000), (6, "法" * 1000), (7, "y" * 100_000)]
    df = spark.createDataFrame(rows, "rowid bigint, text string").selectExpr("*", "'s. 1' AS locator", "'z' AS piece_text", "1 AS piece")
    got = pieces.cut_texts(df.drop("piece_text", "piece"), ["rowid", "locator"]).collect()
    assert {r.rowid for r in got} == {1, 5, 6} and all(r.locator == "s. 1" and r.n_words <= 450 for r in got)
    assert all(r.piece_text.endswith(".") for r in got if r.rowid == 1)
    assert len([r for r in got if r.rowid == 5]) == 2 * max(r.n_pieces for r in got if r.rowid == 5)
    assert pieces.cut_texts(df, ["rowid"], all_texts=True).where("rowid = 4").count() == 1
    assert pieces.cut_texts(df.limit(0), ["rowid"]).count() == 0
