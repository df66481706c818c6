import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import tokens

codec = tokens.codec(tokens.vocabulary())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(tokens.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_the_library(text):
    import tiktoken

    ranks = codec.ranks
    own = test_same_ids_as_the_library.__dict__.setdefault("e", tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    text = text.encode("utf-8", "ignore").decode()
    assert codec.encode(text) == own.encode_ordinary(text)


def test_long_words_and_backtracking(reference):
    random.seed(5)
    for alphabet in ("ab", "aeiorst", "0123", " \t\n", "।हिन्दी"):
        for n in (1, 50, 3000):
            text = "".join(random.choice(alphabet) for _ in range(n))
            assert codec.encode(text) == reference.encode_ordinary(text)
    assert codec.encode("<|endoftext|>") == reference.encode_ordinary("<|endoftext|>")


def test_round_trip_and_defined_cases(spark):
    rows = [(1, "The mortgage’s 中文 हिन्दी"), (2, ""), (3, None), (3, None), (4, "x" * 200_000), (5, "  \n\n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "doc_id AS ids_", "1 AS n_tokens")
    got = sorted((r.doc_id, r.ids) for r in tokens.with_ids(df, "doc_id").collect())
    assert got == sorted((k, codec.encode(t)) for k, t in rows) and got[1][1] == [] and got[2][1] == []
    back = {r.doc_id: r.text for r in tokens.decoded(tokens.with_ids(df, "doc_id"), "doc_id").collect()}
    assert back == {k: t or "" for k, t in rows}
    counted = tokens.with_counts(df, "text").collect()
    assert sorted(r.n_tokens for r in counted) == sorted(len(codec.encode(t)) for _, t in rows)
    assert tokens.with_ids(df.limit(0), "doc_id").count() == 0
    assert codec.decode(np.array([], int)) == b""
