"""Problem 4: cutting oversized texts at natural boundaries.

Pointer doubling. The nodes are the word positions of a text. From a cut p the next piece starts `overlap` words before p
and ends at the farthest natural boundary within `limit` words of that start (sentence or line end; else a clause, else any
word). That successor is found for all nodes at once; squaring the successor table k times tells where 2^k cuts lead, and
doubling the list of cuts with these tables gives all greedy cuts in a number of steps logarithmic in the pieces.

Defined results: null, empty and short texts give no piece (with `all_texts` non-empty short texts give one); a piece holds
1 to `limit` words; consecutive pieces share exactly `overlap` words, or all but one word of the earlier piece if that is
shorter; offsets are code points of the original text; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import WORD, mapped
from folioscope.llm.sentences import sentences

LIMIT, OVERLAP = 450, 45
CLAUSE = tuple(",;:،；：，、)）")
WORDS = re.compile(WORD)


def successors(n: int, strong: np.ndarray, weak: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each cut 0..n the next cut; n is its own successor. Boundaries are sorted word positions."""
    p = np.arange(n + 1)
    top = np.minimum(np.where(p == 0, limit, p - np.minimum(overlap, np.maximum(p - 1, 0)) + limit), n)
    nxt = top.copy()
    floor = np.maximum(p, top - limit // 2)  # a natural boundary counts in the later half of what may follow
    for edges in (weak, strong):
        if len(edges):
            k = np.searchsorted(edges, top, "right") - 1
            e = edges[np.maximum(k, 0)]
            nxt = np.where((k >= 0) & (e > floor), e, nxt)
    nxt[top >= n] = n
    return nxt


def cuts(n: int, strong: np.ndarray, weak: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """All greedy cuts from 0 to n, by squaring the successor table."""
    table = successors(n, strong, weak, limit, overlap)
    path = np.zeros(1, np.int64)
    while path[-1] < n:
        path = np.concatenate((path, table[path]))
        table = table[table]
    return path[: np.searchsorted(path, n) + 1]


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece in order."""
    if not text:
        return []
    spans = [m.span() for m in WORDS.finditer(text)]
    n = len(spans)
    if not n:
        return []
    ends = np.array([b for _, b in spans])
    if n <= limit:
        return [(spans[0][0], spans[-1][1], n)]
    strong = np.unique(np.searchsorted(ends, [b for _, b in sentences(text)], "right"))
    weak = np.array([i + 1 for i, (_, b) in enumerate(spans) if text[b - 1] in CLAUSE], np.int64)
    path = cuts(n, strong[strong > 0], weak, limit, overlap)
    out, start = [], 0
    for a, b in zip(path[:-1], path[1:], strict=True):
        start = 0 if a == 0 else max(a - overlap, out[-1][3] + 1)
        out.append((spans[start][0], spans[b - 1][1], b - start, start))
    return [(int(a), int(b), int(c)) for a, b, c, _ in out]


def cut_texts(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, all_texts: bool = False) -> DataFrame:
    """(keys, piece, n_pieces, n_words, start_at, end_at, piece_text) of the texts over `limit` words."""

    def run(texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        rows, k, total, words, starts, ends, parts = [], [], [], [], [], [], []
        for i, t in enumerate(texts):
            made = pieces(t, limit, overlap)
            if len(made) == 1 and not all_texts and made[0][2] <= limit:
                continue
            for j, (a, b, w) in enumerate(made):
                rows.append(i)
                k.append(j + 1)
                total.append(len(made))
                words.append(w)
                starts.append(a)
                ends.append(b)
                parts.append(t[a:b])
        ints = [pa.array(x, pa.int32()) for x in (k, total, words, starts, ends)]
        return np.array(rows, np.int64), [*ints, pa.array(parts, pa.string())]

    if not all_texts:
        # a word has a character at least; ideographs and blanks then tell most of the rest without Python
        t = F.col(text)
        df = df.where((F.length(t) > limit) & (F.regexp_count(t, F.lit(WORD)) > limit))
    return mapped(df, keys, text, "piece int, n_pieces int, n_words int, start_at int, end_at int, piece_text string", run)
