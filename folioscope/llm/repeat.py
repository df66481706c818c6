"""Problem 10: repetition inside a single document.

A word is repeated if it lies in a run of `run` words that equals a run starting earlier in the same text. The share is
exact: it follows from the words themselves, which a likelihood ratio can't give. `likelihood` is the method named for
the problem, a second measure over the same runs: hashed n-grams, each with whether it came before in its document, under
two multinomials, one of the trusted documents (those without any repeated run) and one of the whole corpus; the
log-likelihood ratio by n-gram is held against a fixed threshold.

Defined results: null, empty and short texts have no repeated word (share 0); letters are lower-cased; repeated rows
and ties each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import blocks, codes_of, mapped, mixed, words_of

RUN, SHARE, LEAST = 5, 0.3, 20
#: Buckets of the hashed n-grams; a fixed bound on what the multinomials hold.
BUCKETS = 1 << 15
#: Below this mean log-likelihood ratio a document counts as repetitive.
THRESHOLD = -0.05


def _runs(texts: list[str | None], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: words by document, first word of each document, starts of runs, their hashes, whether one came before."""
    words, counts = [], []
    for t in texts:
        w = words_of(t.lower()) if t else []
        words += w
        counts.append(len(w))
    n = np.array(counts, np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    codes, doc = codes_of(words), np.repeat(np.arange(len(n), dtype=np.uint64), n)
    total = len(codes)
    if total < run:
        return n, first, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = mixed(doc[: total - run + 1] + np.uint64(1))
    for k in range(run):
        h = mixed(h + codes[k : total - run + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    starts = np.nonzero(doc[: total - run + 1] == doc[run - 1 :])[0]
    h = h[starts]
    return n, first, starts, h, pd.Series(h).duplicated().to_numpy()


def repetition(df: DataFrame, key: str, text: str = "text", run: int = RUN) -> DataFrame:
    """(key, n_words, n_repeated, share) of each row."""

    def measure(texts: list[str | None]) -> list[pa.Array]:
        n, first, starts, _, again = _runs(texts, run)
        edge = np.zeros(first[-1] + 1, np.int64)
        at = starts[again]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + run, -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
        r = inside[first[1:]] - inside[first[:-1]]
        return [pa.array(n), pa.array(r), pa.array(np.where(n > 0, r / np.maximum(n, 1), 0.0))]

    return mapped(df, [key], text, "n_words bigint, n_repeated bigint, share double", measure)


def repetitive(df: DataFrame, key: str, text: str = "text", run: int = RUN, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Rows of `repetition` with at least `least` words of which at least `share` are repeated (compared in whole words)."""
    d = repetition(df, key, text, run)
    return d.where((F.col("n_words") >= least) & (F.col("n_repeated") >= F.col("n_words") * F.lit(share) - 1e-9))


def _cells(texts: list[str | None], run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: where each document's runs begin and end, the cell of each run, whether one came before in its document.

    The cell is a hash of the run's words, the same everywhere, in the first or second half of the cells.
    """
    _, first, starts, _, again = _runs(texts, run)
    codes, uniques = pd.factorize(np.array([w for t in texts if t for w in words_of(t.lower())], object)) if first[-1] else (np.zeros(0, np.int64), np.zeros(0, object))
    stable = pd.util.hash_array(np.array(list(uniques), object), categorize=False).astype(np.uint64)
    h = np.zeros(len(starts), np.uint64)
    for k in range(run):
        h = mixed(h * np.uint64(31) + stable[codes[starts + k]])
    return np.searchsorted(starts, first), (h % np.uint64(buckets)).astype(np.int64) + np.where(again, buckets, 0), again


def likelihood(df: DataFrame, key: str, text: str = "text", run: int = RUN, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_grams, llr, repetitive): mean log-likelihood ratio of the hashed runs, trusted against raw.

    A document without runs has llr 0 and isn't repetitive. Counts go over all documents: each batch sums its own, so that
    no more than 2 * buckets rows leave it, and the model has 2 * buckets weights.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in blocks(texts):
                ends, cell, again = _cells(texts[i:j], run, buckets)
                dirty = np.repeat([again[x:y].any() for x, y in zip(ends[:-1], ends[1:], strict=True)], np.diff(ends)) if len(cell) else np.zeros(0, bool)
                raw += np.bincount(cell, minlength=2 * buckets)
                trusted += np.bincount(cell[~dirty], minlength=2 * buckets)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["cell", "raw", "trusted"])

    parts = df.select(F.col(text)).mapInArrow(count, "cell bigint, raw bigint, trusted bigint")
    model = parts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect()  # at most 2 * buckets
    raw, trusted = np.zeros(2 * buckets), np.zeros(2 * buckets)
    for r in model:
        raw[r["cell"]], trusted[r["cell"]] = r["raw"], r["trusted"]
    weight = np.log((trusted + 1) / (trusted.sum() + 2 * buckets)) - np.log((raw + 1) / (raw.sum() + 2 * buckets))
    shared = df.sparkSession.sparkContext.broadcast(weight)  # 2 * buckets numbers

    def score(texts: list[str | None]) -> list[pa.Array]:
        ends, cell, _ = _cells(texts, run, buckets)
        total = np.concatenate(([0.0], np.cumsum(shared.value[cell])))
        n = np.diff(ends)
        llr = np.where(n > 0, (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1), 0.0)
        return [pa.array(n.astype(np.int64)), pa.array(llr), pa.array(llr < threshold)]

    return mapped(df, [key], text, "n_grams bigint, llr double, repetitive boolean", score)
