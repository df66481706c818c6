"""Helpers of the Arrow operators: bounded blocks of rows, words as codes, gathered runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is one ideograph or a longest run of other characters without blank, tab, CR or LF.
WORD = "[一-鿿]|[^ \t\r\n一-鿿]+"
words_of = re.compile(WORD).findall
#: Characters handled at once by one worker; it bounds memory only.
BLOCK = 2_000_000


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def codes_of(words: list[str]) -> np.ndarray:
    return pd.factorize(np.array(words, object))[0].astype(np.uint64) if words else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that equal inputs and only those stay equal."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def types_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def mapped(df: DataFrame, keep: list[str], text: str, added: str, fn: Callable[[list[str | None]], list[pa.Array] | tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """df's columns `keep` with those of the schema `added` that fn makes of blocks of texts.

    fn returns one array per added column, of one value per text, or (row numbers, arrays) when rows multiply or go.
    """
    names = [*keep, *[x.strip().split()[0].strip("`") for x in added.split(", ")]]
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(k).to_pylist()
            for i, j in blocks(texts):
                part, made = b.slice(i, j - i), fn(texts[i:j])
                rows, made = made if isinstance(made, tuple) else (None, made)
                kept = [part.column(c) if rows is None else part.column(c).take(pa.array(rows)) for c in range(k)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names)

    schema = ", ".join(x for x in (types_of(df, keep), added) if x)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(run, schema)
