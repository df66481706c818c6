"""Unicode functions that the JVM side has no built-in for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import col


def nfc(c: Column | str) -> Column:
    """NFC form; ASCII texts don't go to Python's tables."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(col(c))


def folded_case(c: Column | str) -> Column:
    """NFC, full case folding, single blanks: the form in which questions are looked up in a cache."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))

    return run(col(c))
