"""Vectors held as arrays of floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalised(a: Column | str) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(col(a), lambda x: x.cast("double") / n)


def hash_embedder(dimensions: int = 64):
    """A stand-in for an encoder: unit vectors from a hash of the text; equal texts get equal vectors."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(t: str | None) -> list[float]:
            raw = np.frombuffer(b"".join(hashlib.sha512(f"{i}:{t or ''}".encode()).digest() for i in range((dimensions + 63) // 64)), np.uint8)
            v = raw[:dimensions].astype(np.float32) - 127.5
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return encode
