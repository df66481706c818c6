"""Upkeep of search indexes: postings and vectors of what changed only, what an index was made from, whether it is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import ids
from folioscope.operators import search, store


def postings_after(stored: DataFrame, fresh: DataFrame, changed: DataFrame, key: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings (key, doc, len, term, tf) after the documents `changed` (doc) got the texts of `fresh` (key, doc, text).

    Postings of other documents are kept as they are; a document without fresh texts goes.
    """
    made = search.postings(fresh, key, text).join(fresh.select(key, doc).distinct(), key)
    return stored.join(changed.select(doc).distinct(), doc, "left_anti").select(*stored.columns).unionByName(made.select(*stored.columns))


def vectors_after(stored: DataFrame, want: DataFrame, key: str, stamp: str, encode: Callable[[str], object], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors (key, stamp, embedding), states (key, state)) of an index brought up to `want` (key, stamp, text).

    Only texts without a vector, or whose vector was made from another text, are encoded; vectors of keys that aren't wanted go.
    """
    states = store.three_way(want, stored, key, stamp)
    kept = stored.join(states.where("state = 'current'").select(key), key, "left_semi").select(key, stamp, "embedding")
    made = want.join(states.where("state in ('missing', 'stale')").select(key), key, "left_semi").select(key, stamp, encode(text).alias("embedding"))
    return kept.unionByName(made), states


def described(vectors: DataFrame, chunks: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """One row (model, dimensions, n_vectors, n_chunks, corpus_hash): what an index was made from and with."""
    v = vectors.agg(F.max(F.size("embedding")).alias("dimensions"), F.count("*").alias("n_vectors"))
    return ids.corpus_digest(chunks, key).crossJoin(v).select(F.lit(model).alias("model"), "dimensions", "n_vectors", "n_chunks", "corpus_hash")  # one row each


def health(vectors: DataFrame, chunks: DataFrame, description: DataFrame, model: str, key: str = "chunk_id") -> DataFrame:
    """(check, ok): whether the index is there, of this model and one dimension, and has a vector for each chunk and no others."""
    d = description.select(F.col("model").alias("m"), F.col("dimensions").alias("k"), F.col("n_vectors").alias("n")).limit(1)
    v = vectors.agg(F.count("*").alias("have"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    gaps = store.three_way(chunks.select(key, F.lit(1).alias("s")).distinct(), vectors.select(key, F.lit(1).alias("s")), key, "s").agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "orphan").alias("orphan"))
    one = v.crossJoin(gaps).join(d, F.lit(True), "left")  # single rows
    checks = {"described": F.col("m").isNotNull(), "model": F.col("m") == model, "dimensions": (F.col("lo") == F.col("k")) & (F.col("hi") == F.col("k")), "count": F.col("have") == F.col("n"), "none missing": F.col("missing") == 0, "none too many": F.col("orphan") == 0}
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])).alias("x")).select("x.*")
