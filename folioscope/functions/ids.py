"""Identities: hashes that name documents, chunks, corpora and cached answers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import slug


def document_id(canonical_url: Column) -> Column:
    return F.sha2(canonical_url, 256)


def chunk_id(doc: Column, locator: Column, text: Column) -> Column:
    return F.concat_ws(":", F.left(doc, F.lit(12)), slug(locator), F.left(F.sha1(text), F.lit(8)))


def cache_key(question: Column, **version: Column) -> Column:
    """sha256 of the question and version fields in the order of their names."""
    parts = F.struct(F.lower(F.trim(question)).alias("q"), *[c.alias(k) for k, c in sorted(version.items())])
    return F.sha2(F.to_json(parts), 256)


def question_key(question: Column, **version: Column) -> Column:
    """`cache_key` of the question in NFC, case-folded and with single blanks, so that spellings share an answer."""
    from folioscope.functions.unicode import folded_case

    return cache_key(folded_case(question), **version)


def corpus_digest(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row (n_chunks, corpus_hash): sha256 of the ids one after the other, in order.

    Such a hash can only be taken in one stream: the ids alone are sorted in one task, which spills, and read once. `corpus_hash`
    is the scheme for corpora where that is too slow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.sha256(), 0
        for b in batches:
            said = b.column(0).to_pylist()
            h.update("".join(said).encode())
            n += len(said)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h.hexdigest()])], ["n_chunks", "corpus_hash"])

    one = chunks.where(F.col(key).isNotNull()).select(key).repartition(1).sortWithinPartitions(key)
    return one.mapInArrow(run, "n_chunks bigint, corpus_hash string")


def corpus_hash(chunks: DataFrame, key: str = "chunk_id", parts: int = 4096) -> DataFrame:
    """One row: sha256 over the ids in order, by way of one sha256 per leading-bits range, so that no task holds all ids."""
    ranged = chunks.select(F.col(key).alias("k"), F.conv(F.left(F.sha1(F.col(key)), F.lit(3)), 16, 10).cast("int").alias("p")).where("k is not null")
    each = ranged.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("k")), ""), 256).alias("h"), F.count("*").alias("n"))  # 4096 ranges share the ids evenly
    return each.agg(F.sum("n").alias("n_chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_hash"))
