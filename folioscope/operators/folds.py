"""Folds over the ordered rows of one document, without a Python group for each."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def folded(df: DataFrame, by: list[str], order: list[str], columns: list[str], fn: Callable[[tuple, list], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that fn(key, rows in order) gives for each document; rows are named tuples of `order` and `columns`.

    The JVM gathers the rows of a document in one array; a document is what the logic needs whole. Python gets batches of
    documents, not a group at a time.
    """
    names = [*order, *[c for c in columns if c not in order]]
    rows = F.array_sort(F.collect_list(F.struct(*names)))
    made = df.groupBy(*by).agg(rows.alias("_rows"))
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = namedtuple("item", [re.sub(r"^_", "x_", n) for n in names])  # noqa: PYI024
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(len(by))], strict=True))
            got: list[tuple] = []
            for key, own in zip(keys, b.column(len(by)).to_pylist(), strict=True):
                got += fn(key, [item(*[r[n] for n in names]) for r in own])
            cols = list(zip(*got, strict=True)) if got else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return made.mapInArrow(run, schema)
