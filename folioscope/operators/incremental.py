"""Problem 1: processing only what is new or changed.

Records are spread over partitions by the hash of their key; their number is a power of two that follows the size of the
inputs, so that a partition holds about LEAF_ROWS rows of them at any size, and a delta remakes the partitions it touches and no more. A partition's fingerprint is its number of
rows and the sum of the rows' hashes, of every input; being additive, it is one partial aggregation over the inputs, and
doesn't depend on the order of rows. A run compares the fingerprints with those stored beside the results, recomputes only
the partitions that differ, and puts each in the place of the old one by dynamic partition overwrite.

The results carry the fingerprint they were made from, in the same files. A run that fails before its commit leaves the
old partitions with the old fingerprints, so the next run makes the same ones again; one that fails after it finds them
current. No partition is left out or done twice, whenever a run ends.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = 64
#: Rows of the inputs that a partition holds, about 256 MB of the columns that are read.
LEAF_ROWS = 1_000_000
#: Result rows that one task writes.
WRITTEN = 500_000


def leaves(rows: int, held: int | None = None, least: int = PARTITIONS, leaf: int | None = None) -> int:
    """Partitions for inputs of so many rows. A held number stays while partitions have between a quarter and twice what they should."""
    leaf = leaf or LEAF_ROWS
    if held and (rows <= 2 * held * leaf and (4 * rows >= held * leaf or held == least)):
        return held
    n = least
    while n * leaf < rows:
        n *= 2
    return n


def partition_of(key: Column, partitions: int = PARTITIONS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of all columns; nulls count, so that a value moved to another column changes it."""
    parts = [F.coalesce(F.to_json(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    return F.xxhash64(F.lit(seed), *parts)


def fingerprints(inputs: list[tuple[DataFrame, Column]], partitions: int = PARTITIONS, salt: str = "") -> DataFrame:
    """(part, fingerprint string) of all inputs, given with the column that says a row's partition."""
    one = None
    for i, (df, part) in enumerate(inputs):
        # two independent sums of 64-bit hashes, held as decimals so that they can't overflow
        rows = df.select(part.alias("part"), *[(F.lit(i).alias("input"))], row_hash(df, i).alias("h"), row_hash(df, i + 101).alias("g"))
        one = rows if one is None else one.unionByName(rows)
    by = one.groupBy("part", "input").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    each = F.concat_ws(":", "input", "n", F.col("h").cast("string"), F.col("g").cast("string"))
    return by.groupBy("part").agg(F.concat(F.lit(salt + "|"), F.array_join(F.array_sort(F.collect_list(each)), ",")).alias("fingerprint"))  # one per input


class PartitionedState:
    """Results by partition in a folder all executors share, with the fingerprint each was made from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.path = spark, path, path
        if held := self.held():
            self.path = f"{path}/leaves={held}"

    def _names(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def held(self) -> int | None:
        """The number of partitions that the stored results have: of the layout that was completed last."""
        done = [n for n in self._names(self.root) if n.startswith("leaves=") and "_COMPLETE" in self._names(f"{self.root}/{n}")]
        fs, _ = self._file("")
        last = max(done, key=lambda n: fs.getFileStatus(self._file(f"{n}/_COMPLETE")[1]).getModificationTime(), default=None)
        return last and int(last.removeprefix("leaves="))

    def _file(self, name: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def complete(self, partitions: int) -> None:
        """Marks a layout as the one that holds; layouts left before the last change go."""
        before = self.held()
        if before == partitions:
            for n in self._names(self.root):
                if n.startswith("leaves=") and n != f"leaves={partitions}":
                    fs, p = self._file(n)
                    fs.delete(p, True)
            return
        fs, p = self._file(f"leaves={partitions}/_COMPLETE")
        fs.create(p, True).close()

    def laid_out(self, partitions: int) -> PartitionedState:
        """The state in so many partitions; another number than is held is made from nothing, beside what is held."""
        out = PartitionedState(self.spark, self.root)
        out.path = f"{self.root}/leaves={partitions}"
        return out

    def _exists(self) -> bool:
        return any(n.startswith("part=") for n in self._names(self.path))

    def read(self, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("marker", T.BooleanType()), T.StructField("part", T.IntegerType())])
        if not self._exists():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def run(self, now: DataFrame, schema: T.StructType, compute: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Brings the state up to the fingerprints `now`; compute gets (part) of the partitions to make. Returns these."""
        old = self.read(schema).where("marker").select("part", F.col("fingerprint").alias("old"))
        both = now.join(old, "part", "full_outer").where(F.coalesce("fingerprint", F.lit("")) != F.coalesce("old", F.lit("")))
        todo = both.select("part", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
        parts = sorted((r["part"], r["fingerprint"]) for r in todo.collect())  # at most one row a partition
        if not parts:
            return []
        due = self.spark.createDataFrame(parts, "part int, fingerprint string")
        made = compute(due.select("part")).join(F.broadcast(due), "part").withColumn("marker", F.lit(False))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        marks = due.select(*empty, "fingerprint", F.lit(True).alias("marker"), "part")  # also replaces partitions without results
        out = made.select(*marks.columns).unionByName(marks)
        # a partition is written by as many tasks as it has rows for; without many rows, by one
        tasks = max(1, -(-made.count() // WRITTEN // len(parts))) if len(parts) < 64 else 1
        way = [F.col("part")] if tasks == 1 else [F.col("part"), F.pmod(F.xxhash64(*schema.names), F.lit(tasks))]
        out.repartition(*way).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        return [p for p, _ in parts]

    def results(self, schema: T.StructType) -> DataFrame:
        return self.read(schema).where("not marker").drop("marker", "fingerprint")


def digest(c: Column) -> Column:
    """A sha256 spelled evenly: without prefix, blanks and separators, lower case; empty counts as none."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^sha-?256\s*[:=\-]?\s*|[\s:\-]", "")
    return F.when(bare != "", bare)


def current_versions(parser_versions: DataFrame) -> DataFrame:
    """(doc_type, current): the version released last; of equal times the greater name."""
    last = F.max_by("parser_version", F.struct("released_at", "parser_version")).alias("current")
    return parser_versions.where(F.col("released_at").isNotNull()).groupBy("doc_type").agg(last)


OUT = T.StructType([T.StructField("source_url", T.StringType()), T.StructField("reason", T.StringType())])


def due_documents(manifest: DataFrame, documents: DataFrame, parser_versions: DataFrame, versions_bound: int = 10_000) -> DataFrame:
    """(source_url, reason) of the documents that are new, changed or not validly indexed.

    The newest ledger row is that of the greatest seq among rows with a sha256; late and repeated rows change nothing. Of
    several documents of one url, one that is in order is enough. Null and empty urls are no records.
    """
    m = manifest.where(F.col("url").isNotNull() & digest(F.col("sha256")).isNotNull())
    newest = m.groupBy(F.col("url").alias("source_url")).agg(F.max_by(digest(F.col("sha256")), F.struct("seq", digest(F.col("sha256")))).alias("sha"))
    versions = current_versions(parser_versions)
    small = versions.limit(versions_bound + 1).count() <= versions_bound
    d = documents.where(F.col("source_url").isNotNull()).select("source_url", digest(F.col("raw_sha256")).alias("raw"), "doc_type", "parser_version", "indexed_at")
    d = d.join(F.broadcast(versions) if small else versions, "doc_type", "left")
    stale = F.col("parser_version").isNull() | ~F.col("parser_version").eqNullSafe(F.col("current"))
    # 0 in order, else the reason
    both = newest.join(d.select("source_url", "raw", stale.alias("stale"), F.col("indexed_at").isNull().alias("unindexed"), F.lit(True).alias("known")), "source_url", "left")
    state = F.when(F.col("known").isNull(), 1).when(~F.col("raw").eqNullSafe(F.col("sha")), 2).when(F.col("stale"), 3).when(F.col("unindexed"), 4).otherwise(0)
    worst = both.groupBy("source_url").agg(F.min(state).alias("state")).where("state > 0")
    names = F.array(*[F.lit(x) for x in ("new", "changed", "parser", "not indexed")])
    return worst.select("source_url", F.element_at(names, F.col("state")).alias("reason"))


def rules() -> str:
    """A hash of the code that decides what is due, so that results made by other code are made again."""
    code = "".join(inspect.getsource(f) for f in (digest, current_versions, due_documents, partition_of, row_hash))
    return hashlib.sha256(code.encode()).hexdigest()[:16]


RULES = rules()


def indexing_run(state: PartitionedState, manifest: DataFrame, documents: DataFrame, parser_versions: DataFrame, partitions: int | None = None) -> list[int]:
    """Names what is due in the partitions whose ledger rows, documents or parser versions changed; returns these.

    `state` then stands for the new results. The number of partitions follows the rows of both tables, unless it is given.
    """
    if partitions is None:
        partitions = leaves(manifest.count() + documents.count(), state.held())
    now_state = state.laid_out(partitions)
    m = manifest.select("url", "seq", "sha256")
    d = documents.select("source_url", "raw_sha256", "doc_type", "parser_version", "indexed_at")
    m_part, d_part = partition_of(F.col("url"), partitions), partition_of(F.col("source_url"), partitions)
    v = current_versions(parser_versions)
    salt = v.agg(F.coalesce(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "doc_type", "current"))), ",")), F.lit(""))).first()[0]  # one row a type
    now = fingerprints([(m, m_part), (d, d_part)], partitions, f"{RULES}/{partitions}/{salt}")

    def compute(parts: DataFrame) -> DataFrame:
        todo = F.broadcast(parts)  # at most one row a partition
        some_m = m.withColumn("part", m_part).join(todo, "part", "left_semi")
        some_d = d.withColumn("part", d_part).join(todo, "part", "left_semi")
        return due_documents(some_m, some_d, parser_versions).withColumn("part", partition_of(F.col("source_url"), partitions))

    made = now_state.run(now, OUT, compute)
    state.complete(partitions)
    state.path = now_state.path
    return made
