"""Writers: ledgers, rejected records, audit rows, reports, and tables replaced as a whole."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rejects(rejected: DataFrame, run_id: str, path: str) -> None:
    """(run_id, doc_id, locator, problems) of refused records."""
    append(rejected.select(F.lit(run_id).alias("run_id"), "doc_id", "locator", "problems"), path)


def audit(spark: SparkSession, run_id: str, counters: dict[str, int], path: str, started: datetime, finished: datetime | None, notes: dict | None = None) -> None:
    row = spark.createDataFrame([(run_id, started, finished, json.dumps(notes or {}, sort_keys=True), *counters.values())], "run_id string, started_at timestamp, finished_at timestamp, notes string, " + ", ".join(f"{k} bigint" for k in counters))
    append(row, path)


def swapped(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replaces the partitions that df has rows of, each at the commit of the job; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is a small aggregate")
    say = lambda v: "—" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(say(v) for v in r) + " |" for r in rows)]) + "\n"


class JsonLog(logging.Formatter):
    """One JSON object a line; questions are logged by hash only."""

    def format(self, record: logging.LogRecord) -> str:
        import hashlib

        said = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "level": record.levelname, "message": record.getMessage()}
        if (q := getattr(record, "question", None)) is not None:
            said["question"] = hashlib.sha256(q.encode()).hexdigest()[:16]
        return json.dumps(said, ensure_ascii=False, sort_keys=True)
