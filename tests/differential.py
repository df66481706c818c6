"""Runs queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def connection(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf).iterdir()):
        name = p.name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows_of(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, query, sql: str | None) -> str:
    df = query(spark, sf)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    want_names, want = rows_of([x[0] for x in cur.description], cur.fetchall())
    if names != want_names:
        return f"DIFFERS: columns {names}, SQL {want_names}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"DIFFERS: {len(got)} rows, SQL {len(want)}; only here {a}, only in SQL {b}"
    return f"{len(got)} rows equal"


def main(sf: str, only: list[str]) -> int:
    import __spark_entry__ as e

    from folioscope.session import local_session

    spark, con, sql, bad = local_session(), connection(sf), e.oracle_sql(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, q in e.queries().items():
        if only and not any(name == x or x.endswith("*") and name.startswith(x[:-1]) for x in only):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, q, sql.get(name))
        except Exception as x:
            said = f"FAILED: {str(x)[:1500]}"
        bad += said.startswith(("DIFFERS", "FAILED"))
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
