"""Run registered queries against their SQL in DuckDB.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from __spark_entry__ import oracle_sql, queries
from wirepulse.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"
}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.monotonic()
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    seconds = time.monotonic() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {seconds:.1f}s"
    started = time.monotonic()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = rows_of(columns, result.fetchall())
    note = f"{len(got)} rows, spark {seconds:.1f}s, duckdb {time.monotonic() - started:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    mine = {c: _KINDS.get(t, t) for c, t in df.dtypes}
    if mine != kinds:
        note += f" TYPES {[(c, mine[c], kinds[c]) for c in mine if mine[c] != kinds[c]]}"
    if got == want:
        return "TYPES" not in note, note
    only_got = [r for r in got if r not in set(want)][:2] if len(got) < 50_000 else []
    only_want = [r for r in want if r not in set(got)][:2] if len(got) < 50_000 else []
    return False, f"{note}; {len(want)} wanted\n   {sorted(columns)}\n   spark only {only_got}\n   sql only {only_want}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in args.names or queries():
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(bad, "failed")


if __name__ == "__main__":
    main()
