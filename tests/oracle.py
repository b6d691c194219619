"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

FAMILIES = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "integer": "integer",
    "hugeint": "hugeint", "float": "float", "double": "double", "string": "text", "varchar": "text",
    "boolean": "boolean",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both sides agree in columns, type families and all values."""
    names = sorted(spark_df.columns)
    result = connection.sql(sql)
    if names != sorted(result.columns):
        return f"columns {names} against {sorted(result.columns)}"
    left_types = {f.name: FAMILIES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    right_types = {c: FAMILIES.get(str(t).lower(), str(t).lower()) for c, t in zip(result.columns, result.types)}
    wrong = {c: (left_types[c], right_types[c]) for c in names if left_types[c] != right_types[c]}
    if wrong:
        return f"types {wrong}"
    left = _sorted([tuple(row[c] for c in names) for row in spark_df.collect()])
    places = [result.columns.index(c) for c in names]
    right = _sorted([tuple(row[i] for i in places) for row in result.fetchall()])
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[:2]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from tablewright.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if sys.argv[2:] and not any(name.startswith(wanted) for wanted in sys.argv[2:]):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            verdict = difference(df, connection, sql[name]) if name in sql else f"{df.count()} rows, no SQL"
            verdict = "ok" if verdict is None else verdict
        except Exception as error:  # one broken query must not hide the others
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        good = verdict == "ok" or verdict.endswith("no SQL")
        failed += not good
        print(f"{'  ' if good else '! '}{name} {time.time() - start:.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
