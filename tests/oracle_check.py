"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import pathlib
import sys
import time
from typing import Any

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def normal(value: Any) -> Any:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in data)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    there = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    here = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    odd = [f"{n}: {t} / {there.get(n)}" for n, t in here.items() if there.get(n) != t]
    return f"types: {', '.join(odd)}" if odd else ""


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; only here {sorted(set(got) - set(want))[:2]}, only there {sorted(set(want) - set(got))[:2]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} rows differ: {wrong[0]}" if wrong else None


def main() -> None:
    import __spark_entry__ as registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = registered.oracle_sql()
    failed = []
    for name, run in registered.queries().items():
        if wanted and name not in wanted:
            continue
        begin, types = time.time(), ""
        try:
            result = run(spark, sf_dir)
            problem = differences(result, connection, sql[name]) if name in sql else "no SQL"
            types = type_differences(result, connection, sql[name]) if name in sql else ""
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {time.time() - begin:6.2f}s {problem or ''} {types}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
