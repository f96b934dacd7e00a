"""Compare the registered queries with their SQL in DuckDB, on the tables of one folder."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark, connection, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    found = [tuple(row) for row in df.collect()]
    relation = connection.sql(sql)
    wanted = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows against {len(wanted)}"
    a, b = _sorted(found, df.columns), _sorted(wanted, relation.columns)
    for left, right in zip(a, b):
        for x, y in zip(left, right):
            same = x == y and isinstance(x, bool) == isinstance(y, bool)
            numbers = isinstance(x, float) and isinstance(y, float)
            if not same and not (numbers and math.isclose(x, y, rel_tol=1e-7, abs_tol=2e-6)):
                return f"{left} against {right} ({sorted(df.columns)})"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from conftest import session

    spark = session()
    connection = tables(sf_dir)
    oracles = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                result = differences(spark, connection, name, query, oracles[name], sf_dir) or "ok"
            else:
                result = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"RES {name:28} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT / "tests"))
    main(sys.argv[1], sys.argv[2:])
