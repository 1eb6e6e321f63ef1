"""Compare registered queries with their SQL on DuckDB. As a script: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    """Strict value form: type name and repr, so 1 and 1.0 differ."""
    if value is None:
        return ("null", "")
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    return (type(value).__name__, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, run, sql: str, con=None) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    con = con or oracle_connection(sf_dir)
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    if not ours:
        return "no rows"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        cols = sorted(names)
        a, b = different[0]
        cells = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"{len(different)} of {len(ours)} rows differ, first: {cells[:4]} in {a[:3]}"
    return None


def integer_widths(spark, sf_dir: str, run, sql: str, con) -> list[str]:
    """Integer columns whose width differs between the engines."""
    widths = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}
    have = {n: widths.get(t, t) for n, t in run(spark, sf_dir).dtypes}
    cursor = con.execute(f"DESCRIBE {sql}")
    want = {r[0]: r[1] for r in cursor.fetchall()}
    return [f"{c}: {have[c]} vs {want.get(c)}" for c in have if have[c] != want.get(c)]


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from hourloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    runs, checks = queries(), oracle_sql()
    names = [n for n in runs if not args or any(n == a or n.startswith(a + "*") or a in n for a in args)]
    spark = local_session()
    con = oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in checks:
                problem = compare(spark, sf_dir, runs[name], checks[name], con)
                took = time.time() - start
                types = integer_widths(spark, sf_dir, runs[name], checks[name], con)
                if types:
                    problem = f"{problem or 'values equal'}; types {types}"
            else:
                n = len(runs[name](spark, sf_dir).collect())
                took = time.time() - start
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            took = time.time() - start
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {took:6.2f}s {'' if name in checks else '(rows)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
