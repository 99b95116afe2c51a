"""Compare registered queries with their SQL twins, value by value.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, row count and all values agree; else what differs."""
    columns = sorted(spark_df.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} vs {sorted(relation.columns)}"
    got = sorted(tuple(map(_cell, row)) for row in spark_df.select(*[f"`{c}`" for c in columns]).collect())
    order = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(_cell(row[i]) for i in order) for row in relation.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(columns, a))} vs {dict(zip(columns, b))}"
    return None


def main() -> int:
    from conftest import session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [name for name in queries() if name in oracle_sql()]
    spark, con, failed = session(), connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            found = difference(queries()[name](spark, sf_dir), con, oracle_sql()[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'ok':4} {name:28} {time.time() - started:6.2f}s {found or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
