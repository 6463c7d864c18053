"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """Comparable form of a value; floats must agree exactly."""
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


KINDS = {
    "HUGEINT": "bigint", "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def kind_of(theirs: str) -> str:
    """Spark's name of a type; a list is an array of its element."""
    return f"array<{kind_of(theirs[:-2])}>" if theirs.endswith("[]") else KINDS.get(theirs, theirs)


def compare(con, df, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    left = sorted_rows(df.columns, df.collect())
    relation = con.sql(sql)
    right = sorted_rows(relation.columns, relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    theirs = {c: kind_of(str(t)) for c, t in zip(relation.columns, relation.types)}
    ours = dict(df.dtypes)
    kinds = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"row {a} != {b}"
    if kinds:
        return f"types {kinds}"
    if not left[1]:
        return "empty result"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()

    import __spark_entry__ as entry
    from lakeward.session import local_session, release

    folder = f"/root/testdata/sf{options.sf}"
    spark = local_session(8)
    con = connect(folder)
    runs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in runs.items():
        if options.names and not any(name.startswith(n) for n in options.names):
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = compare(con, run(spark, folder), sqls[name])
                verdict = problem or "ok"
            else:
                problem = None
                verdict = f"rows only: {run(spark, folder).count()}"
        except Exception as error:  # report every query, then fail
            traceback.print_exc(limit=3)
            problem = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - started:6.2f}s {verdict}"[:900], flush=True)
    release(spark)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
