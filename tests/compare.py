"""Compare every query with its SQL oracle in DuckDB.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def canonical(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, query, sql: str, sf_dir: str) -> str | None:
    """None when the results agree, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    result = connection.execute(sql)
    want_names, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    left, right = canonical(got_names, got), canonical(want_names, want)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from tidemark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, connection = local_session(8), connect(sf_dir)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in argv[1:] or queries:
        begin = time.time()
        try:
            problem = difference(spark, connection, queries[name], oracles[name], sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:26s} {time.time() - begin:6.2f}s {'ok' if problem is None else problem[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
