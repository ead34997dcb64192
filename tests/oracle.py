"""Compare every registered query with its SQL: ``python tests/oracle.py [names] [--sf folder]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KIND = {
    "tinyint": "int", "smallint": "int", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def compare(spark, con, name, query, sql, folder):
    """An error text, or None when both sides agree."""
    df = query(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] is not None else "no rows"
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want = normal(names, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    ours = dict(df.dtypes)
    for n, t in zip(names, types):
        if ours[n] in KIND and KIND[ours[n]] != t:
            return f"type of {n}: {ours[n]} against {t}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}; first {got[1][:2]} / {want[1][:2]}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            return f"first difference {g} against {w}"
    if not got[1]:
        return "both sides are empty"
    return None


def main(argv):
    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        folder = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    import __spark_entry__ as entry
    from curata.session import local_session

    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, sql.get(name), folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        label = "ok  " if problem is None else "FAIL"
        if name not in sql and problem is None:
            label = "rows"
        print(f"{label} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
