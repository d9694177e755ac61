"""Run named queries and their SQL side by side and report differences.

Usage: python tests/oracle_check.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])
    return [columns[i] for i in order], out


def compare(df, con, text: str) -> str | None:
    cols, ours = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    names, theirs = table([d[0] for d in cur.description], cur.fetchall())
    if cols != names:
        return f"columns {cols} vs {names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    for i, name in enumerate(cols):
        a = {kind(r[i]) for r in ours if r[i] is not None}
        b = {kind(r[i]) for r in theirs if r[i] is not None}
        if a != b:
            return f"types of {name}: {a} vs {b}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    return None if ours else "no rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from curveboard.session import local_session

    path = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        path, argv = argv[1], argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = connect(path)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(name == p or name.startswith(p) for p in argv):
            continue
        begin = time.time()
        try:
            if name in oracles:
                problem = compare(run(spark, path), con, oracles[name])
            else:
                n = run(spark, path).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        if problem or time.time() - begin > 5 or os.environ.get("VERBOSE"):
            print(f"{mark} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{failed} failed of {len(queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
