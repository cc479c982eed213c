"""Run registered queries and their SQL counterparts and compare all rows.

    python tests/compare.py [--sf DIR] [query ...]
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

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, oracle, sf):
    start = time.time()
    df = query(spark, sf)
    rows = df.collect()
    took = time.time() - start
    if oracle is None:
        return f"rows-only {len(rows)}", took, True
    cur = con.execute(oracle)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in rows])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", took, False
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}\n   spark only: {extra}\n   sql only:   {missing}", took, False
    return f"ok {len(got)}", took, True


def main():
    from foliotab.plans import all_oracles, all_queries
    from session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark, con = local_session(), connect(a.sf)
    queries, oracles = all_queries(), all_oracles()
    bad = []
    for name in a.names or queries:
        try:
            note, took, ok = check(spark, con, name, queries[name], oracles.get(name), a.sf)
        except Exception as e:  # noqa: BLE001
            note, took, ok = "ERROR " + str(e)[:1200], 0.0, False
            if "-v" in sys.argv:
                traceback.print_exc()
        if not ok:
            bad.append(name)
        print(f"{'  ' if ok else '!!'} {name:32s} {took:6.2f}s {note}", flush=True)
    print(f"{len(bad)} failing of {len(a.names or queries)}: {bad}")


if __name__ == "__main__":
    main()
