"""Compare registered queries with their SQL oracles.

    python tools/parity.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from tsprobe.plans.catalogue import ORACLES, QUERIES
from tsprobe.plans.registry import TABLES
from tsprobe.session import local_session


def canon(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(v)
    try:
        return repr(float(v)) if not hasattr(v, "isoformat") else v.isoformat()
    except TypeError:
        return repr(v)


def compare(spark, con, name: str, sf_dir: str):
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    names = df.columns
    rows = df.collect()
    took = time.time() - t0
    if name not in ORACLES:
        return ("rows-only" if rows else "EMPTY"), len(rows), took, ""
    rel = con.sql(ORACLES[name])
    cols = rel.columns
    got_o = rel.fetchall()
    if sorted(names) != sorted(cols):
        return "COLUMNS", len(rows), took, f"{sorted(names)} vs {sorted(cols)}"
    order = sorted(names)
    a = sorted(tuple(canon(r[names.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in got_o)
    if a == b:
        status = "ok" if a else "EMPTY"
        kinds = {c: type(next((r[names.index(c)] for r in rows if r[names.index(c)] is not None), None)).__name__ for c in order}
        kinds_o = {c: type(next((r[cols.index(c)] for r in got_o if r[cols.index(c)] is not None), None)).__name__ for c in order}
        diff = {c: (kinds[c], kinds_o[c]) for c in order if kinds[c] != kinds_o[c]}
        return (status if not diff else "TYPES"), len(rows), took, str(diff or "")
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return "DIFF", len(rows), took, f"rows {len(a)}/{len(b)} {order} spark={only_a} duckdb={only_b}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", help="only queries defined in this plans module")
    args = ap.parse_args()
    spark, con = local_session(8), connect(args.sf)
    names = args.names or [n for n, f in QUERIES.items() if not args.module or f.__module__.endswith("." + args.module)]
    bad = 0
    for n in names:
        try:
            status, rows, took, note = compare(spark, con, n, args.sf)
        except Exception as e:  # report and go on with the next query
            status, rows, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {n:32} rows={rows:<8} {took:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
