"""Hash draws of the bootstrap: every row keeps its draw, and no array of cells is exploded with the replicates."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tsprobe.operators import bootstrap


def test_hash_scores_draw_by_cells(rows):
    data = [(i, i % 2, i % 3, (i * 7) % 4 if i % 5 else i % 3) for i in range(90)]
    df = rows("idx long, run int, gt int, pred int", data)
    out = bootstrap.bootstrap_hash_scores(df, ["run"], "idx", 4)
    got = {(r["run"], r["replicate"]): (r["n"], round(r["accuracy"], 9)) for r in out.collect()}
    for run in (0, 1):
        mine = [d for d in data if d[1] == run]
        ordered = [c for c, n in sorted(Counter((d[2], d[3]) for d in mine).items()) for _ in range(n)]
        for b in range(4):
            drawn = [ordered[int(hashlib.md5(f"42|{b}|{d[0]}".encode()).hexdigest()[:8], 16) % len(mine)] for d in mine]
            assert got[run, b] == (len(mine), round(sum(g == p for g, p in drawn) / len(mine), 9))
    assert "filter(_u" not in out._jdf.queryExecution().analyzed().toString()
    assert bootstrap.bootstrap_hash_scores(df, [], "idx", 3).select(F.sum("n")).first()[0] == 270
