"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tsprobe.llm import treap_search
from tsprobe.llm.queries import QUERIES
from tsprobe.llm.treap_search import Treap, build, ranked_search, saved, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, k=10):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n_docs, n_terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        ranked = []
        for d, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                ranked.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_against_all_scores(spark, sf_dir):
    docs, items = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = slow_search(zip(docs.doc_id.tolist(), docs.text.tolist()), zip(items.item_id.tolist(), items.text.tolist()))
    assert found(QUERIES["op13_treap_search"](spark, sf_dir)) == want


@pytest.mark.parametrize("seed", range(3))
def test_best_columns_of_a_grid(seed, monkeypatch):
    monkeypatch.setattr(treap_search, "AT_ONCE", 3)
    rng = np.random.default_rng(seed)
    grid = rng.integers(1, 9, (13, 70)) * (rng.random((13, 70)) < 0.2)
    rows, columns = np.nonzero(grid)
    sizes, quadrants, less = Treap.build(rows, columns, grid[rows, columns], 7)
    assert (less >= 0).all() and sizes[0] == 1 and sizes[-1] == len(rows)
    tree = Treap.read(7, sizes, quadrants, less)
    for _ in range(20):
        mine = rng.choice(13, rng.integers(1, 6), replace=False)
        w = rng.integers(1, 5, len(mine))
        score = (grid[mine] * w[:, None]).sum(axis=0)
        want = sorted(((int(s), i) for i, s in enumerate(score) if s > 0), key=lambda x: (-x[0], x[1]))
        got = sorted(tree.best(mine, w, 4, []), key=lambda x: (-x[0], x[1]))
        assert got[:4] == want[:4] and set(got) <= set(want)
        floor = int(np.median(score))
        assert {g for g in tree.best(mine, w, 4, [], floor + 1)} >= {x for x in want[:4] if x[0] > floor}
        kept = [want[0][0] + 1] * 4 if want else []
        assert tree.best(mine, w, 4, kept) == []


def test_a_grid_of_one_point():
    tree = Treap.read(0, *Treap.build(np.array([0]), np.array([0]), np.array([5]), 0))
    assert tree.best(np.array([0]), np.array([3]), 2, []) == [(15, 0)]


def random_docs(rng, n):
    words = ["a", "B", "ünder", "x1", "the", "ß", "日本", "rare", "z"]
    return [(rng.choice([None, *range(40)]), rng.choice([" ", ".", "\n", "_"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(n)]


def test_small_shards_ties_nulls_and_odd_columns(spark):
    rng = random.Random(3)
    docs = random_docs(rng, 150) + [(90, None), (91, ""), (92, "... --"), (7, "the " * 9000), (8, "copy this"), (9, "copy this"), (8, "copy this")] * 3
    items = [("i1", "The x1 rare_thing"), ("i2", "copy THIS"), (None, "ß 日本 z"), ("i4", None), ("i5", "unknown"), ("i2", "copy THIS"), ("i7", " ".join("a b ünder x1 the ß rare z".split() * 3))]
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, doc_id int")
    index = saved(build(d, shard_points=40))
    assert index.count() > 5
    assert found(search(index, i)) == slow_search(docs, items)
    assert found(search(index, i, k=3, block_bytes=100)) == slow_search(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(ranked_search(docs.limit(0), items)) == []
    assert found(ranked_search(docs, items.limit(0))) == []
    assert found(ranked_search(docs.where("false").union(docs.selectExpr("doc_id", "'?' as text")), items)) == []
    assert found(ranked_search(docs, items)) == [(1, 1, 1, slow_search([(1, "a b")], [(1, "a")])[0][3])]
