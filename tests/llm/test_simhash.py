"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from tsprobe.llm import simhash
from tsprobe.llm.queries import QUERIES


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, limit=4):
    """Least place that each is linked to, over all pairs."""
    fps = np.array(fps, np.uint64)
    root = np.arange(len(fps))
    while True:
        up = np.array([root[np.bitwise_count(fps ^ x) <= limit].min() for x in fps])
        if (up == root).all():
            return root
        root = up


def ball(rng, n, bits, centre=None):
    """Codes with up to ``bits`` bits flipped from a centre."""
    centre = rng.getrandbits(64) if centre is None else centre
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_all_pairs(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    got = QUERIES["op11_simhash_near"](spark, sf_dir).toPandas().sort_values("doc_id")
    fps = [slow_fingerprint(t) for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == docs.doc_id.to_numpy()[slow_components(fps)].tolist()


def test_fingerprint_spaces_letters_and_short_texts():
    for t in ["", " \n", "a", "A b", "a b c", "a b c d", "AÄ b\x0bc d e f\x1fg", "x " * 70_000]:
        assert simhash.fingerprint(t) == slow_fingerprint(t), t[:20]
    assert simhash.fingerprint("Aa b") == simhash.fingerprint("aA  B\t") != simhash.fingerprint("Ä")


def test_gray_rank_orders_codes_so_that_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert set(np.bitwise_count(ordered[1:] ^ ordered[:-1]).tolist()) == {1}


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_the_components_of_several_groups(seed):
    rng = random.Random(seed)
    groups = [ball(rng, 300, 6), [rng.getrandbits(64) for _ in range(50)], [0], ball(rng, 9, 2) + ball(rng, 9, 2), [rng.getrandbits(12) for _ in range(700)]]
    codes, group = [], []
    for g, members in enumerate(groups):
        members = np.array(sorted(set(members)), np.uint64)
        codes.append(members[np.argsort(simhash.gray_rank(members))])
        group.append(np.full(len(members), g))
    root = simhash.GrayIndex(np.concatenate(codes), np.concatenate(group)).roots(4)
    at = 0
    for c in codes:
        assert (root[at : at + len(c)] - at).tolist() == slow_components(c).tolist()
        at += len(c)


def test_blocks_cover_the_free_bits():
    for mask in (0, 0xFFF0000000000000, (1 << 64) - 1 - 0b111):
        parts = [b & ~mask for b in simhash.blocks(mask)]
        assert sum(parts) == (1 << 64) - 1 - mask and all(b & mask == mask for b in simhash.blocks(mask))


@pytest.mark.parametrize(("node_rows", "most_heavy"), [(40, 1), (40, 50_000), (4096, 50_000)])
def test_large_nodes_are_dealt_again(spark, node_rows, most_heavy):
    rng = random.Random(7)
    fps = sorted(set(ball(rng, 150, 10) + ball(rng, 30, 4) + [rng.getrandbits(64) for _ in range(200)] + [0, 1, (1 << 64) - 1]))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {x: x for x in map(signed, fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in simhash.links(df, node_rows=node_rows, most_heavy=most_heavy).collect():
        root[find(a)] = find(b)
    want = slow_components(fps)
    got = [find(signed(x)) for x in fps]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_stream_passes_a_node_on_that_spans_batches(monkeypatch):
    monkeypatch.setattr(simhash, "BATCH", 8)
    import pyarrow as pa

    rows = [(5, 1, x) for x in range(30)] + [(5, 2, 64), (5, 2, 65)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 5])], names=["mask", "key", "fp"]) for i in range(0, len(rows), 5)]
    out = [r for b in simhash.forest(4, 10)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["a"] for r in out if r["onward"]) == list(range(30))
    assert [{r["a"], r["b"]} for r in out if not r["onward"]] == [{64, 65}]


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp long, mask long, component_id string"
    data = [(1, None, 1, 1, "x"), (0, "", 1, 1, "x"), (None, "a b c d e", None, None, None), (5, "A b c d e", 1, 1, "x"), (5, "a b c d e", 1, 1, "x"), (None, "lonely words here now", 1, 1, "x"), (7, "a b c d e " * 20_000, 1, 1, "x")]
    got = simhash.near_documents(spark.createDataFrame(data, schema)).collect()
    assert len(got) == len(data)
    at = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert at[1, "0" * 16] == at[0, "0" * 16] == 0
    same = f"{slow_fingerprint('a b c d e'):016x}"
    assert at[5, same] == at[None, same] == 5
    assert at[None, f"{slow_fingerprint('lonely words here now'):016x}"] is None
    assert simhash.near_documents(spark.createDataFrame([], schema)).count() == 0


def test_keys_with_many_rows_join_like_the_others(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 3) for i in range(500)], "doc_id long, fp long")
    named = rows.groupBy("fp").count().selectExpr("fp", "fp * 10 as name", "count as copies")
    for most in (1, 5, 1000):
        got = simhash.by_share(rows, named, "fp", 500, most)
        assert sorted((r.doc_id, r.fp, r.name) for r in got.collect()) == sorted((r.doc_id, r.fp, r.fp * 10) for r in rows.collect())
