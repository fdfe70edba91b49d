"""Conversation prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from tsprobe.llm.prefix_trie import prefix_trie, shared_starts, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, shard string, key long"


def slow_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    said = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        said[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(said):
        for d in range(len(said[c]) + 1):
            members[said[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) > len(x) and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in convs if len(said[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie(df, **how).select(*COLUMNS).collect()), key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None, "a" * 50])))
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    rows = some_rows(1, 120)
    for width in (5, 35, 2000):  # one shard or many
        assert made(spark, rows, rebuild=shared_starts, width=width) == slow_trie(rows)
    assert made(spark, rows) == slow_trie(rows, rebuild=False)


def test_hot_conversations_ids_of_many_bits_and_repeats(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(90) for t in range(3)]
    rows += [(10**15 + 5, 0, "user", "turn 0"), (10**15 + 6, 0, "user", "other"), (-(10**15), 1, "user", "turn 0")]
    rows += rows[:4]  # repeated rows are turns
    rows += [(None, 0, "user", "nobody"), (300, None, None, None)]
    rows += [(400, t, "assistant", "long " * 2000) for t in range(60)]
    assert made(spark, rows, rebuild=shared_starts, width=10) == slow_trie(rows)
    assert made(spark, rows, width=10) == slow_trie(rows, rebuild=False)


def test_empty_table(spark):
    assert made(spark, [], rebuild=shared_starts) == []


def test_places_enclose_subtrees():
    turns = {c: [(bytes([x]) * 16, 1) for x in path] for c, path in enumerate([[1, 2, 3], [1, 2], [1, 4], [], [5]])}
    nodes = list(trie(turns))
    assert [n[3] for n in nodes] == list(range(len(nodes)))
    parent = {n[0]: n[1] for n in nodes}

    def inside(key, top):
        return key == top or (parent[key] is not None and inside(parent[key], top))

    for n in nodes:
        assert n[4] - n[3] == sum(inside(m[0], n[0]) for m in nodes)
    assert list(trie({})) == []
