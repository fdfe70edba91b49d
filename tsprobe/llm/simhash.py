"""SimHash near duplicates: fingerprints linked through Gray-order hierarchical indexes.

A fingerprint has 64 bits: the majority, bit by bit, of the hashes of a text's runs of words. Two fingerprints link when
they differ in few bits (``LIMIT``); the documents that links reach from each other are one component.

*Upper nodes.* The bits are cut into ``LIMIT + 1`` blocks. Linked fingerprints agree in one block at least, so each
fingerprint goes below one upper node per block: the masked pattern that all members of the node share. A node with more
than ``node_rows`` members, such as a large group of near copies, is dealt once more, by ``LIMIT + 1`` blocks of its free
bits, and so on; only what is too large moves again, and no pair is lost on the way. A node of 4 free bits is never split. The largest nodes (``most_heavy`` at
most, so that their broadcast is bounded) are dealt on before any shuffle, others when a task finds them too large.

*Lower nodes.* Inside an upper node the members are sorted by Gray rank, so that neighbours differ in few bits. Runs of
``FAN`` are nodes, runs of nodes are nodes again; a node keeps the masked pattern of the bits that its members share and
its parent does not. A fingerprint descends with the differences added up so far: a node above the limit is left out with
all that is below it, and so is a node all of whose members are in the fingerprint's component already. A dense group thus
costs about as many steps as it has members, not as many as it has links.

Each task returns a spanning forest of its links; components are found from the forests by repeated joins. Links are exact.

Result: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component). A null text is empty;
texts without words have fingerprint zero and are linked like any other. Repeated rows are documents of equal text. A null
doc_id is a document too, but names a component only where there is no other id (component_id null). Very long texts are
hashed in pieces of the run list. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import saved, text
from tsprobe.llm.components import components

N_WORDS, SEED, BITS, LIMIT = 4, 42, 64, 4
FAN, BATCH, QUERIES_AT_ONCE = 8, 1 << 16, 512


def fingerprint(value: str, n: int = N_WORDS, seed: int = SEED) -> int:
    """Bits that are set in over half the hashes of the runs of ``n`` words (of all words where there are fewer)."""
    found = value.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces part words
    if not found:
        return 0
    runs = map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False)) if len(found) > n else iter([b" ".join(found)])
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BATCH):
        bits = np.unpackbits(hashes[at : at + BATCH].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = N_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(i)[at : at + 256] for i in range(2))
                fps = np.fromiter((fingerprint(t, n, seed) for t in texts.to_pylist()), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text")).mapInArrow(made, "doc_id long, fp long")


def blocks(mask: int, limit: int = LIMIT) -> list[int]:
    """``mask`` with one more block: the free bits cut into ``limit + 1`` runs of about equal length."""
    free = [b for b in range(BITS - 1, -1, -1) if not mask >> b & 1]
    n = limit + 1
    return [mask | sum(1 << b for b in free[i * len(free) // n : (i + 1) * len(free) // n]) for i in range(n)]


def dealt(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """mask, key and fp: each fingerprint below its upper nodes, from fp and the mask of the node it comes from."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            known, which = np.unique(mask, return_inverse=True)
            below = np.array([blocks(int(m), limit) for m in known], np.uint64).reshape(len(known), limit + 1)
            masks = below[which].ravel()
            fps = np.repeat(fp, limit + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (masks, fps & masks, fps)], names=["mask", "key", "fp"])

    return rows.select("fp", "mask").mapInArrow(deal, "mask long, key long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code among all codes in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """Hierarchical indexes of several groups side by side; ``codes`` are sorted by group and then by Gray rank."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes = codes
        both, any_, owner = codes, codes, group
        last = np.arange(len(codes))
        self.levels: list[dict[str, np.ndarray]] = []  # from the leaves up
        every = True
        while every or np.any(owner[1:] == owner[:-1]):
            first_of = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            place = np.arange(len(owner)) - np.repeat(first_of, np.diff(np.append(first_of, len(owner))))
            start = np.flatnonzero(place % FAN == 0)
            end = np.append(start[1:], len(owner))
            both, any_ = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(any_, start)
            owner, last = owner[start], last[end - 1]
            self.levels.append({"start": start, "end": end, "shared": ~(both ^ any_), "pattern": both, "last": last})
            every = False
        full = np.full(len(codes), ~np.uint64(0))
        below = [{"shared": full, "pattern": codes, "last": np.arange(len(codes))}, *self.levels[:-1]]
        for lower, upper in zip(below, self.levels, strict=True):  # what a node shares beyond its parent
            parent = np.repeat(np.arange(len(upper["start"])), upper["end"] - upper["start"])
            upper["residual"] = lower["shared"] & ~upper["shared"][parent]
            upper["below"] = lower["pattern"]
            upper["below_last"] = lower["last"]
        self.top = np.repeat(np.arange(len(self.levels[-1]["start"])), np.diff(np.append(0, self.levels[-1]["last"] + 1)))

    def roots(self, limit: int) -> np.ndarray:
        """For each code the least place that it is linked to, directly or through others."""
        root = np.arange(len(self.codes))
        uniform = self.uniform(root)
        for at in range(0, len(self.codes), QUERIES_AT_ONCE):
            q = np.arange(at, min(at + QUERIES_AT_ONCE, len(self.codes)))
            i, j = self.near(q, limit, root, uniform)
            if len(i) and merge(root, i, j):
                uniform = self.uniform(root)
        return root

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """For the nodes below each level: the component of all their members, or -1."""
        least = most = root
        out = [root]
        for level in self.levels[:-1]:
            least, most = np.minimum.reduceat(least, level["start"]), np.maximum.reduceat(most, level["start"])
            out.append(np.where(least == most, least, -1))
        return out

    def near(self, q: np.ndarray, limit: int, root: np.ndarray, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of q and later codes within the limit that are not yet in one component."""
        codes = self.codes
        node = self.top[q]
        upper = self.levels[-1]
        gone = np.bitwise_count((codes[q] ^ upper["pattern"][node]) & upper["shared"][node])
        for level, same in zip(reversed(self.levels), reversed(uniform), strict=True):
            n = level["end"][node] - level["start"][node]
            child = np.repeat(level["start"][node] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            q = np.repeat(q, n)
            gone = np.repeat(gone, n) + np.bitwise_count((codes[q] ^ level["below"][child]) & level["residual"][child])
            on = (gone <= limit) & (level["below_last"][child] > q) & (same[child] != root[q])
            q, node, gone = q[on], child[on], gone[on]
        return q, node


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Join the components of i and j, pair by pair, in place; whether anything changed."""
    changed = False
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return changed
        changed = True
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := root[root], root):
            root[:] = up


def forest(limit: int, node_rows: int):
    """Sorted rows of upper nodes to edges (a, b) of a spanning forest; members (a, mask) of nodes that are too large go on."""

    def can_split(mask: np.ndarray) -> np.ndarray:
        return np.bitwise_count(~mask) > limit  # with fewer free bits a node has a handful of members

    def edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.append(0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        size = np.bincount(group)[group]
        if (large := (size > node_rows) & can_split(mask)).any():
            yield onward(mask[large], fp[large])
        some = (size > 1) & ~large
        fp, group = fp[some], group[some]
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        if len(fp):
            root = GrayIndex(fp, group).roots(limit)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield out(fp[linked], fp[root[linked]], np.zeros(len(linked), np.uint64), False)

    def out(a: np.ndarray, b: np.ndarray, mask: np.ndarray, on: bool) -> pa.RecordBatch:
        columns = [pa.array(x.view(np.int64)) for x in (a, b, mask)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), on))], names=["a", "b", "mask", "onward"])

    def onward(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return out(fp, fp, mask, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3
        leaving = None  # the node that is being passed on
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
            if leaving is not None:
                same = (new[0] == leaving[0]) & (new[1] == leaving[1])
                yield onward(new[0][same], new[2][same])
                new = [x[~same] for x in new]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < BATCH:
                continue
            mask, key, _ = held
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield from edges(*(x[:done] for x in held))
            held = [x[done:] for x in held]
            if len(held[0]) > node_rows and can_split(held[0][:1])[0]:
                leaving = held[0][0], held[1][0]
                yield onward(held[0], held[2])
                held = [np.zeros(0, np.uint64)] * 3
        if len(held[0]):
            yield from edges(*held)

    return run


def links(distinct: DataFrame, limit: int = LIMIT, node_rows: int = 4096, most_heavy: int = 50_000) -> DataFrame:
    """a and b: edges of forests that connect just what links of at most ``limit`` bits connect, among distinct ``fp``."""
    node = ["mask", "key"]
    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        below = dealt(rows, limit)
        heavy = below.groupBy(*node).count().where((F.col("count") > node_rows) & (F.bit_count(F.bitwise_not("mask")) > limit)).orderBy(F.desc("count")).limit(most_heavy).select(*node)
        marked = below.join(F.broadcast(saved(heavy).withColumn("heavy", F.lit(True))), node, "left")
        at_once = marked.where("heavy").select("fp", "mask")
        tasks = marked.where("heavy is null").select(*node, "fp").repartition(*node).sortWithinPartitions(*node)
        made = saved(tasks.mapInArrow(forest(limit, node_rows), "a long, b long, mask long, onward boolean"))
        edges = made.where("not onward").select("a", "b")
        found = edges if found is None else found.union(edges)
        rows = saved(at_once.union(made.where("onward").select(F.col("a").alias("fp"), "mask")))
        if rows.isEmpty():
            return found


def near_documents(docs: DataFrame, n: int = N_WORDS, seed: int = SEED, limit: int = LIMIT, node_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    own = saved(fingerprints(docs, n, seed))
    each = saved(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(each, limit, node_rows)).withColumnRenamed("id", "fp")
    of = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = saved(of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "copies"))
    found = by_share(own, named, "fp", own.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def by_share(rows: DataFrame, named: DataFrame, key: str, total: int, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``named`` (one row per key, with the number of its rows in ``copies``) on ``key``.

    Keys with more than one of ``most`` of all rows, fewer than ``most`` in number, are broadcast: their rows stay where
    they are. The others are joined by a shuffle.
    """
    often = F.col("copies") * most > total
    hot = F.broadcast(named.where(often))
    rest = rows.join(F.broadcast(named.where(often).select(key)), key, "left_anti").join(named.where(~often), key)
    return rows.join(hot, key).select(*rest.columns).union(rest)
