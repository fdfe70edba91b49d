"""Conversation prefix trie: vertical bitmaps over (position, turn), intersected depth first in shards of conversations.

A shard holds the conversations of ``width`` neighbouring ids. It indexes every (position, turn) by the set of its
conversations that have this turn there, as a bitset; another bitset per position says which conversations end there. From
the root, the children of a node are the intersections of its bitset with the postings of the next position, found by taking
the first conversation left and removing its child until none is left; popcounts are the members, and the intersection
with the ends gives the end list. Shards know turns by 128 bits of a digest and nodes by 128 bits of a chained digest, so
texts are not shuffled.

A node of many shards has one row in each, so that a first turn shared by a third of all conversations is added up from
as many rows as there are shards. Shards are ranges of ids, in the order of ids: their end lists are appended to one digest, a
piece at a time. Sums over subtrees go the other way: a node counts in the shard of its least member, which knows all the
node's ancestors; there they are differences of a running sum in depth-first order, added up over shards like the members.

``conversations`` gives turns in order (nulls first, equal turns by their digest). A null role or text is empty; a row
without conv_id belongs to no conversation; a repeated row is a turn of its own; a row is a turn even where all but its
conv_id is null. A conversation's digests (about 40 bytes a turn) are held in one task, its texts are not. An empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import saved
from tsprobe.llm.simhash import by_share

ROOT = bytes(16)
NODES = "shard long, key binary, parent binary, depth long, place long, after long, n long, conv_id long, n_bytes long, ends binary"

#: The turns of one conversation: digests and bytes of the texts, in order.
Turns = list[tuple[bytes, int]]


def shard_of(conv_id: Column, width: int) -> Column:
    """The number of the range of ``width`` ids that the id is in; whole numbers only, also below zero."""
    return F.call_function("div", conv_id - F.pmod(conv_id, F.lit(width)), F.lit(width))


def turns(rows: DataFrame, width: int) -> DataFrame:
    """shard, conv_id, turn, digest of role and text, and the bytes of the text."""
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, said)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest")
    conv = F.col("conv_id").cast("long")
    ids = rows.where(conv.isNotNull()).select(shard_of(conv, width).alias("shard"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest, F.octet_length(said).cast("long").alias("n_bytes"))
    return ids.repartition("shard").sortWithinPartitions("shard", "conv_id", F.asc_nulls_first("turn"), "digest")


def shared_starts(own: dict[int, Turns], every: int = 5, most: int = 9) -> dict[int, Turns]:
    """Conversations that begin as the first of their group of ``every`` ids does, for a number of turns set by a checksum."""
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % every, [])[:h] + mine[h:]
    return out


def trie(conversations: dict[int, Turns]) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, int, int, bytes | None]]:
    """Nodes in depth-first order: key, parent, depth, place, place after the subtree, members, least member, bytes of the last text, end list."""
    ids = sorted(conversations)
    at: list[dict[bytes, int]] = []  # by position: turn to the conversations with it there
    ends: dict[int, int] = defaultdict(int)
    for bit, c in enumerate(ids):
        said = conversations[c]
        while len(at) < len(said):
            at.append(defaultdict(int))
        for position, (digest, _) in enumerate(said):
            at[position][digest] |= 1 << bit
        ends[len(said)] |= 1 << bit
    nodes: list[list] = []
    open_: list[int] = []  # places of the nodes on the current path
    stack = [(ROOT, None, 0, (1 << len(ids)) - 1)] if ids else []
    while stack:
        key, parent, depth, members = stack.pop()
        while len(open_) > depth:
            nodes[open_.pop()][4] = len(nodes)
        open_.append(len(nodes))
        first = (members & -members).bit_length() - 1
        n_bytes = conversations[ids[first]][depth - 1][1] if depth else 0
        ending = members & ends.get(depth, 0)
        listed = ",".join(str(ids[b]) for b in bits(ending)).encode() if ending else None
        nodes.append([key, parent, depth, len(nodes), 0, members.bit_count(), ids[first], n_bytes, listed])
        left = members & ~ending
        while left:
            first = (left & -left).bit_length() - 1
            digest = conversations[ids[first]][depth][0]
            child = left & at[depth][digest]
            stack.append((hashlib.blake2b(key + digest, digest_size=16).digest(), key, depth + 1, child))
            left &= ~child
    while open_:
        nodes[open_.pop()][4] = len(nodes)
    return map(tuple, nodes)


def bits(value: int) -> Iterator[int]:
    while value:
        low = value & -value
        yield low.bit_length() - 1
        value ^= low


def shard_nodes(rebuild: Callable[[dict[int, Turns]], dict[int, Turns]]):
    """Sorted turns to the nodes of each shard."""

    def made(shard: int, own: dict[int, Turns]) -> Iterator[pa.RecordBatch]:
        found = list(trie(rebuild(own)))
        for i in range(0, len(found), 10_000):
            part = found[i : i + 10_000]
            columns = zip(*part, strict=True)
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.binary()]
            arrays = [pa.array([shard] * len(part), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "key", "parent", "depth", "place", "after", "n", "conv_id", "n_bytes", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, {}
        for batch in batches:
            for shard, conv, digest, n_bytes in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if shard != held:
                    if own:
                        yield from made(held, own)
                    held, own = shard, {}
                own.setdefault(conv, []).append((digest, n_bytes))
        if own:
            yield from made(held, own)

    return run


def subtree_sums(rows: pa.Table) -> pa.Table:
    """Sums of one shard: key, leaves and saved of each node's subtree; ``leaf`` and ``gain`` are null where another shard counts the node."""
    rows = rows.sort_by("place")
    after = rows.column("after").to_numpy()
    out = {"key": rows.column("key")}
    for name, column in (("n_leaves", "leaf"), ("saved_tokens", "gain")):
        sums = np.append(0, np.cumsum(rows.column(column).fill_null(0).to_numpy()))
        out[name] = pa.array(sums[after] - sums[:-1])
    return pa.table(out)


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of end lists, sorted by key and shard, to one digest per key."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + piece)
            else:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(rows: DataFrame, rebuild: Callable[[dict[int, Turns]], dict[int, Turns]] = dict, width: int = 2000) -> DataFrame:
    """One row per node: key, parent_key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` may change the conversations of a shard before they are indexed; it sees all of the ``width`` ids from a
    multiple of ``width`` on that exist.
    """
    local = saved(turns(rows, width).mapInArrow(shard_nodes(rebuild), NODES))
    ends = local.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    lists = ends.mapInArrow(end_digests, "key binary, ends_sha256 string")
    merged = local.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("n_bytes").alias("n_bytes"))
    merged = merged.join(lists, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    merged = saved(merged)
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = saved(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    counted = nodes.select("key", shard_of(F.col("conv_id"), width).alias("shard"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("gain"))
    placed = local.select("shard", "key", "place", "after").join(counted, ["shard", "key"], "left")
    sums = placed.groupBy("shard").applyInArrow(subtree_sums, "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("copies"))
    below = nodes.where("parent is not null")
    known = by_share(below, parents, "parent", below.count()).select("key", "parent_conv_id")
    return (
        nodes.join(sums, "key").join(known, "key", "left")
        .select("key", F.col("parent").alias("parent_key"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    )
