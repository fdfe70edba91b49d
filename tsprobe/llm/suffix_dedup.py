"""Removal of repeated passages: suffix arrays, sorted in two stages, of the places where documents share text.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. No suffix array spans the
corpus. Each 50-byte window is assigned to the 24-byte gram in it with the least hash, which depends on the window alone;
equal windows have equal grams. Blocks of documents ask which grams occur in two documents or more, in packed rows, and
only windows of those grams travel: consecutive windows of a gram as one context of 50 to 76 bytes, each different
context once for each block. A bucket takes all contexts of its grams. Contexts that have a gram to themselves hold no
window in common with others; the rest are joined into texts of bounded size, their suffixes are sorted in two stages,
windows whose adjacent common prefixes reach 50 bytes are equal, and each gets the least document that has it. Blocks
get these back and cut their documents.

A null text is empty. A null id counts as greater than all ids, and rows with equal ids don't remove from one another.
Documents of under 50 bytes stay whole. Texts of any length are read whole. An empty table gives no rows. ``keep`` names
columns to pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tsprobe.llm.common import lean, text, text_blocks
from tsprobe.llm.exchange import by_bucket, strings
from tsprobe.llm.two_stage import least_owners

LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
SLICE = 1 << 20
BATCH = 1 << 20
KEY_BYTES = 6
NO_ID = (1 << 63) - 1
ASKED = "bucket int, block int, keys binary, several binary"
SENT = "bucket int, block int, keys binary, sizes binary, contexts binary, owners binary"
ANSWER = "block int, bucket int, shared binary, counts binary, owners binary"


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the gram at each place."""
    n = len(t) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        word = np.ndarray((n,), "<u8", t, k, (1,))
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out >> np.uint64(16)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the first of equals."""
    place, done = np.arange(len(values), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        smaller = values[step:] < values[:-step]
        values = np.where(smaller, values[step:], values[:-step])
        place = np.where(smaller, place[step:], place[:-step])
        done += step
    return place


class Block:
    """The bytes of a block's documents, and its contexts: start, windows, gram hash and document of each."""

    def __init__(self, ids: list, texts, slice_bytes: int):
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        data = [t.encode() for t in texts]
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = b"".join(data)
        self.bytes = np.frombuffer(self.data, np.uint8)
        parts = [self.contexts(at, slice_bytes) for at in range(0, max(0, len(self.bytes) - LENGTH + 1), slice_bytes)]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.start, self.windows, self.gram = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def contexts(self, at: int, slice_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.bytes[at : at + slice_bytes + LENGTH - 1]
        h = gram_hashes(t)
        place = least_places(h, WIDTH)
        begin = at + np.arange(len(place), dtype=np.int64)
        inside = np.ones(len(place), bool)  # windows that end in the document they begin in
        for end in self.ends[np.searchsorted(self.ends, at, side="right") :]:
            if end >= at + len(t):
                break
            inside[max(0, end - at - LENGTH + 1) : end - at] = False
        begin, place = begin[inside], place[inside]
        if not len(begin):
            return begin, begin, np.zeros(0, np.uint64)
        new = np.ones(len(begin), bool)
        new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
        first = np.flatnonzero(new)
        return begin[first], np.diff(np.append(first, len(begin))), h[place[first]]

    def shared(self, some: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
        """Different contexts among those marked, in order of gram, and the place of each marked one among them."""
        places: dict[bytes, int] = {}
        data = self.data
        marked = np.flatnonzero(some)
        marked = marked[np.argsort(self.gram[marked], kind="stable")]
        where = np.fromiter((places.setdefault(data[s : s + w + LENGTH - 1], len(places)) for s, w in zip(self.start[marked].tolist(), self.windows[marked].tolist(), strict=True)), np.int64, len(marked))
        self.marked = marked
        return places, where


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for c, (n, k) in zip(columns, fields, strict=True)})


def in_order(block: pa.Table) -> pa.Table:
    """The block's rows by id and text: whenever a block is read, its contexts are cut at the same places."""
    ids = [NO_ID if i is None else i for i in block.column("_id").to_pylist()]
    marks_ = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in strings(block, "_text")]
    return block.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i], marks_[i])), pa.int64()))


def read(block: pa.Table, slice_bytes: int) -> Block:
    return Block(block.column("_id").to_pylist(), strings(block, "_text"), slice_bytes)


def marks(mine: Block, replies: pa.Table, n: int) -> np.ndarray:
    """Which contexts have a gram that several documents share."""
    keys, where = np.unique(mine.gram, return_inverse=True)
    order, found, first = by_bucket(keys, n)
    at = dict(zip(found.tolist(), zip(first, first[1:], strict=False), strict=True))
    out = np.zeros(len(keys), bool)
    for bucket, data in zip(replies.column("bucket").to_pylist(), replies.column("shared").to_pylist(), strict=True):
        if data is not None:
            i, j = at[bucket]
            out[order[i:j]] = np.unpackbits(np.frombuffer(data, np.uint8), count=j - i).astype(bool)
    return out[where]


def window_owners(contexts: list[bytes], grams: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """The least owner of each window of each context; contexts are in order of gram."""
    out = [np.full(len(c) - LENGTH + 1, o) for c, o in zip(contexts, owners, strict=True)]
    if not contexts:
        return out
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    batch: list[int] = []
    size = 0
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(contexts)], strict=True):
        if b - a > 1:
            batch.extend(range(a, b))
            size += sum(len(contexts[i]) for i in range(a, b))
        if batch and (size > BATCH or b == len(contexts)):
            for i, found in zip(batch, least_owners([contexts[i] for i in batch], owners[batch], LENGTH), strict=True):
                out[i] = found
            batch, size = [], 0
    return out


def dedup(docs: DataFrame, keep: list[str] | None = None, block_bytes: int = 16 << 20, with_text: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """The kept columns (doc_id alone if none are named) with n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for.

    A block's bytes are searched in slices of ``slice_bytes``. The new columns are one struct, ``repeats``. ``kept_text`` leaves out the parts of characters that a cut has split.
    """
    keep = ["doc_id"] if keep is None else keep
    passed = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    blocks, n = text_blocks(docs, [passed, F.col("doc_id").cast("long").alias("_id"), text().alias("_text")], block_bytes)

    def ask_grams(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        mine = read(in_order(block), slice_bytes)
        keys, first = np.unique(mine.gram, return_index=True)
        several = np.zeros(len(keys), bool)
        order = np.lexsort((mine.doc, mine.gram))
        gram, doc = mine.gram[order], mine.doc[order]
        again = (gram[1:] == gram[:-1]) & (mine.ids[doc[1:]] != mine.ids[doc[:-1]])
        several[np.searchsorted(keys, gram[1:][again])] = True
        order, found, first = by_bucket(keys, n)
        return table_of([(b, key[0].as_py(), packed(keys[order[i:j]]), np.packbits(several[order[i:j]]).tobytes()) for b, i, j in zip(found, first, first[1:], strict=False)], ASKED)

    def answer_grams(rows: pa.Table) -> pa.Table:
        each = [unpacked(x) for x in rows.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows.column("several").to_pylist(), each, strict=True)]
        _, where, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[where[np.concatenate(several).astype(bool)]] = True
        ends = np.cumsum([len(k) for k in each])
        out = zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), each, ends, strict=True)
        return table_of([(block, bucket, np.packbits(shared[where[e - len(k) : e]]).tobytes(), None, None) for block, bucket, k, e in out], ANSWER)

    def send(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        mine = read(in_order(block), slice_bytes)
        places, where = mine.shared(marks(mine, replies, n))
        owners = np.full(len(places), NO_ID)
        np.minimum.at(owners, where, mine.ids[mine.doc[mine.marked]])
        grams = np.zeros(len(places), np.uint64)
        grams[where] = mine.gram[mine.marked]
        contexts = list(places)
        rows = []
        for bucket, own in in_buckets(grams):
            some = [contexts[i] for i in own]
            rows.append((bucket, key[0].as_py(), packed(grams[own]), bytes(map(len, some)), b"".join(some), owners[own].tobytes()))
        return table_of(rows, SENT)

    def in_buckets(grams: np.ndarray):
        bucket = (grams % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        return zip(found.tolist(), np.split(order, first[1:]), strict=False) if len(order) else []

    def answer_windows(rows: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        where, grams, owners = [], [], []
        for k, s, c, o in zip(*(rows.column(x).to_pylist() for x in ("keys", "sizes", "contexts", "owners")), strict=True):
            at = np.append(0, np.cumsum(np.frombuffer(s, np.uint8), dtype=np.int64)).tolist()
            where.append(np.array([seen.setdefault(c[a:b], len(seen)) for a, b in zip(at, at[1:])], np.int64))
            grams.append(unpacked(k))
            owners.append(np.frombuffer(o, np.int64))
        place = np.concatenate(where)
        least, gram = np.full(len(seen), NO_ID), np.zeros(len(seen), np.uint64)
        np.minimum.at(least, place, np.concatenate(owners))
        gram[place] = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        contexts = list(seen)
        found: list = [None] * len(seen)
        for i, x in zip(order.tolist(), window_owners([contexts[i] for i in order], gram[order], least[order]), strict=True):
            found[i] = x[:1] if (x == x[0]).all() else x
        out = []
        for block, bucket, own in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), where, strict=True):
            mine = [found[i] for i in own]
            out.append((block, bucket, None, bytes(map(len, mine)), np.concatenate(mine).tobytes()))
        return table_of(out, ANSWER)

    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema = StructType.fromDDL("block int").add("_row", blocks.schema["_row"].dataType).add("repeats", StructType.fromDDL(added))

    def cut(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        block = in_order(block)
        mine = read(block, slice_bytes)
        _, where = mine.shared(marks(mine, replies, n))
        grams = np.zeros(int(where.max()) + 1 if len(where) else 0, np.uint64)
        grams[where] = mine.gram[mine.marked]
        counts, begins, values, used = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64), [np.zeros(0, np.int64)], 0
        answered = {b: (c, o) for b, c, o in zip(*(replies.column(x).to_pylist() for x in ("bucket", "counts", "owners")), strict=True) if c is not None}
        for bucket, own in in_buckets(grams):
            c, o = answered[bucket]
            counts[own] = np.frombuffer(c, np.uint8)
            begins[own] = used + np.cumsum(counts[own]) - counts[own]
            values.append(np.frombuffer(o, np.int64))
            used += len(values[-1])
        owners = np.concatenate(values)
        start, windows, ids = mine.start[mine.marked], mine.windows[mine.marked], mine.ids[mine.doc[mine.marked]]
        change = np.zeros(len(mine.bytes) + 1, np.int32)
        one = counts[where] == 1
        gone = one & (owners[begins[where] * one] < ids) if len(owners) else one
        np.add.at(change, start[gone], 1)
        np.add.at(change, start[gone] + windows[gone] + LENGTH - 1, -1)
        many = np.flatnonzero(~one)
        nth = np.arange(windows[many].sum()) - np.repeat(np.cumsum(windows[many]) - windows[many], windows[many])
        hit = owners[np.repeat(begins[where[many]], windows[many]) + nth] < np.repeat(ids[many], windows[many])
        at = (np.repeat(start[many], windows[many]) + nth)[hit]
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for size, end in zip(mine.sizes.tolist(), mine.ends.tolist(), strict=True):
            c = covered[end - size : end]
            left = mine.bytes[end - size : end][~c].tobytes() if c.any() else mine.data[end - size : end]
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
            rows.append({"n_bytes": size, "n_removed": size - len(left), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()} | ({"kept_text": left.decode("utf-8", "ignore")} if with_text else {}))
        kinds = pa.struct([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.string()) for x in added.split(", ")])
        return pa.table({"block": block.column("block"), "_row": block.column("_row"), "repeats": pa.array(rows, kinds)})

    grams = blocks.groupBy("block").applyInArrow(lean(ask_grams), ASKED).groupBy("bucket").applyInArrow(lean(answer_grams), ANSWER)
    sent = blocks.groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(lean(send), SENT)
    windows = sent.groupBy("bucket").applyInArrow(lean(answer_windows), ANSWER)
    done = blocks.groupBy("block").cogroup(grams.union(windows).groupBy("block")).applyInArrow(lean(cut), schema)
    return done.select("_row.*", "repeats")
