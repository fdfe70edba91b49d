"""Blocks of documents ask about keys, buckets of keys answer: lookups too large to broadcast, without a row per key.

A block sends the sorted distinct hashes of what it asks about, with a number for each, in one row for every bucket. A
bucket adds up the numbers of equal keys and answers each block in the block's own order, so that an answer needs no
keys. A key is asked about once by a block however often it occurs there; no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

ASKED = "bucket int, block int, keys binary, numbers binary"
ANSWER = "block int, bucket int, answer binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket and key of distinct keys, the buckets that occur and where each begins (with the end)."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(keys))


def ask(block: int, keys: np.ndarray, numbers: np.ndarray, buckets: int) -> pa.Table:
    """The rows of one block; ``numbers`` is stored as it is, 4 bytes or 8."""
    order, found, first = by_bucket(keys, buckets)
    k, v = keys[order], numbers[order]
    return pa.table({
        "bucket": pa.array(found, pa.int32()), "block": pa.array([block] * len(found), pa.int32()),
        "keys": pa.array([k[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
        "numbers": pa.array([v[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary()),
    })


def answers(keys: np.ndarray, replies: pa.Table, buckets: int, kind: type) -> np.ndarray:
    """What the buckets say about the block's keys, in the order of ``keys``."""
    order, found, first = by_bucket(keys, buckets)
    at = {b: (i, j) for b, i, j in zip(found.tolist(), first, first[1:])}
    out = np.zeros(len(keys), kind)
    for bucket, data in zip(replies.column("bucket").to_pylist(), replies.column("answer").to_pylist(), strict=True):
        i, j = at[bucket]
        out[order[i:j]] = np.frombuffer(data, kind)
    return out


def summed(kind: type) -> Callable[[pa.Table], tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For a bucket's rows: the keys of each row, the distinct keys, their sums, and where each row's keys are among them."""

    def add(rows: pa.Table):
        each = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        numbers = np.concatenate([np.frombuffer(x, kind) for x in rows.column("numbers").to_pylist()])
        distinct, where = np.unique(np.concatenate(each), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, where, numbers.astype(np.int64))
        return each, distinct, sums, where

    return add


def reply_sums(asked: DataFrame, kind: type = np.uint32) -> DataFrame:
    """Answers with the sum of each key's numbers, as 64-bit numbers."""
    add = summed(kind)

    def answer(rows: pa.Table) -> pa.Table:
        each, _, sums, where = add(rows)
        ends = np.cumsum([len(k) for k in each])
        data = [sums[where[e - len(k) : e]].tobytes() for k, e in zip(each, ends, strict=True)]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "answer": pa.array(data, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, ANSWER)


class Vocabulary:
    """Distinct tokens of a block: a place for each, and their hashes."""

    def __init__(self):
        self.places: dict[bytes, int] = {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        places = self.places
        return np.fromiter((places.setdefault(t, len(places)) for t in tokens), np.int64, len(tokens))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self.places), np.uint64, len(self.places))


def strings(table: pa.Table, column: str) -> Iterator[str]:
    """The values of a column, a few at a time."""
    for chunk in table.column(column).chunks:
        for at in range(0, len(chunk), 64):
            yield from chunk[at : at + 64].to_pylist()
