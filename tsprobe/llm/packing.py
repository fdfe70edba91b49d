"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Only lengths matter for the packing, and there are at most ``capacity`` of them. So the driver packs the histogram of
lengths, longest first: the segment tree finds the tightest open sequence in logarithmic time, and since equal pieces
fill a sequence as often as they fit before the next is opened, whole runs of equal pieces are placed at a step. The
result is a list of runs whose number depends on ``capacity`` alone; the executors number the pieces of each length and
look their run up. The packing is the one that best-fit decreasing gives piece by piece.

A null text is empty; an empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id
is packed like any other; other columns are not read. A text longer than a sequence is cut into full pieces with the
remainder first; no token is lost.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import give_back, running, saved, text
from tsprobe.llm.pretokens import Cache, Encoder, id_bytes

CACHES: dict = {}


class CapacityTree:
    """Segment tree over 0..capacity that tells the least marked capacity not below a given one."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.marks = bytearray(2 * self.leaves)

    def mark(self, capacity: int, there: bool) -> None:
        node = self.leaves + capacity
        self.marks[node] = there
        while node > 1:
            node //= 2
            self.marks[node] = self.marks[2 * node] | self.marks[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = self.leaves + least
        if self.marks[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.marks[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (not self.marks[2 * node])
                return node - self.leaves
            node //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, after, sequence, each, offset).

    Pieces first..after-1 of a length go to sequences from ``sequence`` on, ``each`` of them side by side in one, the
    first at ``offset``.
    """
    tree, open_, opened, runs = CapacityTree(capacity), defaultdict(list), 0, []

    def put(room: int, sequence: int, n: int) -> None:
        if n and room:
            open_[room].append((sequence, n))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, sequence = capacity, opened
                n = -(-(total - done) // (capacity // length))
                opened += n
            else:
                sequence, n = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, (total - done) // each)
            placed = full * each
            rest = min(each, total - done - placed) if full < n else 0
            runs.append((length, done, done + placed + rest, sequence, each, capacity - room))
            put(room - each * length, sequence, full)
            if rest:
                put(room - rest * length, sequence + full, 1)
            put(room, sequence + full + (rest > 0), n - full - (rest > 0))
            done += placed + rest
    return runs


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Each document's ids and the end id in pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in CACHES:
            CACHES[vocabulary] = Cache(Encoder(vocabulary, ranks, pattern), id_bytes)
        cache, end = CACHES[vocabulary], id_bytes([end_id])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = b"".join([*cache.all(value), end])
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    for column, x in zip(rows, (doc.as_py(), piece, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])), strict=True):
                        column.append(x)
                    at, piece = at + size, piece + 1
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text().alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    cut = saved(token_pieces(docs, vocabulary, capacity, end_id, ranks, pattern))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit_runs(histogram, capacity), "length long, first long, after long, sequence long, each long, base long")
    numbered = running(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), "number")
    mine = (F.col("p.length") == F.col("r.length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("after"))
    nth = F.col("number") - F.col("first")
    return numbered.alias("p").join(F.broadcast(runs).alias("r"), mine).select(
        "doc_id", "piece", "start", "p.length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("p.length")).cast("long").alias("offset"),
    )
