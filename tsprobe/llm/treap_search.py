"""Ranked lexical search: K2-treaps over the grid of terms and documents, searched best-first by document ranges.

*Index.* Each task cuts its documents, in order of their ids, into shards of about ``shard_points`` (term, document) pairs; no text is shuffled.
The grid of a shard has its sorted terms as rows, its documents as columns and at every point the impact of the term
in the document. A quadtree over the grid keeps for every cell that is not empty which of its quadrants are not (4 bits) and
the greatest impact below, as the difference from its parent's; both are stored level by level and compressed. A row of the
index also has the shard's terms with their document counts, in columns of their own, so that counting reads no trees.

*Search.* Items are taken in blocks of about ``block_bytes`` of text, one after the other; what is broadcast is a block, its terms and
their weights. A first pass over the terms of all shards gives the document counts, a second one searches. An item descends with one
path per term, all at once: a range of documents has for each term the cell that holds the term's row and the range, and
the sum of weight times greatest impact bounds the score of every document in it. The ranges with the greatest
bounds are halved first, a few at a time, and a range below the item's worst kept score is left out; a task keeps an item's best
from shard to shard. All that scores is found: ranks are exact, and no candidate is cut.

Scores: terms are runs of letters, digits and all characters beyond ASCII, A-Z lower-cased; see ``impact`` and ``weight``.
Result: item_id, rank from 1, doc_id, score of the ``k`` best documents of each item with a score above 0; equal scores in
order of doc_id (null last). A null text is empty; documents without terms don't count and are never found; items without
known terms have no rows. Every item row is an item: two rows with one id give two lists. Repeated documents are all
ranked. A very long text is read whole and may be a shard of its own. Other columns are not read. The term counts of a
task's shard are bounded by ``shard_points`` and the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsprobe.llm.common import saved, text

#: Bytes of terms, A-Z lower-cased, and a space for every other byte.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "n_docs int, terms binary, dfs binary, docs binary, height int, sizes array<int>, quadrants binary, maxima binary"
#: Number of the first bits of four that are set, by the four and how many are looked at.
BEFORE = np.array([[(q & ((1 << n) - 1)).bit_count() for n in range(5)] for q in range(16)], np.int64)
AT_ONCE = 64


def terms_of(value: str) -> list[bytes]:
    return value.encode().translate(LETTERS).split()


def impact(tf: int, n: int, n_docs: int, n_terms: int) -> int:
    """What ``tf`` occurrences count in a document of ``n`` terms, among ``n_docs`` documents of ``n_terms``."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sizes = [len(terms_of(t)) for t in batch.column(0)[at : at + 64].to_pylist()]
                n_docs, n_terms = n_docs + sum(map(bool, sizes)), n_terms + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["n_docs", "n_terms"])

    row = docs.select(text().alias("text")).mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return row[0] or 0, row[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 with a free bit before each of theirs."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A K2-treap: cells from the root down, level by level; ``sizes`` cells in each, the last level being points."""

    def __init__(self, height: int, sizes: list[int], quadrants: np.ndarray, maxima: np.ndarray):
        self.height, self.sizes = height, sizes
        self.none = len(maxima)  # an empty cell, after all others
        below = BEFORE[:, 4][quadrants]
        leaves = np.zeros(self.none + 1 - len(quadrants), np.int64)
        self.first = np.append(np.cumsum(below) - below + 1, leaves)  # place of the first child; children are in order
        self.quadrants = np.append(quadrants.astype(np.int64), leaves)
        self.maxima = np.append(maxima, 0)

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Sizes of the levels, quadrants of all cells but points, and maxima as differences from the parents'."""
        code = spread(rows) << np.uint64(1) | spread(columns)
        order = np.argsort(code)
        code, most = code[order], values[order].astype(np.int64)
        sizes, quadrants, less = [len(code)], [], []
        for _ in range(height):
            parent = code >> np.uint64(2)
            start = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            one = (1 << (code & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            upper = np.maximum.reduceat(most, start)
            n = np.diff(np.append(start, len(code)))
            quadrants.append(np.bitwise_or.reduceat(one, start))
            less.append(np.repeat(upper, n) - most)
            code, most = parent[start], upper
            sizes.append(len(code))
        less.append(most)
        return sizes[::-1], np.concatenate(quadrants[::-1]) if quadrants else np.zeros(0, np.uint8), np.concatenate(less[::-1])

    @classmethod
    def read(cls, height: int, sizes: list[int], quadrants: np.ndarray, less: np.ndarray) -> Treap:
        maxima = less.astype(np.int64)
        below = BEFORE[:, 4][quadrants]
        at, up = sizes[0], 0
        for size, next_ in zip(sizes, sizes[1:]):
            maxima[at : at + next_] = np.repeat(maxima[up : up + size], below[up : up + size]) - maxima[at : at + next_]
            at, up = at + next_, up + size
        return cls(height, sizes, quadrants, maxima)

    def child(self, cells: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The cells' children in the quadrants; the empty cell where there is none."""
        q = self.quadrants[cells]
        return np.where(q >> quadrant & 1, self.first[cells] + BEFORE[q, quadrant], self.none)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, kept: list[int], least: int = 1) -> list[tuple[int, int]]:
        """(score, column) of all columns with a score of ``least`` or more that may be among the ``k`` best with ``kept``, the best scores so far."""
        h = self.height
        level, at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of a range: its height from the top, and its number there
        cells = np.zeros((1, len(rows)), np.int64)
        bound = (self.maxima[cells] * weights).sum(axis=1)
        found: list[tuple[int, int]] = []
        scores = sorted(kept, reverse=True)
        worst = max(least, scores[k - 1] if len(scores) >= k else 0)
        while len(bound):
            on = bound >= worst
            if not on.all():
                level, at, cells, bound = level[on], at[on], cells[on], bound[on]
                if not len(bound):
                    break
            if len(bound) > AT_ONCE:
                top = np.argpartition(bound, len(bound) - AT_ONCE)[-AT_ONCE:]
            else:
                top = np.arange(len(bound))
            stay = np.ones(len(bound), bool)
            stay[top] = False
            whole = level[top] == h
            if whole.any():
                done = top[whole]
                found += zip(bound[done].tolist(), at[done].tolist(), strict=True)
                scores = sorted([*scores, *bound[done].tolist()], reverse=True)[:k]
                worst = max(least, scores[k - 1] if len(scores) >= k else 0)
            top = top[~whole]
            side = rows[None, :] >> (h - 1 - level[top])[:, None] & 1
            halves = [self.child(cells[top], 2 * side + right) for right in (0, 1)]
            level = np.concatenate([level[stay], level[top] + 1, level[top] + 1])
            at = np.concatenate([at[stay], 2 * at[top], 2 * at[top] + 1])
            cells = np.concatenate([cells[stay], *halves])
            bound = np.concatenate([bound[stay], *((self.maxima[c] * weights).sum(axis=1) for c in halves)])
        return [f for f in found if f[0] >= worst]


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def build(docs: DataFrame, shard_points: int = 1 << 20) -> DataFrame:
    """The index of ``docs`` (doc_id, text): one row per shard. Write it (``saved``) before searching it more than once."""
    n_docs, n_terms = totals(docs)

    def shard(ids: list, terms: dict[bytes, int], columns: list[np.ndarray], impacts: list[np.ndarray]) -> dict:
        words = sorted(terms)
        row_of = np.empty(len(words), np.int64)
        row_of[[terms[w] for w in words]] = np.arange(len(words))
        rows = row_of[np.concatenate(columns)]
        column = np.repeat(np.arange(len(ids)), [len(c) for c in columns])
        height = max(len(words) - 1, len(ids) - 1).bit_length()
        sizes, quadrants, less = Treap.build(rows, column, np.concatenate(impacts), height)
        known = np.array([i is not None for i in ids], np.int64)
        docs_ = np.stack([known, np.array([i or 0 for i in ids], np.int64)])
        return {"n_docs": len(ids), "terms": zstandard.compress(b" ".join(words)), "dfs": pack(np.bincount(rows).astype(np.int32)), "docs": pack(docs_), "height": height, "sizes": sizes, "quadrants": pack(quadrants), "maxima": pack(less.astype(np.int32))}

    kind = pa.schema([("n_docs", pa.int32()), ("terms", pa.binary()), ("dfs", pa.binary()), ("docs", pa.binary()), ("height", pa.int32()), ("sizes", pa.list_(pa.int32())), ("quadrants", pa.binary()), ("maxima", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, columns, impacts, points = [], {}, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                names, texts = (batch.column(i)[at : at + 64].to_pylist() for i in range(2))
                for name, value in zip(names, texts, strict=True):
                    words = terms_of(value)
                    if not words:
                        continue
                    place, tf = np.unique(np.fromiter((terms.setdefault(w, len(terms)) for w in words), np.int64, len(words)), return_counts=True)
                    seen, which = np.unique(tf, return_inverse=True)
                    ids.append(name)
                    columns.append(place)
                    impacts.append(np.array([impact(int(x), len(words), n_docs, n_terms) for x in seen], np.int64)[which])
                    points += len(place)
                    if points >= shard_points:
                        yield pa.RecordBatch.from_pylist([shard(ids, terms, columns, impacts)], kind)
                        ids, terms, columns, impacts, points = [], {}, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([shard(ids, terms, columns, impacts)], kind)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text"))
    return rows.sortWithinPartitions(F.asc_nulls_last("doc_id")).mapInArrow(made, INDEX)


def counted(index: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """Documents with each of the terms (by place; none where it is unknown). The driver gets one number per term."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = {t: r for r, t in enumerate(zstandard.decompress(batch.column(0)[i].as_py()).split(b" "))}
                dfs = unpack(batch.column(1)[i].as_py(), np.int32)
                for place, term in enumerate(sent.value):
                    if (row := rows.get(term)) is not None:
                        n[place] += dfs[row]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    sent.unpersist()
    return {r.term: r.df for r in rows}


def search_block(index: DataFrame, items: list[tuple], k: int, n_docs: int) -> DataFrame:
    """item (place in ``items``), doc_id and score: the best ``k`` of each task."""
    terms = sorted({t for _, value in items for t in terms_of(value)})
    df = counted(index, terms)
    known = [(t, weight(df[i], n_docs)) for i, t in enumerate(terms) if i in df]
    place = {t: i for i, (t, _) in enumerate(known)}
    asked = [sorted({place[t] for t in terms_of(value) if t in place}) for _, value in items]
    sent = index.sparkSession.sparkContext.broadcast(([t for t, _ in known], np.array([w for _, w in known], np.int64), [np.array(a, np.int64) for a in asked]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, asked = sent.value
        kept: list[list[tuple]] = [[] for _ in asked]  # (-score, no id, doc_id)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                names = zstandard.decompress(row["terms"]).split(b" ")
                at = {t: r for r, t in enumerate(names)}
                rows = np.array([at.get(t, -1) for t in terms], np.int64)
                tree = Treap.read(row["height"], row["sizes"], unpack(row["quadrants"], np.uint8), unpack(row["maxima"], np.int32))
                there, ids = unpack(row["docs"], np.int64).reshape(2, -1)
                before = (1 - int(there[0]), int(ids[0]))  # documents are in order
                for item, wanted in enumerate(asked):
                    mine = wanted[rows[wanted] >= 0]
                    if not len(mine):
                        continue
                    so_far = kept[item]
                    behind = len(so_far) == k and max(x[1:] for x in so_far) < before  # equal scores of this shard rank below
                    best = tree.best(rows[mine], weights[mine], k, [-x[0] for x in so_far], 1 - so_far[-1][0] if behind else 1)
                    new = [(-score, 1 - int(there[c]), int(ids[c])) for score, c in best]
                    kept[item] = sorted([*so_far, *new])[:k]
        out = [(item, None if none else doc, -score) for item, best in enumerate(kept) for score, none, doc in best]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents for each row of ``items`` (item_id, text)."""
    spark = index.sparkSession
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    size = items.agg(F.sum(F.octet_length(text()) + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(n_blocks):
        mine = items.select("item_id", text().alias("text")).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        held = [tuple(r) for r in mine.collect()]  # a block: bounded by block_bytes
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = search_block(index, held, k, n_docs).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(held)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        rows = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.union(rows)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` in an index of ``docs`` that is written first."""
    return search(saved(build(docs)), items, k)
