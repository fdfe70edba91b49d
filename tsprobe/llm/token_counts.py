"""Token counts: a broadcast table of frequent pre-token lengths, worker caches for the rest, no pre-token shuffle.

The first pass keeps, in each partition, a bounded summary of its most frequent pre-tokens (counters that are halved
away when full), which leaves the task as one packed row. Rows are added up in a tree, sixteen neighbours at a time, by the
number of their partition: no row is keyed by a pre-token, a task of the tree holds at most sixteen summaries, and the
driver gets the last one alone. The ``table_size`` most frequent pre-tokens with their lengths form the broadcast table,
at most ``table_size * (64 + 2)`` bytes. The second pass looks each pre-token up there, then in
the worker's cache, and encodes what neither has. The table only saves work: any table gives the same counts.

A null text counts as empty: no bytes, no tokens. Repeated rows and null ids are counted row by row; other columns are
not read. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import saved, text
from tsprobe.llm.pretokens import Cache, Encoder, pieces


SUMMARY = "part long, pieces string, n array<long>"


def packed(part: int, seen: Counter, size: int) -> pa.Table:
    """A summary as one row: its number, and the ``size`` most frequent pieces, a line each, with their counts."""
    kept = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]
    return pa.table({"part": pa.array([part], pa.int64()), "pieces": ["\n".join(k for k, _ in kept)], "n": pa.array([[n for _, n in kept]], pa.list_(pa.int64()))})


def unpacked(pieces_: str, n: list[int]) -> dict[str, int]:
    return dict(zip(pieces_.split("\n"), n, strict=True)) if n else {}


def frequent_pretokens(docs: DataFrame, table_size: int = 100_000, summary_size: int = 200_000, fan_in: int = 16) -> list[str]:
    """The most frequent pre-tokens, from bounded summaries of every partition; the longest has 63 bytes."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(pieces(value)[1:])
                if len(seen) > summary_size:
                    level = sorted(seen.values(), reverse=True)[summary_size // 2]
                    seen = Counter({k: n - level for k, n in seen.items() if n > level})
        kept = Counter({k: n for k, n in seen.items() if n > 1 and len(k.encode()) < 64 and "\n" not in k})
        yield from packed(TaskContext.get().partitionId(), kept, table_size).to_batches()

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for blob, n in zip(rows.column("pieces"), rows.column("n"), strict=True):
            for k, m in unpacked(blob.as_py(), n.as_py()).items():
                seen[k] += m
        return packed(key[0].as_py(), seen, table_size)

    found = saved(docs.select(text().alias("text")).mapInArrow(summaries, SUMMARY))
    last = found.agg(F.max("part")).first()[0]
    while last:  # the tree ends at number 0
        found = found.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(merged, SUMMARY)
        last //= fan_in
    row = found.first()
    return list(unpacked(row.pieces, row.n)) if row else []


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, ranks: str | None = None, pattern: str | None = None, table_size: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    encoder = Encoder(vocabulary, ranks, pattern)
    frequent = frequent_pretokens(docs, table_size)
    blob = "\n".join(frequent)
    lengths = bytes(min(255, len(encoder.ids(" " + p))) for p in frequent)
    shared = docs.sparkSession.sparkContext.broadcast((blob, lengths))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(shared, vocabulary, ranks, pattern)
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.to_pylist()
            n_bytes = [len(t.encode()) for t in texts]
            n_tokens = [sum(cache.all(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", text().alias("text")).mapInArrow(counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


CACHES: dict = {}


def worker_cache(shared, vocabulary: str, ranks: str | None, pattern: str | None) -> Cache:
    """One cache for each table and worker process."""
    key = (shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value), vocabulary)
    if key not in CACHES:
        CACHES.clear()
        blob, lengths = shared.value
        CACHES[key] = Cache(Encoder(vocabulary, ranks, pattern), len, dict(zip(blob.split("\n"), lengths, strict=True)) if lengths else {})
    return CACHES[key]
