"""I-Match fingerprints: distinct terms of a document-frequency band, hashed under several random sub-lexicons.

The lexicon is all words (in lower case) that ``least`` documents or more have, but no more than ``most_share`` of all;
that is a band of inverse document frequencies. A sub-lexicon takes each word of it with one of ten rates (1, 1/2, ...
1/512) by hashing; there are twelve of each rate, and those of one seed lie in each other. A document's fingerprint holds,
for each sub-lexicon, a 16-bit hash of the set of its distinct terms in it, or 0 if it has none; so it stays the same in most places under a small edit and in a few
under a large one. The likeness of two fingerprints is the share of equal places among those that are not 0 in both, over
the smallest sub-lexicons, from the lowest rate up until twelve such places are found. A document with fewer than
``fewest`` terms in the band, such as one of a large group of near copies, whose own words all are frequent, takes those
of its terms above the band that are least frequent as well, up to that number and ties. One without any term that
``least`` documents have has the hash of all its distinct terms (or of its text) instead; two such are alike only if equal.

Document frequencies are counted over all documents by blocks that ask buckets; nothing of them is broadcast. Blocks
are ranges of doc_id, so that each document meets the next one (descending doc_id, after the last the first) in its
block; the first document of a block is also sent to the block before.

A null text is empty. A null id comes last. Of rows with equal ids the lesser text comes first; a single document is its
own next. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import shuffle_partitions, text
from tsprobe.llm.exchange import ASKED, Vocabulary, answers, ask, reply_sums, strings

RATES, EACH, ENOUGH = 10, 12, 12
LAST = -(1 << 63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


SEEDS = mixed(np.arange(1, EACH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def places(terms: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the set of terms in each sub-lexicon, 0 where there are none; rates in rows, from 1 down.

    A term's rank under a seed, the leading zeros of its mixed hash, says to which of the seed's lexicons it belongs: to
    those of the rates down to 2^-rank. The hashes of a rank are summed, so that a set has one sum in whatever order,
    and the sums of a rate are those of all ranks from it on.
    """
    if not len(terms):
        return np.zeros(RATES * EACH, np.uint16)
    drawn = mixed(terms[None, :] ^ SEEDS)
    rank = np.minimum(64 - np.frexp(drawn.astype(np.float64))[1], RATES - 1).clip(0)
    cell = (rank * EACH + np.arange(EACH)[:, None]).ravel()
    sums, held = np.zeros(RATES * EACH, np.uint64), np.bincount(cell, minlength=RATES * EACH)
    np.add.at(sums, cell, np.tile(mixed(terms + np.uint64(0x632BE59BD9B4E019)), EACH))
    up = lambda x: np.cumsum(x.reshape(RATES, EACH)[::-1], axis=0, dtype=x.dtype)[::-1].ravel()
    sums, held = up(sums), up(held)
    short = (mixed(sums ^ (held.astype(np.uint64) << np.uint64(40))) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return np.where(held > 0, short, np.uint16(0))


def likeness(a: str, b: str) -> float:
    """Share of equal places among those that either has, in the smallest sub-lexicons; 1 or 0 for whole hashes."""
    if a[0] != "f" or b[0] != "f":
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v[1:]), ">u2") for v in (a, b))
    some = ((x != 0) | (y != 0)).reshape(RATES, EACH)
    same = (x == y).reshape(RATES, EACH) & some
    held = np.cumsum(some.sum(axis=1)[::-1])
    used = min(int(np.searchsorted(held, ENOUGH)), RATES - 1)
    return float(same[RATES - 1 - used :].sum() / held[used])


def terms_of(value: str) -> set[bytes]:
    return set(value.encode().lower().split())


def edited(value: str, follower: str) -> str:
    """The last half of the text replaced by as much of the next one's beginning."""
    half = len(value) // 2
    return value[: len(value) - half] + follower[:half]


def ordered(block: pa.Table) -> tuple[list, list[str], str]:
    """A block's ids and texts in order, and the text that comes after its last."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = (unpack(t).decode() for t in strings(block, "text"))
    rows = sorted(zip(block.column("id").to_pylist(), block.column("extra").to_pylist(), texts, strict=True), key=lambda r: (-r[0], r[2]))
    own = [r for r in rows if not r[1]]
    return [r[0] for r in own], [r[2] for r in own], next(r[2] for r in rows if r[1])


def range_blocks(docs: DataFrame, block_bytes: int = 16 << 20) -> tuple[DataFrame, int, int]:
    """Blocks of neighbouring ids with the text after each one's last, their number, and the number of documents.

    Texts are dealt compressed, as they are most of what moves.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id")
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(text()))).first()
    n = max(shuffle_partitions(spark), -(-(size or 0) // block_bytes))
    cuts = docs.select(key).agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def find(batches):
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = pa.array([pack(t.encode()) for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, part.column(0).to_numpy()), pa.int32()), part.column(0), texts], names=["block", "id", "text"])

    rows = docs.select(key, text().alias("text")).mapInArrow(find, "block int, id long, text binary")
    ids = docs.select(key, F.lit("").alias("text")).mapInArrow(find, "block int, id long, text binary")
    tops = [(r.block, r.id) for r in ids.groupBy("block").agg(F.max("id").alias("id")).orderBy("block").collect()]  # one row per block
    sent = [(tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    heads = spark.createDataFrame(sent, "id long, sent_to int")
    extra = rows.join(F.broadcast(heads), "id").select(F.col("sent_to").alias("block"), "id", "text", F.lit(True).alias("extra"))
    return rows.select("block", "id", "text", F.lit(False).alias("extra")).union(extra).repartition(n, "block"), n, count


def fingerprints(docs: DataFrame, least: int = 2, most_share: float = 0.05, fewest: int = 32, block_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprint of each document and of its edited text, and their likenesses."""
    blocks, n, count = range_blocks(docs, block_bytes)
    most = max(least, most_share * count)

    def asked(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        seen, counts = Vocabulary(), []
        _, texts, after = ordered(block)
        for value in texts:
            counts.append(seen.of(list(terms_of(value))))
        known = np.bincount(np.concatenate(counts), minlength=len(seen.places)) if counts else np.zeros(0, np.int64)
        for value, follower in zip(texts, [*texts[1:], after], strict=True):
            seen.of(list(terms_of(edited(value, follower))))
        seen.of(list(terms_of(after)))
        numbers = np.zeros(len(seen.places), np.uint32)
        numbers[: len(known)] = known
        hashes, first = np.unique(seen.hashes(), return_index=True)
        return ask(key[0].as_py(), hashes, numbers[first], n)

    def finished(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, after = ordered(block)
        followers = [*texts[1:], after]
        seen = Vocabulary()
        sets = [seen.of(list(terms_of(t))) for t in texts]
        changed = [edited(t, f) for t, f in zip(texts, followers, strict=True)]
        others = [seen.of(list(terms_of(t))) for t in [*changed, after]]
        hashes = seen.hashes()
        distinct, where = np.unique(hashes, return_inverse=True)
        found = answers(distinct, replies, n, np.int64)[where]

        def mark(terms: np.ndarray, value: str) -> str:
            n_docs = found[terms]
            some = terms[n_docs >= least]
            n_docs = n_docs[n_docs >= least]
            upper = max(most, np.partition(n_docs, fewest - 1)[fewest - 1]) if len(n_docs) >= fewest else np.inf
            kept = hashes[some[n_docs <= upper]]
            if len(kept):
                return "f" + places(kept).astype(">u2").tobytes().hex()
            every = np.sort(hashes[terms]).tobytes() if len(terms) else value.encode()
            return "w" + hashlib.blake2b(every, digest_size=16).hexdigest()

        own = [mark(s, t) for s, t in zip(sets, texts, strict=True)]
        new = [mark(s, t) for s, t in zip(others, changed, strict=False)]
        behind = [*own[1:], mark(others[-1], after)]
        return pa.table({
            "doc_id": pa.array([None if i == LAST else i for i in ids], pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), "fingerprint": pa.array(own, pa.string()), "edited_fingerprint": pa.array(new, pa.string()),
            "near_edited": pa.array(list(map(likeness, own, new)), pa.float64()), "near_next": pa.array(list(map(likeness, own, behind)), pa.float64()),
        })

    if not count:
        return docs.sparkSession.createDataFrame([], OUT)
    replies = reply_sums(blocks.groupBy("block").applyInArrow(asked, ASKED))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finished, OUT)



