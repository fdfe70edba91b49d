"""Probabilistic suffix tree over words: contexts of none, one or two words, kept by a divergence test.

Training counts cover all training documents and all their words, pairs and triples of words; none is too rare. Blocks of
documents are encoded once, ask buckets for the counts of what they hold, and add up for each context what their own
training tokens gain by it; buckets of contexts sum the gains and the distinct continuations and tell the blocks which
contexts are kept. So nothing is broadcast and the driver holds two numbers.

The root is the add-one distribution of words. A deeper state gives a continuation that it has met twice or more its count;
what it met once, plus one, goes to the distribution of the state one word shorter (singletons stand for what was not
met), so that each state's distribution sums to one. A context is kept if its divergence from its shorter suffix, times its
count, exceeds the cost of describing it (half the log of the corpus for each listed continuation and one more); suffixes
of kept contexts are kept. A token is scored in the longest kept suffix of the words before it. Triples are asked about only
where the counts of a pair and of its last word leave it possible that the test keeps the pair (``possible``); the other
pairs are known to fail it.

Tokens: words of the text with A-Z in lower case, then one end. A null text is an end alone; a null id is no held-out
document. Repeated rows count as often as they occur. Tokens, pairs and triples are told apart by 64-bit hashes. Other
columns are not read. A document is one unit of work, and a block has at least one. Blocks are cut in the order of the rows:
a part of ``docs`` that is read again after a loss has to come in the same order, as tables do; else answers don't fit, which
is noticed (and raised) only where the number of questions has changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import saved, shuffle_partitions, text
from tsprobe.llm.exchange import Vocabulary, strings

END = b" "  # no word has a space
SHIFT = np.uint64(21)
MASK = np.uint64((1 << 21) - 1)
#: Buckets 0..n-1 count words, the next n pairs, then triples; then those that follow a word or a pair once; the next n
#: judge pairs as contexts, the last n words.
WORDS, PAIRS, TRIPLES, WORD_SINGLES, PAIR_SINGLES, PAIR_CONTEXTS, WORD_CONTEXTS = range(7)
ENCODED = "block long, trained long, doc_ids array<long>, held_out array<boolean>, sizes binary, tokens binary, hashes binary"
ASKED = "bucket int, block long, keys binary, numbers binary"
GAINS = "bucket int, block long, keys binary, gains binary, numbers binary, owned binary, suffixes binary"
ANSWER = "block long, bucket int, answer binary"
JUDGED = "block long, bucket int, answer binary, keys binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Tree:
    """Sorted word hashes; for each kept context its log10 of what the shorter state is multiplied by; listed log10s."""

    words: np.ndarray
    back1: np.ndarray  # by word; nan where the word is no kept context
    pairs: np.ndarray
    pair_logs: np.ndarray
    contexts: np.ndarray  # kept pairs
    back2: np.ndarray
    triples: np.ndarray
    triple_logs: np.ndarray


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted table, and which do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def tokens_of(value: str) -> list[bytes]:
    return [*value.encode().lower().split(), END]


def divergence_test(counts: np.ndarray, own: np.ndarray, shorter: np.ndarray, total: np.ndarray, group: np.ndarray, groups: int, cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts to keep, the share of a context that goes to its shorter suffix, and the listed probabilities.

    counts, shorter (probability in the shorter state) and group (the context) belong to the listed continuations; total
    is the count of each context.
    """
    listed = np.bincount(group, weights=counts, minlength=groups)
    share = (total - listed + 1) / (total + 1)
    p = counts / (total[group] + 1) + share[group] * shorter
    gain = np.bincount(group, weights=counts * np.log(p / shorter), minlength=groups) + (total - listed) * np.log(share)
    return gain > cost * (np.bincount(group, minlength=groups) + 1), share, p


def grow(words: np.ndarray, n_words: np.ndarray, pairs: np.ndarray, n_pairs: np.ndarray, triples: np.ndarray, n_triples: np.ndarray, tokens: int, distinct: int) -> Tree:
    """The tree of counts (sorted keys) that one place can hold; ``score`` gives the same without holding it."""
    cost = 0.5 * np.log(max(tokens, 2))
    root = (n_words + 1) / (tokens + distinct + 1)
    first, second = (pairs >> SHIFT).astype(np.int64), (pairs & MASK).astype(np.int64)
    keep1, share1, p1 = divergence_test(n_pairs.astype(float), n_pairs, root[second], n_words.astype(float), first, len(words), cost)
    outer, inner = triples >> SHIFT, triples & np.uint64((1 << 42) - 1)
    at, _ = find(pairs, outer)
    suffix, _ = find(pairs, inner)
    keep2, share2, p2 = divergence_test(n_triples.astype(float), n_triples, p1[suffix] if len(pairs) else np.zeros(0), n_pairs.astype(float), at, len(pairs), cost)
    keep1[second[keep2]] = True
    listed = keep1[first]
    return Tree(
        words, np.where(keep1, np.log10(share1), np.nan), pairs[listed], np.log10(p1[listed]), pairs[keep2], np.log10(share2[keep2]),
        triples[keep2[at]] if len(triples) else triples, np.log10(p2[keep2[at]]) if len(triples) else p2,
    )


def score_tokens(tree: Tree, ids: np.ndarray, doc: np.ndarray, root_logs: np.ndarray) -> np.ndarray:
    """log10 probability of each token in the longest kept suffix of the words before it in its document, by a whole tree."""
    out = root_logs.copy()
    n = len(ids)
    if n < 2 or not len(tree.words):
        return out
    back = np.append(tree.back1, np.nan)
    before = np.full(n, len(tree.words), np.uint64)
    before[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], np.uint64(len(tree.words)))
    in1 = ~np.isnan(back[before.astype(np.int64)])
    out[in1] += back[before[in1].astype(np.int64)]
    pair = (before << SHIFT) | ids
    at, there = find(tree.pairs, pair)
    there &= in1
    out[there] = tree.pair_logs[at[there]]
    if len(tree.contexts) and n > 2:
        two = np.full(n, len(tree.words), np.uint64)
        two[2:] = np.where(doc[2:] == doc[:-2], ids[:-2], np.uint64(len(tree.words)))
        at, in2 = find(tree.contexts, (two << SHIFT) | before)
        out[in2] += tree.back2[at[in2]]
        at, there = find(tree.triples, (two << (SHIFT * np.uint64(2))) | pair)
        there &= in2
        out[there] = tree.triple_logs[at[there]]
    return out


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the largest needs, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_gains(gains: np.ndarray) -> bytes:
    """Signed numbers in whole steps of 2**-20, so that their sums don't depend on an order."""
    steps = np.rint(gains * (1 << 20)).astype(np.int64)
    return pack(((steps << 1) ^ (steps >> 63)).view(np.uint64))


def unpack_gains(data: bytes) -> np.ndarray:
    steps = unpack(data)
    return (steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in this order."""
    out = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and where each key is among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], where


def cuts(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Buckets are ranges of keys: those that sorted keys reach, each with its first key and the one after its last."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({f: pa.array(c, kinds[k]) for c, (f, k) in zip(columns, fields, strict=True)})


def ask(kind: int, block: int, keys: np.ndarray, numbers: np.ndarray, n: int) -> list[tuple]:
    """Rows for the buckets of sorted keys."""
    return [(kind * n + b, block, pack_keys(keys[i:j]), pack(numbers[i:j])) for b, i, j in cuts(keys, n)]


def answer(rows: pa.Table, n: int) -> pa.Table:
    """To each block twice the sum of a key's numbers; plus one for a single block, which counts the key for all.

    Buckets of words say in a row for no block how many words training has.
    """
    each = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
    keys, where = distinct(np.concatenate(each))
    numbers = np.concatenate([unpack(x) for x in rows.column("numbers").to_pylist()])
    sums = np.zeros(len(keys), np.uint64)
    np.add.at(sums, where, numbers)
    some = np.flatnonzero(numbers)[::-1]
    first = np.full(len(keys), -1)
    first[where[some]] = some  # the last to be put there, which is the first of its key
    out = sums[where] * np.uint64(2)
    out[first[first >= 0]] += np.uint64(1)
    ends = np.cumsum([len(k) for k in each])
    bucket = rows.column("bucket")[0].as_py()
    data = [(block, bucket, pack(out[e - len(k) : e])) for block, k, e in zip(rows.column("block").to_pylist(), each, ends, strict=True)]
    return table_of([*data, *[(-1, bucket, pack(np.array([np.count_nonzero(sums)])))] * (bucket < n)], ANSWER)


def possible(count: np.ndarray, shorter: np.ndarray | float, cost: float, single: np.ndarray | float = 0) -> np.ndarray:
    """Whether a context that occurs ``count`` times, its shorter suffix ``shorter`` times, can pass the divergence test.

    Listed continuations are at least ``n / (shorter + 1)`` likely in the shorter state if they follow the context n times, so
    they gain ``log((shorter + single + 2) / (count + 1))`` at most; those met a ``single`` time lose as the test says. By
    the concavity of the logarithm the sum is greatest if none is single. The context pays for one continuation at least.
    """
    count, shorter = np.asarray(count, float), np.asarray(shorter, float)
    most = (count - single) * np.log((shorter + single + 2) / (count + 1)) + single * np.log((single + 1) / (count + 1))
    return most > 2 * cost * (1 - 1e-9)


class Block:
    """An encoded block: its tokens, which of them train, its distinct words and pairs."""

    def __init__(self, row: dict):
        self.row, self.number = row, row["block"]
        self.tokens, self.hashes, self.sizes = unpack(row["tokens"]).astype(np.int32), np.frombuffer(row["hashes"], np.uint64), unpack(row["sizes"]).astype(np.int64)
        self.held = np.array(row["held_out"], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.order = np.argsort(self.hashes)
        inside = np.ones(len(self.tokens), bool)  # tokens that have one before them in their document
        inside[np.cumsum(self.sizes) - self.sizes] = False
        self.at = np.flatnonzero(inside)
        h = self.hashes[self.tokens]
        self.pairs, self.pair = distinct(joined(h[self.at - 1], h[self.at]))
        self.before = self.tokens[self.at - 1]

    def counted(self, heard: dict[int, bytes], n: int) -> None:
        """Take the answers about words and pairs."""
        self.words = np.zeros(len(self.hashes), np.int64)
        self.words[self.order] = replied(heard, WORDS, n, len(self.hashes)) >> np.uint64(1)
        numbers = replied(heard, PAIRS, n, len(self.pairs))
        self.pair_counts, self.pair_owned = (numbers >> np.uint64(1)).astype(np.int64), (numbers & np.uint64(1)).astype(bool)
        some = np.zeros(len(self.hashes), bool)
        some[self.before] = True
        some &= self.words > 1  # a word that occurs once has no listed continuation and gains nothing
        self.firsts = self.order[some[self.order]]  # words that can be contexts, in order of their hashes

    def extended(self, cost: float) -> None:
        """Tokens after pairs that can be contexts: their places in ``at``, the pairs, and the distinct triples to ask about.

        A triple whose last two words occur together once at most occurs once at most itself: nobody has to be asked.
        """
        third = np.flatnonzero(self.at[1:] == self.at[:-1] + 1) + 1
        context = self.pair[third - 1]
        some = possible(self.pair_counts[context], self.words[self.before[third]], cost)
        self.third, self.context = third[some], context[some]
        self.open = self.pair_counts[self.pair[self.third]] > 1
        self.triples, self.triple = distinct(joined(self.pairs[self.context[self.open]], self.hashes[self.tokens[self.at[self.third[self.open]]]]))
        some = np.zeros(len(self.pairs), bool)
        some[self.context] = True
        self.contexts = np.flatnonzero(some)

    def tripled(self, heard: dict[int, bytes], n: int) -> None:
        """Take the answers about triples."""
        numbers = replied(heard, TRIPLES, n, len(self.triples))
        self.triple_counts, self.triple_owned = (numbers >> np.uint64(1)).astype(np.int64), (numbers & np.uint64(1)).astype(bool)
        self.context_of = np.zeros(len(self.triples), np.int32)
        self.context_of[self.triple] = self.context[self.open]

    def continuations(self, kept: np.ndarray, owned: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """For each of ``size`` contexts, the continuations of a kind that this block counts for all."""
        return np.bincount(of[kept & owned], minlength=size)

    def word_of(self, place: int) -> np.ndarray:
        """The first word of each pair, or the second."""
        out = np.zeros(len(self.pairs), np.int32)
        out[self.pair] = self.tokens[self.at] if place else self.before
        return out

    def open_contexts(self, heard: dict[int, bytes], n: int, total: int, cost: float) -> None:
        """Take the answers about singletons: the words and pairs that can still be kept, in the order of their keys.

        A word can be kept for its own gain, or as the end of a pair if it is frequent enough for any pair to pass: the bound
        of a pair is at most ``(shorter + 2) / e`` for all counts.
        """
        self.single, self.pair_single = np.zeros(len(self.hashes)), np.zeros(len(self.pairs))
        self.single[self.firsts] = replied(heard, WORD_SINGLES, n, len(self.firsts)) >> np.uint64(1)
        self.pair_single[self.contexts] = replied(heard, PAIR_SINGLES, n, len(self.contexts)) >> np.uint64(1)
        count = self.words[self.firsts]
        some = possible(count, float(total), cost, self.single[self.firsts]) | ((count + 2) / np.e > 2 * cost * (1 - 1e-9))
        self.open_words = self.firsts[some]
        some = possible(self.pair_counts[self.contexts], self.words[self.word_of(1)[self.contexts]], cost, self.pair_single[self.contexts])
        self.open_pairs = self.contexts[some]

    def chances(self, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of all tokens after none, of those at ``at`` after one word, and of those at ``third`` after two."""
        single, pair_single = self.single, self.pair_single
        root = ((self.words + 1) / total)[self.tokens]
        listed = np.where(self.pair_counts > 1, self.pair_counts, 0)[self.pair]
        one = (listed + (single[self.before] + 1) * root[self.at]) / (self.words[self.before] + 1)
        listed = np.zeros(len(self.third))
        listed[self.open] = np.where(self.triple_counts > 1, self.triple_counts, 0)[self.triple]
        return root, one, (listed + (pair_single[self.context] + 1) * one[self.third]) / (self.pair_counts[self.context] + 1)


def replied(heard: dict[int, bytes], kind: int, n: int, size: int) -> np.ndarray:
    """The answers of a kind of buckets, in the order of the keys."""
    mine = [unpack(heard[b]) for b in sorted(heard) if kind * n <= b < (kind + 1) * n]
    out = np.concatenate([np.zeros(0, np.uint64), *mine])
    if len(out) != size:
        raise ValueError("a block has changed since it asked")
    return out


def flags(heard: dict[int, bytes], kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """The answers yes or no about sorted keys."""
    out = np.zeros(len(keys), bool)
    for b, i, j in cuts(keys, n):
        out[i:j] = np.unpackbits(np.frombuffer(heard[kind * n + b], np.uint8), count=j - i)
    return out


def heard_of(replies: pa.Table) -> dict[int, bytes]:
    return dict(zip(replies.column("bucket").to_pylist(), replies.column("answer").to_pylist(), strict=True))


def encode(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``block_bytes`` of text, in the order of the rows, with numbered words and the words' hashes."""
    part, n = TaskContext.get().partitionId(), 0
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def made() -> pa.RecordBatch:
        sizes = np.array([len(x) for x in each], np.int64)
        trained = int(sizes[~np.array(held, bool)].sum())
        row = ((part << 32) + n, trained, ids, held, pack(sizes), pack(np.concatenate(each)), seen.hashes().tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    seen, each, ids, held, size = Vocabulary(), [], [], [], 0
    for batch in batches:
        for i, value in enumerate(strings(pa.Table.from_batches([batch]), "text")):
            each.append(seen.of(tokens_of(value)).astype(np.int32))
            ids.append(batch.column("doc_id")[i].as_py())
            held.append(batch.column("held_out")[i].as_py())
            size += len(value)
            if size >= block_bytes:
                yield made()
                n += 1
                seen, each, ids, held, size = Vocabulary(), [], [], [], 0
    if each:
        yield made()


def score(docs: DataFrame, fold: int = 7, held: int = 2, block_bytes: int = 16 << 20) -> DataFrame:
    """Base and tree scores of all documents; those whose crc32(doc_id) mod ``fold`` is ``held`` are not learnt from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // block_bytes))
    # several passes meet the answers in it; a lost part is encoded again
    blocks = rows.mapInArrow(lambda batches: encode(batches, block_bytes), ENCODED).repartition(n, "block").persist(StorageLevel.DISK_ONLY)
    trained = blocks.agg(F.sum("trained")).first()[0] or 0
    cost = 0.5 * float(np.log(max(trained, 2)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine = Block(batch.slice(i, 1).to_pylist()[0])
                words = np.bincount(mine.tokens[mine.train], minlength=len(mine.hashes))
                pairs = np.bincount(mine.pair[mine.train[mine.at]], minlength=len(mine.pairs))
                yield from table_of(ask(WORDS, mine.number, mine.hashes[mine.order], words[mine.order], n) + ask(PAIRS, mine.number, mine.pairs, pairs, n), ASKED).to_batches()

    def answered(rows: pa.Table) -> pa.Table:
        return answer(rows, n)

    counts = saved(blocks.mapInArrow(asked, ASKED).groupBy("bucket").applyInArrow(answered, ANSWER))
    vocabulary = sum(int(unpack(r.answer)[0]) for r in counts.where("block = -1").select("answer").toLocalIterator())
    counts = counts.where("block >= 0")

    def ask_triples(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        mine = Block(block.to_pylist()[0])
        mine.counted(heard_of(replies), n)
        mine.extended(cost)
        numbers = np.bincount(mine.triple[mine.train[mine.at[mine.third[mine.open]]]], minlength=len(mine.triples))
        once = mine.continuations(mine.pair_counts == 1, mine.pair_owned, mine.word_of(0), len(mine.hashes))
        return table_of(ask(TRIPLES, mine.number, mine.triples, numbers, n) + ask(WORD_SINGLES, mine.number, mine.hashes[mine.firsts], once[mine.firsts], n), ASKED)

    counts = counts.unionByName(saved(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(ask_triples, ASKED).groupBy("bucket").applyInArrow(answered, ANSWER)))

    def ask_singles(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        mine, heard = Block(block.to_pylist()[0]), heard_of(replies)
        mine.counted(heard, n)
        mine.extended(cost)
        mine.tripled(heard, n)
        once = mine.continuations(mine.triple_counts == 1, mine.triple_owned, mine.context_of, len(mine.pairs))
        once += np.bincount(mine.context[~mine.open & mine.train[mine.at[mine.third]]], minlength=len(once))
        return table_of(ask(PAIR_SINGLES, mine.number, mine.pairs[mine.contexts], once[mine.contexts], n), ASKED)

    counts = counts.unionByName(saved(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(ask_singles, ASKED).groupBy("bucket").applyInArrow(answered, ANSWER)))

    def ask_contexts(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        """What the block's training tokens gain by each context, and how many listed continuations it counts."""
        mine, heard = Block(block.to_pylist()[0]), heard_of(replies)
        mine.counted(heard, n)
        mine.extended(cost)
        mine.tripled(heard, n)
        mine.open_contexts(heard, n, trained + vocabulary + 1, cost)
        root, one, two = mine.chances(trained + vocabulary + 1)
        learnt = mine.train[mine.at]
        gains = np.bincount(mine.before, np.where(learnt, np.log(one / root[mine.at]), 0), len(mine.hashes))[mine.open_words]
        several = mine.continuations(mine.pair_counts > 1, mine.pair_owned, mine.word_of(0), len(mine.hashes))[mine.open_words]
        keys = mine.hashes[mine.open_words]
        rows = [(WORD_CONTEXTS * n + b, mine.number, pack_keys(keys[i:j]), pack_gains(gains[i:j]), pack(several[i:j]), b"", b"") for b, i, j in cuts(keys, n)]
        gains = np.bincount(mine.context, np.where(learnt[mine.third], np.log(two / one[mine.third]), 0), len(mine.pairs))[mine.open_pairs]
        several = mine.continuations(mine.triple_counts > 1, mine.triple_owned, mine.context_of, len(mine.pairs))[mine.open_pairs]
        keys, owned, last = mine.pairs[mine.open_pairs], mine.pair_owned[mine.open_pairs], mine.hashes[mine.word_of(1)[mine.open_pairs]]
        for b, i, j in cuts(keys, n):
            rows.append((PAIR_CONTEXTS * n + b, mine.number, pack_keys(keys[i:j]), pack_gains(gains[i:j]), pack(several[i:j]), np.packbits(owned[i:j]).tobytes(), last[i:j][owned[i:j]].tobytes()))
        return table_of(rows, GAINS)

    def judge(rows: pa.Table) -> pa.Table:
        """Which contexts pass the test; rows for no block name the last words of kept pairs, which are kept too."""
        each = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
        keys, where = distinct(np.concatenate(each))
        gains = np.zeros(len(keys), np.int64)
        np.add.at(gains, where, np.concatenate([unpack_gains(x) for x in rows.column("gains").to_pylist()]))
        several = np.bincount(where, np.concatenate([unpack(x) for x in rows.column("numbers").to_pylist()]), len(keys))
        keep = (gains / (1 << 20) > cost * (several + 1))[where]
        ends = np.cumsum([len(k) for k in each])
        bucket = rows.column("bucket")[0].as_py()
        words = bucket >= WORD_CONTEXTS * n
        out, forced = [], [np.zeros(0, np.uint64)]
        for block, k, e, sent, owned, last in zip(rows.column("block").to_pylist(), each, ends, *(rows.column(c).to_pylist() for c in ("keys", "owned", "suffixes")), strict=True):
            mine = keep[e - len(k) : e]
            out.append((block, bucket, np.packbits(mine).tobytes(), sent if words else None))
            if not words:
                own = np.unpackbits(np.frombuffer(owned, np.uint8), count=len(k)).astype(bool)
                forced.append(np.frombuffer(last, np.uint64)[mine[own]])
        forced = np.unique(np.concatenate(forced))
        out += [(-1, WORD_CONTEXTS * n + b, b"", pack_keys(forced[i:j])) for b, i, j in cuts(forced, n)]
        return table_of(out, JUDGED)

    def keep_suffixes(rows: pa.Table) -> pa.Table:
        """Answers about words as contexts: kept by the test or with a pair."""
        data = list(zip(*(rows.column(c).to_pylist() for c in ("block", "bucket", "answer", "keys")), strict=True))
        forced = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(k) for block, _, _, k in data if block < 0)])
        out = []
        for block, bucket, bits, k in data:
            if block >= 0:
                keys = unpack_keys(k)
                keep = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys)).astype(bool)
                out.append((block, bucket, np.packbits(keep | np.isin(keys, forced)).tobytes()))
        return table_of(out, ANSWER)

    judged = saved(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(ask_contexts, GAINS).groupBy("bucket").applyInArrow(judge, JUDGED))
    pairs_kept = judged.where(F.col("bucket") < WORD_CONTEXTS * n).select("block", "bucket", "answer")
    words_kept = judged.where(F.col("bucket") >= WORD_CONTEXTS * n).groupBy("bucket").applyInArrow(keep_suffixes, ANSWER)

    def finished(key: tuple[pa.Scalar, ...], block: pa.Table, replies: pa.Table) -> pa.Table:
        mine, heard = Block(block.to_pylist()[0]), heard_of(replies)
        mine.counted(heard, n)
        mine.extended(cost)
        mine.tripled(heard, n)
        mine.open_contexts(heard, n, trained + vocabulary + 1, cost)
        root, one, two = mine.chances(trained + vocabulary + 1)
        kept, kept_pairs = np.zeros(len(mine.hashes), bool), np.zeros(len(mine.pairs), bool)
        kept[mine.open_words] = flags(heard, WORD_CONTEXTS, mine.hashes[mine.open_words], n)
        kept_pairs[mine.open_pairs] = flags(heard, PAIR_CONTEXTS, mine.pairs[mine.open_pairs], n)
        base = np.log10(root)
        logs = base.copy()
        here = kept[mine.before]
        logs[mine.at[here]] = np.log10(one[here])
        here = kept_pairs[mine.context]
        logs[mine.at[mine.third[here]]] = np.log10(two[here])
        rows = len(mine.sizes)
        doc = np.repeat(np.arange(rows, dtype=np.int32), mine.sizes)
        return pa.table({
            "doc_id": pa.array(mine.row["doc_ids"], pa.int64()), "held_out": pa.array(mine.held), "n_tokens": pa.array(mine.sizes),
            "n_known": pa.array(np.bincount(doc, weights=mine.words[mine.tokens] > 0, minlength=rows).astype(np.int64)), "train_tokens": pa.array([trained] * rows, pa.int64()),
            "base_score": pa.array(np.bincount(doc, weights=base, minlength=rows)), "score": pa.array(np.bincount(doc, weights=logs, minlength=rows)),
        })

    told = counts.unionByName(pairs_kept).unionByName(words_kept)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finished, OUT)
