"""Mixing sources to target weights: exact block quotas, split among shards by a multivariate-hypergeometric tree.

A source is the stream of its documents' words, in an order given by hashing, cut into blocks of equal size (the last
may be shorter): about 1/1024 of a small source, 4,096 words of a large one, so that rounding a target to whole blocks
changes it by a thousandth at most. The quota of a source is its target in blocks; a quota above the number of blocks
takes every block once in each full pass and the rest from a last one. Draws are numbered along a permutation of the
blocks. The quotas of all sources are then split in halves again and again: how many of each source's draws go to the
left half of the shards is a multivariate-hypergeometric draw, so the shards hold what dealing out one shuffled deck
would give them, and their draws are disjoint ranges of the numbering. A shard shuffles its own draws by hash.

The driver holds one number per source and one per source and shard. Everything about documents stays in the cluster: a
document's place in its source is a sliced running sum, its blocks and draws follow from arithmetic.

Sizes count words; a null text has none. A null source is a source of its own and comes last. Documents without words
are part of no block: they take 0 and appear in no shard. Repeated rows and null ids are documents of their own. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import count_words, running, saved, shuffle_partitions, text
from tsprobe.operators.ordering import positions, running_sums
from tsprobe.session import scratch_dir


@dataclass(frozen=True)
class Source:
    """One source of a mix: its words, its target, and its blocks."""

    name: str | None
    size: int
    target: float
    block: int
    blocks: int
    quota: int
    step: int
    shift: int


def share_out(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """All sizes' sum shared by weight; a share stops at ``most`` times its size and the excess is shared again."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in full or free:
            targets[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        free -= full
    return targets


def sources_of(sized: DataFrame, most: int, seed: int) -> list[Source]:
    """Sources in code point order with null last; weights 1, 2, 3, repeating."""
    found = [(r.source, r.size) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    targets = share_out([n for _, n in found], [1.0 + i % 3 for i in range(len(found))], most)
    out = []
    for i, ((name, size), target) in enumerate(zip(found, targets, strict=True)):
        block = max(1, min(4096, -(-size // 1024)))
        blocks = -(-size // block)
        rng = np.random.default_rng([seed, i])
        step = int(rng.integers(1, max(2, min(blocks, 1 << 30))))
        while blocks and math.gcd(step, blocks) > 1:
            step += 1
        out.append(Source(name, size, target, block, blocks, round(target / size * blocks) if size else 0, step, int(rng.integers(0, max(1, blocks)))))
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (column) for each shard (row); the splitting tree halves the shards at each level."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(first: int, after: int, mine: np.ndarray) -> None:
        if after - first == 1 or not mine.sum():
            out[first] = mine
            return
        middle, total = (first + after) // 2, int(mine.sum())
        rng = np.random.default_rng([seed, first, after])
        take = total * (middle - first) // (after - first)
        left, rest, lacking = np.zeros_like(mine), total, take
        for i, n in enumerate(mine.tolist()):  # one source after the other: hypergeometric given those before
            rest -= n
            left[i] = lacking - rest if rest + n == lacking else hypergeometric(rng, n, rest, lacking)
            lacking -= int(left[i])
        split(first, middle, left)
        split(middle, after, mine - left)

    split(0, shards, np.array(quotas, dtype=np.int64))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """numpy's draw below its limit of 1e9; above it the normal limit, clipped to what is possible."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mean = drawn * good / total
    deviation = math.sqrt(mean * bad / total * (total - drawn) / max(1, total - 1))
    return int(min(max(round(rng.normal(mean, deviation)), drawn - bad, 0), good, drawn))


def by_source(sources: list[Source], value) -> Column:
    """The value of the row's source, as a literal map; null has a key of its own."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    pairs = [x for s in sources for x in (F.lit("n" if s.name is None else f"s{s.name}"), value(s))]
    return F.element_at(F.create_map(*pairs), key)


def mix(docs: DataFrame, most: int = 3, seed: int = 7) -> tuple[DataFrame, list[Source]]:
    """Documents with same (a hash of the text), size, source_size, target, place, taken and ``draws``: block, pass, number, start and n words.

    ``start`` is the first of the document's words in the drawn block, ``number`` the draw's place among its source's.
    """
    sized = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), count_words(text()).alias("size"), F.xxhash64(text()).alias("same")))
    sources = sources_of(sized, most, seed)
    placed = running(sized, ["source"], ["doc_id", "size", "same"], F.col("size"), "place")
    if not sources:
        sources = [Source(None, 0, 0.0, 1, 0, 0, 1, 0)]
    kept = placed
    for name, value in (("source_size", lambda s: F.lit(s.size).cast("long")), ("target", lambda s: F.lit(float(s.target))), ("_block", lambda s: F.lit(s.block).cast("long")), ("_blocks", lambda s: F.lit(s.blocks).cast("long")), ("_quota", lambda s: F.lit(s.quota).cast("long")), ("_step", lambda s: F.lit(s.step).cast("long")), ("_shift", lambda s: F.lit(s.shift).cast("long"))):
        kept = kept.withColumn(name, by_source(sources, value))
    size, place, block, n = F.col("size"), F.col("place"), F.col("_block"), F.col("_blocks")

    def drawn(b: Column) -> Column:
        begin, end = F.greatest(place, b * block), F.least(place + size, (b + 1) * block)
        passes = F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))
        made = F.transform(passes, lambda p: F.struct(
            b.alias("block"), p.alias("pass"), (p * n + F.pmod(b * F.col("_step") + F.col("_shift") + p, n)).alias("number"),
            (begin - place).alias("start"), (end - begin).alias("n"),
        ))
        return F.filter(made, lambda x: x["number"] < F.col("_quota"))

    covered = F.when(size > 0, F.sequence(F.floor(place / block), F.floor((place + size - 1) / block)))
    draws = F.flatten(F.transform(F.coalesce(covered, F.array().cast("array<bigint>")), drawn))
    kept = kept.withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return kept.select("doc_id", "source", "same", "size", "source_size", "target", "place", taken.alias("taken"), "draws"), sources


def shards(mixed: DataFrame, sources: list[Source], n: int, seed: int = 7) -> DataFrame:
    """One row per document and draw: shard, position key, doc_id, source, place of the document, start and n words.

    A shard's draws of a source are one range of the numbering; order a shard by ``key`` to shuffle it. Ranges are found
    by stretches of the numbering as long as a mean range, so a draw is compared with a few ranges and not with ``n``.
    """
    spark = mixed.sparkSession
    after = np.cumsum(split_quotas([s.quota for s in sources], n, seed), axis=0)
    rows = []
    for i, s in enumerate(sources):
        long = stretch(s, n)
        for h in range(n):
            a, b = int(after[h - 1, i]) if h else 0, int(after[h, i])
            rows += [(s.name, part, h, a, b) for part in range(a // long, (b - 1) // long + 1) if b > a]
    ranges = spark.createDataFrame(rows, "source string, part long, shard int, first long, after long")
    one = mixed.select("doc_id", "source", "place", F.explode("draws").alias("d"))
    one = one.withColumn("part", F.floor(F.col("d.number") / by_source(sources, lambda s: F.lit(stretch(s, n)).cast("long"))))
    on = F.col("m.source").eqNullSafe(F.col("r.source")) & (F.col("m.part") == F.col("r.part")) & (F.col("d.number") >= F.col("first")) & (F.col("d.number") < F.col("after"))
    joined = one.alias("m").join(F.broadcast(ranges).alias("r"), on)  # about two rows per source and shard
    return joined.select("shard", F.xxhash64(F.lit(seed), F.col("m.source"), "d.number").alias("key"), "doc_id", "m.source", "m.place", F.col("d.block").alias("block"), F.col("d.number").alias("number"), F.col("d.start").alias("start"), F.col("d.n").alias("n"))


def stretch(source: Source, n: int) -> int:
    """The mean length of a source's ranges when it is split among ``n`` shards."""
    return max(1, -(-source.quota // n))


def write_mix(mixed: DataFrame, sources: list[Source], n: int, path: str, seed: int = 7) -> None:
    """Write the shards, each shuffled in its own task."""
    shards(mixed, sources, n, seed).repartition(n, "shard").sortWithinPartitions("shard", "key", "place", "start").write.partitionBy("shard").parquet(path)


def dealt(docs: DataFrame, most: int = 3, seed: int = 7, shard_words: int = 1 << 20) -> DataFrame:
    """The documents of ``mix``, with the words that the written shards hold of each as ``taken``.

    A shard has about ``shard_words`` words; a source and a place name a document that has words.
    """
    spark = docs.sparkSession
    mixed, sources = mix(docs, most, seed)
    mixed = saved(mixed)
    n = max(shuffle_partitions(spark), -(-sum(s.quota * s.block for s in sources) // shard_words))
    path = scratch_dir(spark, "llm")
    write_mix(mixed, sources, n, path, seed)
    drawn = spark.read.schema("source string, place long, n long").parquet(path)
    took = drawn.groupBy("source", "place").agg(F.sum("n").alias("taken"))
    on = F.col("m.source").eqNullSafe(F.col("t.source")) & (F.col("m.place") == F.col("t.place")) & (F.col("m.size") > 0)
    return mixed.alias("m").join(took.alias("t"), on, "left").select("m.doc_id", "m.source", "same", "size", "source_size", "target", "m.place", F.coalesce("t.taken", F.lit(0).cast("long")).alias("taken"))


def rounded(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """``mixed`` with ``copies``: taken / size rounded down or up, so that a source's words stay near those taken.

    Documents of a source are lined up by size, and where the running sum of the shares' fractions passes a whole number
    (from a start given by hashing) one is rounded up: each as often as its fraction says, and the words miss by less
    than the source's largest document. Then as many others as make up for the miss, in an order given by hashing, get
    one copy less or more, within the source's own share rounded down and up: what is still missed is at most half a
    document no larger than the miss, as long as there are enough of them.
    """
    unit = 1 << 32
    some = mixed.where("size > 0").withColumn("least", F.floor(F.col("taken") / F.col("size")))
    some = some.withColumn("part", F.floor((F.col("taken") - F.col("least") * F.col("size")) / F.col("size") * unit))
    lined = running_sums(positions(some, ["source"], ["size", "place"]), ["source"], "pos", {"upto": F.col("part")})
    start = F.pmod(F.xxhash64(F.lit(seed), "source", F.lit("whole")), F.lit(unit))
    whole = F.col("target") / F.col("source_size")
    upto = F.col("upto").cast("long") + start
    up = F.shiftright(upto, 32) - F.shiftright(upto - F.col("part"), 32)
    once = saved(lined.select("doc_id", "source", "same", "size", "place", "taken", (F.col("least") + up).alias("copies"), F.floor(whole).alias("fewest"), F.ceil(whole).alias("most"), F.xxhash64(F.lit(seed), "source", "place", F.lit("turn")).alias("key")))
    missed = once.groupBy("source").agg(F.sum(F.col("copies") * F.col("size") - F.col("taken")).alias("over"))
    near = once.alias("a").join(missed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "over")
    turns = (F.col("size") <= F.abs("over")) & F.when(F.col("over") > 0, F.col("copies") > F.col("fewest")).otherwise(F.col("copies") < F.col("most"))
    turning = running(near.where(turns), ["source"], ["key"], F.col("size"), "before")
    turned = turning.where(2 * F.col("before") + F.col("size") <= 2 * F.abs("over")).select("source", "place", F.signum("over").cast("int").alias("less"))
    on = F.col("a.source").eqNullSafe(F.col("t.source")) & (F.col("a.place") == F.col("t.place"))
    return once.alias("a").join(turned.alias("t"), on, "left").select("a.doc_id", "a.source", "same", "size", "taken", (F.col("copies") - F.coalesce("less", F.lit(0))).cast("int").alias("copies"))


def whole_documents(docs: DataFrame, most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a part of a document is rounded to the whole of it or none.

    Rows with equal doc_id, source and text are one document, which stands for the copies of all.
    """
    copies = rounded(dealt(docs, most, seed), seed)
    wanted = copies.groupBy("doc_id", "source", "same").agg(F.sum("copies").alias("copies")).where("copies > 0")
    d = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64(text()).alias("same")).dropDuplicates(["doc_id", "source", "same"]).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.source").eqNullSafe(F.col("w.source")) & (F.col("d.same") == F.col("w.same"))
    return d.join(wanted.alias("w"), on).select("row", F.explode(F.sequence(F.lit(1), F.col("w.copies").cast("int")))).select("row.*")
