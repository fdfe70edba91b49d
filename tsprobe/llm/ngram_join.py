"""N-gram Jaccard self-join: MinHash banding sized for a target recall, pairs verified on full n-gram sets.

Equal texts are one class, of which only the representative (least id) is compared. A text's n-grams are its runs of
five consecutive words (a text with fewer words is one n-gram; one without words has none and no links), as 64-bit
hashes. Representatives are shuffled by band hash; only those that meet another bring their full sets, so the shuffle of
sets follows the candidates. A bucket is cut into chunks by hashing, as many as its members and their bytes need, and each pair of chunks is compared in one task: bucket size never decides what a task holds. A pair
is verified where it first shares a band, with its full sets; sets of all pairs of a tile are intersected at once in
bounded slices.

Large groups of near copies need no pair by pair check, because the Jaccard distance is a metric: of a bucket with more than
one chunk the n-grams that most of a sample have are its consensus, and members within half the allowed distance of one
and the same consensus are all linked to each other. They are counted by their number, as one star; only what
is further off meets all others in tiles. One group of near copies fills a large bucket in many bands, with mostly the
same members: large buckets of one consensus are one place, with each member once, wherever that makes fewer rows than the
buckets apart. The tiles then grow with the members of a place, times those that stray. No pair leaves the tile: it
returns the number of links of each member and a spanning forest of the links, from which groups (connected components)
are found by repeated joins.

Result: one row per document: doc_id, class_id (least id of its group), copy_id (least id with the same text) and
n_links, the number of other documents that it is linked to: its own copies, and every copy of a linked text.

A null text is empty. Empty texts are copies of each other. A null doc_id is a document too, and names a class only where
no other id does (class_id null); repeated rows count as copies, and one doc_id may stand for several texts. Very long texts are read whole and get a chunk of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsprobe.llm.common import saved, text
from tsprobe.llm.components import components
from tsprobe.llm.simhash import by_share

N_WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 128


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest rows whose bands reach the recall for a pair just at the similarity, with at most ``most`` hashes."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def shingles(value: str, n: int = N_WORDS) -> np.ndarray:
    """Distinct hashes of runs of ``n`` words, sorted; from one pass over word hashes."""
    found = value.encode().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.unique(ngram_hashes(h, min(n, len(h))))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash of ``rows`` minima for each band."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        x = (grams[None, at : at + 2048] ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(31) + least[r::rows])
    return out


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (digest of the text) and one hash per band, none for a text without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, hashes = [], []
            for value in batch.column(1).to_pylist():
                marks.append(hashlib.sha256(value.encode()).hexdigest())
                g = shingles(value)
                hashes.append(band_hashes(g, bands, rows).view(np.int64) if len(g) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "mark", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text")).mapInArrow(made, "doc_id long, mark string, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and grams (sorted 64-bit hashes as bytes) of the wanted classes (id, mark, copy_id), from their texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(i)[at : at + 256] for i in range(2))
                yield pa.RecordBatch.from_arrays([ids, pa.array([shingles(t).tobytes() for t in texts.to_pylist()], pa.binary())], names=["id", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text().alias("text"))
    mine = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("copy_id"))).where(F.sha2("text", 256) == F.col("mark"))
    return mine.select("id", "text").mapInArrow(made, "id long, grams binary").dropDuplicates(["id"])


def linked(sets: list[np.ndarray], left: np.ndarray, similarity: float, width: int = 1 << 14) -> np.ndarray:
    """Matrix of which sets among ``left`` (rows) and all (columns) have the Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        common += m[left] @ m.T
    union = sizes[left][:, None] + sizes[None, :] - common
    return common >= similarity * union - 1e-6


def tile_links(similarity: float):
    """Rows of one tile after the other to link counts and forest edges."""

    def one(band: int, bucket_id: int, diagonal: bool, bucket: list) -> tuple[list, list, list]:
        ids = np.array([r[0] for r in bucket], np.int64)
        known = np.array([r[5] is not None for r in bucket], bool)  # in a dense group, whose links are counted elsewhere
        core = np.array([r[5] or 0 for r in bucket], np.int64)
        chunk = np.array([r[1] for r in bucket], bool)  # in the first chunk of the tile
        hashes = np.stack([r[2] for r in bucket])
        weight = np.array([r[4] for r in bucket], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in bucket]
        if not diagonal and chunk.all() or not chunk.any():  # the other chunk is empty
            return [], [], []
        left = np.flatnonzero(chunk)
        first = np.ones((len(left), len(ids)), bool)
        for b in range(max(band, 0)):  # pairs that meet in an earlier band are verified there
            first &= hashes[left, b][:, None] != hashes[None, :, b]
        for place in sorted({x for r in bucket for x in r[6]}):  # and so are pairs that meet in an earlier place
            if band < 0 and place >= bucket_id:
                break
            here = np.array([place in r[6] for r in bucket], bool)
            first &= ~(here[left][:, None] & here[None, :])
        first &= ids[left][:, None] != ids[None, :]
        first &= ~(known[left][:, None] & known[None, :] & (core[left][:, None] == core[None, :]))
        if not diagonal:
            first &= ~chunk[None, :]
        if not first.any():
            return [], [], []
        link = first & linked(sets, left, similarity)
        counts = np.zeros(len(ids), np.int64)
        counts[left] += link @ weight
        if not diagonal:
            counts += weight[left] @ link
        root = np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for i, j in zip(*np.nonzero(link), strict=True):
            a, b = find(left[i]), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(ids[left[i]]), int(ids[j])))
        some = np.flatnonzero(counts)
        return ids[some].tolist(), counts[some].tolist(), edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out():
            ids, counts, edges = one(key[0], key[1], key[2] == key[3], rows) if len(rows) > 1 else ([], [], [])
            a = ids + [x for x, _ in edges]
            b = [None] * len(ids) + [y for _, y in edges]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(counts + [0] * len(edges), pa.int64())], names=["id", "other", "n"])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            keys = zip(*(c.to_pylist() for c in columns), strict=True)
            for i, k in enumerate(keys):
                if k != key:
                    if len(rows) > 1:
                        yield out()
                    key, rows = k, []
                rows.append((batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), np.array(batch.column(6)[i].as_py(), np.int64), batch.column(7)[i].as_py(), batch.column(8)[i].as_py(), batch.column(9)[i].as_py(), batch.column(10)[i].as_py()))
        if len(rows) > 1:
            yield out()

    return run


def buckets(classes: DataFrame) -> DataFrame:
    """id, band, bucket and members of the buckets with two members or more.

    Of buckets with the very same members only the first is kept: all its pairs are verified there.
    """
    met = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = met.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("members > 1")
    one = shared.groupBy("members", "who").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.*", "members")
    return met.join(one, ["band", "bucket"])


def consensus(rows: pa.Table) -> pa.Table:
    """The n-grams that more than half of a bucket's sample have, and a hash that names them (or the bucket, if there are none)."""
    grams, n = np.unique(np.concatenate([np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]), return_counts=True)
    most = grams[2 * n > len(rows)].tobytes()
    named = most or b"%d %d" % (rows.column("band")[0].as_py(), rows.column("bucket")[0].as_py())
    one = {name: rows.column(name)[:1] for name in ("band", "bucket", "members")}
    return pa.table({**one, "core": pa.array([xxhash.xxh3_64_intdigest(named)], pa.uint64()).view(pa.int64()), "grams": pa.array([most], pa.binary())})


def within(least: float):
    """Sorted rows of buckets, their consensus first, to the members with a similarity of ``least`` to it: id, core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, shared = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, cores = [], []
            for turn, id_, grams in zip(*(batch.column(i) for i in (3, 4, 5)), strict=True):
                mine = np.frombuffer(grams.as_py(), np.uint64)
                if turn.as_py() == 0:
                    core, shared = id_.as_py(), mine
                else:
                    both = len(np.intersect1d(mine, shared, assume_unique=True))
                    if both >= least * (len(mine) + len(shared) - both):
                        ids.append(id_.as_py())
                        cores.append(core)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cores, pa.int64())], names=["id", "core"])

    return run


def agreed_on(met: DataFrame, held: DataFrame, chunk_rows: int, sample_rows: int = 64) -> DataFrame:
    """band, bucket, members, core and grams: the consensus of each bucket of more than ``chunk_rows`` members."""
    key = ["band", "bucket"]
    turn = Window.partitionBy(*key).orderBy(F.xxhash64("id", F.lit("sample")), "id")
    sample = met.where(F.col("members") > chunk_rows).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= sample_rows)
    return sample.join(held.select("id", "grams"), "id").groupBy(*key).applyInArrow(consensus, "band int, bucket long, members long, core long, grams binary")


def dense(met: DataFrame, held: DataFrame, similarity: float, chunk_rows: int, agreed: DataFrame | None = None, part_rows: int = 1000) -> DataFrame:
    """id and core of the members of large buckets that are so near to a consensus that those of one core are all linked.

    A member is compared with the consensus of its largest bucket. Buckets of one group of near copies mostly have the very
    same consensus, and so one core. A bucket is compared in parts of about ``part_rows`` members.
    """
    key = ["band", "bucket"]
    large = met.where(F.col("members") > chunk_rows)
    agreed = agreed_on(met, held, chunk_rows) if agreed is None else agreed
    parts = F.ceil(F.col("members") / part_rows).cast("int")
    given = agreed.select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), F.col("core").alias("id"), "grams")
    choice = large.groupBy("id").agg(F.max(F.struct("members", (-F.col("band")).alias("b"), "bucket", "band")).alias("c")).select("id", "c.*").drop("b")
    part = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int").alias("part")
    asked = choice.join(held.select("id", "grams"), "id").select(*key, part, F.lit(1).alias("turn"), "id", "grams")
    sorted_ = asked.union(given).repartition(*key, "part").sortWithinPartitions(*key, "part", "turn")
    return sorted_.mapInArrow(within(1 - (1 - similarity) / 2), "id long, core long")


def places_of(met: DataFrame, agreed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where members meet: id, band, bucket; and id, spots: the joint places of a member, in order.

    A joint place stands for all large buckets of one core; its band is -1 and its bucket the core. Buckets are joined where
    the square of their distinct members is at most the sum of the squares of their members.
    """
    key = ["band", "bucket"]
    of_core = met.join(agreed.select(*key, "core"), key)
    distinct = of_core.select("core", "id").distinct()
    size = distinct.groupBy("core").agg(F.count("*").cast("double").alias("distinct"))
    apart = agreed.groupBy("core").agg(F.sum(F.col("members").cast("double") * F.col("members")).alias("squares"))
    joint = saved(size.join(apart, "core").where(F.col("distinct") * F.col("distinct") <= F.col("squares")).select("core"))
    inside = saved(distinct.join(joint, "core"))
    rest = met.join(agreed.join(joint, "core").select(*key), key, "left_anti").select("id", *key)
    spots = inside.groupBy("id").agg(F.sort_array(F.collect_list("core")).alias("spots"))
    return rest.union(inside.select("id", F.lit(-1).alias("band"), F.col("core").alias("bucket"))), spots


def links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, chunk_rows: int = 128, chunk_bytes: int = 1 << 20) -> DataFrame:
    """id, other, n: link counts (other is null), and the edges of a spanning forest of each tile and of each dense group.

    ``classes`` has id, mark, copy_id, copies and bands.
    """
    key = ["band", "bucket"]
    met = saved(buckets(classes))
    held = full_sets(docs, classes.join(met.select("id").distinct(), "id").select("id", "mark", "copy_id"))
    held = saved(held.join(classes.select("id", "bands", "copies"), "id"))
    agreed = saved(agreed_on(met, held, chunk_rows))
    core = saved(dense(met, held, similarity, chunk_rows, agreed))
    meeting, spots = places_of(met, agreed)
    held = saved(held.join(spots, "id", "left").withColumn("spots", F.coalesce("spots", F.array().cast("array<long>"))))
    sized = meeting.join(held.select("id", F.octet_length("grams").alias("size")), "id").join(core, "id", "left")
    counted = sized.where("core is not null").groupBy(*key, "core").agg(F.count("*").alias("n"))
    most = counted.groupBy(*key).agg(F.max_by("core", F.struct("n", "core")).alias("top"))
    in_top = F.coalesce(F.col("core") == F.col("top"), F.lit(False))
    member = sized.join(most, key, "left").withColumn("dense", in_top)
    chunks = lambda of: F.greatest(F.ceil(F.count_if(of) / chunk_rows), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / chunk_bytes)).cast("int")
    shape = member.groupBy(*key).agg(chunks(~F.col("dense")).alias("apart"), chunks(F.col("dense")).alias("together")).where("apart > 0")
    mine = member.select("id", *key, "dense", "core").join(shape, key)
    # chunks of members apart come first; they meet all chunks, those of the dense group only these
    h = F.xxhash64("id", F.lit("chunk"))
    chunk = F.when(F.col("dense"), F.col("apart") + F.pmod(h, F.greatest("together", F.lit(1)))).otherwise(F.pmod(h, F.col("apart"))).cast("int")
    meets = F.when(F.col("dense"), F.col("apart")).otherwise(F.col("apart") + F.col("together"))
    tiles = mine.withColumn("c", chunk).withColumn("k", F.explode(F.sequence(F.lit(0), meets - 1)))
    places = tiles.select("id", *key, F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), (F.col("c") <= F.col("k")).alias("first"), "core")
    rows = places.join(held, "id").select(*key, "i", "j", "id", "first", "bands", "grams", "copies", "core", "spots")
    dealt = rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "id")
    verified = dealt.mapInArrow(tile_links(similarity), "id long, other long, n long")
    own = core.join(held.select("id", F.col("copies").alias("own")), "id")
    groups = own.groupBy("core").agg(F.sum("own").alias("all"), F.min("id").alias("lead"), F.count("*").alias("copies"))
    star = by_share(own, groups, "core", core.count())
    inside = star.select("id", F.explode(F.array(F.struct(F.lit(None).cast("long").alias("other"), (F.col("all") - F.col("own")).alias("n")), F.struct(F.col("lead").alias("other"), F.lit(0).cast("long").alias("n")))).alias("e")).select("id", "e.*")
    return verified.union(inside.where("other is null or other <> id"))


def grouped(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """doc_id and mark of every document; and mark, copy_id, root (one value for each group) and n_links of every text."""
    own = saved(signed(docs, *bands_for(similarity, recall)))
    of_text = own.groupBy("mark").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = saved(of_text.withColumn("id", F.xxhash64("mark")))
    found = saved(links(docs, classes, similarity))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    return own.select("doc_id", "mark"), classes.join(roots, "id", "left").join(counts, "id", "left").select("mark", "copy_id", F.coalesce("root", "id").alias("root"), n_links)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id and n_links of every document."""
    own, texts = grouped(docs, similarity, recall)
    first = texts.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    return own.join(texts.join(first, "root"), "mark").select("doc_id", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, one of each group: the text with the least id (by digest, among texts with none)."""
    _, texts = grouped(docs, similarity, recall)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "mark")).alias("f")).select("f.copy_id", "f.mark")
    of = docs.select(F.struct("*").alias("row"), "doc_id", F.sha2(text(), 256).alias("mark")).alias("d")
    on = (F.col("d.mark") == F.col("f.mark")) & F.col("d.doc_id").eqNullSafe(F.col("f.copy_id"))
    return of.join(first.alias("f"), on, "left_semi").dropDuplicates(["doc_id", "mark"]).select("row.*")
