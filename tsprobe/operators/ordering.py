"""Ranks, cut-offs, neighbours and running totals that survive one huge group.

``row_number() over (partition by class ...)`` sends a whole class to one task.
Everything here cuts the rows into *slices* of their order first: a slice is ranked
on its own and a small per-slice count table supplies the offset. The result is the
exact global rank, but no task ever sees a whole hot group. There is one way for
tables of every size; the number of slices follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tsprobe.functions.hashing import HASH_RANGE, hash_key

#: sampled rows per slice
SAMPLE = 16
#: rows that are sampled of a range, rows that are put in order, and how often a range is narrowed
SAMPLED, ORDERED, LEVELS = 20_000, 200_000, 6
#: positions per chunk for neighbour and running-total operators
CHUNK = 1 << 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def slice_count(df: DataFrame) -> int:
    """Slices of a table: as many as its shuffles have partitions, which the session sizes for its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hash_slice(h: Column, n: int) -> Column:
    return F.floor(h / F.lit(-(-HASH_RANGE // n))).cast("int")


def _steps(bounds: Column, place: Column, n: int) -> Column:
    """How many of the sorted ``bounds`` (fewer than ``n``) are below ``place``, by halving."""

    def half(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(bounds, middle) < place
        lower = F.when(below, middle + 1).otherwise(state["lo"])
        upper = F.when(below, state["hi"]).otherwise(middle)
        return F.when(state["lo"] < state["hi"], F.struct(lower.alias("lo"), upper.alias("hi"))).otherwise(state)

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, half, lambda state: state["lo"])


def slice_bounds(df: DataFrame, place: Sequence[str]) -> DataFrame:
    """Tuples ``b`` that cut the rows, ordered by ``place``, into slices of about equal size: fewer than there are slices.

    They come from a uniform sample of ``SAMPLE`` tuples per slice, those with the least hashes: each task keeps its
    least ones, so that the input is read once and what reaches one task depends on the number of slices alone.
    """
    n = slice_count(df)
    tuples = df.select(F.struct(*place).alias("t"))
    sample = tuples.orderBy(F.xxhash64("t")).limit(SAMPLE * n).agg(F.sort_array(F.collect_list("t")).alias("s")).first()["s"]
    cuts = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    cuts = [b for i, b in enumerate(cuts) if i == 0 or b != cuts[i - 1]]
    return df.sparkSession.createDataFrame([(b,) for b in cuts], tuples.select(F.col("t").alias("b")).schema)


def _slice_offsets(counts: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Exclusive running sums of ``measures`` over slices.

    The first slice of a group has no offset and no row, so groups of one slice,
    normally almost all of them, add nothing to this table.
    """
    w = Window.partitionBy(*keys).orderBy("_slice")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.select(*keys, "_slice", F.row_number().over(w).alias("_i"), *[F.sum(m).over(before).alias(m) for m in measures])
    return numbered.where(F.col("_i") > 1).drop("_i")


def _add_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the offsets; Spark broadcasts them if their measured size allows."""
    return null_safe_join(df, offsets, [*keys, "_slice"], "left")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of each row within ``keys``, ordered by ``order`` (ascending, unique).

    The input is read for a sample, for the rows, and, in its key and order columns alone, for the sizes of slices of
    those groups that a bound cuts: at most one group per bound, so the offsets are a small table at any size.
    """
    keys, order = list(keys), list(order)
    place = [*keys, *order]
    cuts = slice_bounds(df, place)
    bounds = cuts.agg(F.sort_array(F.collect_list("b")).alias("s")).scalar()
    tuple_ = F.struct(*place)

    def sliced(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bounds", bounds).withColumn("_slice", _steps(F.col("_bounds"), tuple_, slice_count(df))).drop("_bounds")

    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced(df).withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    cut = df.select(*place)
    if keys:
        cut = null_safe_join(cut, F.broadcast(cuts.select(*[F.col(f"b.{k}").alias(k) for k in keys]).distinct()), keys, "left_semi")
    counts = sliced(cut).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_before"))
    out = null_safe_join(ranked, F.broadcast(_slice_offsets(counts, keys, ["_before"])), [*keys, "_slice"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_slice")


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def segments(df: DataFrame, group: str, order: Sequence[str], starts: Mapping[int, Sequence[int]]) -> Column:
    """The number of the segment of each row in its group, where segments begin at the positions ``starts[group]``.

    Groups are integers, and positions are those of ``positions`` within a group. Rows are not moved: hashed samples of
    bounded size narrow the range in which the last row of a segment lies, counts say exactly how many rows are below it,
    and what is left of a range is put in order. The segment of a row is how many of these last rows are below it, an
    expression over ``df`` of comparisons with constants. Rows that are equal in ``order`` on both sides of a cut cannot
    be told apart by it; that raises ``ValueError``.
    """
    t, g_col = F.struct(*order), F.col(group)
    rows = df.select(g_col, *order)
    kind = rows.select(t.alias("t")).schema["t"].dataType
    total = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    # of each cut the group and the position of the last row; a range above ``low`` up to ``high``, rows below and inside
    cuts = [{"g": g, "p": r - 1, "low": None, "high": None, "below": 0, "n": total[g]} for g, each in starts.items() for r in sorted(set(each)) if 0 < r < total.get(g, 0)]

    def within(g: int, low, high) -> Column:
        out = g_col == g
        if low is not None:
            out = out & (t > _literal(low, kind))
        return out if high is None else out & (t <= _literal(high, kind))

    width = 4.0
    for _ in range(LEVELS):
        wide = [c for c in cuts if c["n"] > ORDERED]
        if not wide:
            break
        ranges = {(c["g"], c["low"], c["high"]): c["n"] for c in wide}
        share = [(within(*r), F.pmod(F.xxhash64(t, F.lit(width)), F.lit(max(1, n // SAMPLED)))) for r, n in ranges.items()]
        seen = rows.where(reduce(lambda a, b: a | b, [inside & (h == 0) for inside, h in share]))
        tagged = seen.select(t.alias("t"), F.array_compact(F.array(*[F.when(inside & (h == 0), i) for i, (inside, h) in enumerate(share)])).alias("i"))
        drawn: dict = {r: [] for r in ranges}
        for i, sample in tagged.select(F.explode("i").alias("i"), "t").groupBy("i").agg(F.sort_array(F.collect_list("t"))).collect():
            drawn[list(ranges)[i]] = sample
        tried = []
        for c in wide:
            sample = drawn[c["g"], c["low"], c["high"]]
            at = (c["p"] - c["below"]) * len(sample) // c["n"]
            off = int(width * (len(sample) ** 0.5 / 2 + 1))
            low = sample[at - off] if 0 <= at - off < len(sample) else c["low"]
            high = sample[at + off] if at + off < len(sample) else c["high"]
            tried.append((c, low, high))
        sums = [F.count_if(within(c["g"], None, low)) if low is not None else F.lit(0) for c, low, _ in tried]
        sums += [F.count_if(within(c["g"], low, high)) for c, low, high in tried]
        found = rows.agg(*[x.cast("bigint").alias(f"_{i}") for i, x in enumerate(sums)]).first()
        for i, (c, low, high) in enumerate(tried):
            below, n = found[i], found[len(tried) + i]
            if below <= c["p"] < below + n:
                c.update(low=low, high=high, below=below, n=n)
        width *= 2 if any(c["n"] > ORDERED for c in cuts) else 1
    ends: dict = {}
    if cuts:
        inside = [within(c["g"], c["low"], c["high"]) for c in cuts]
        left = rows.where(reduce(lambda a, b: a | b, inside)).withColumn("_c", F.explode(F.array_compact(F.array(*[F.when(x, i) for i, x in enumerate(inside)]))))
        w = Window.partitionBy("_c").orderBy(*order)
        ranked = left.select("_c", t.alias("_t"), F.row_number().over(w).alias("_r"), F.coalesce(F.lead(t).over(w) == t, F.lit(False)).alias("_tie"))
        picked = reduce(lambda a, b: a | b, [(F.col("_c") == i) & (F.col("_r") == c["p"] - c["below"] + 1) for i, c in enumerate(cuts)])
        for r in ranked.where(picked).collect():
            if r["_tie"]:
                raise ValueError(f"rows are equal in {list(order)}")
            ends.setdefault(cuts[r["_c"]]["g"], []).append(r["_t"])
    out: Column = F.lit(0)
    for g, last in ends.items():
        out = F.when(g_col == g, reduce(lambda a, b: a + b, [(t > _literal(x, kind)).cast("int") for x in last])).otherwise(out)
    return out


def hash_rank(df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed, name: str = "rank") -> DataFrame:
    """0-based rank of each row within ``groups`` in hash order: a repeatable shuffle."""
    groups, ids = list(groups), list(ids)
    keyed = df.withColumn("_h", hash_key(seed, *ids)).withColumn("_slice", _hash_slice(F.col("_h"), slice_count(df)))
    w = Window.partitionBy(*groups, "_slice").orderBy("_h", *ids)
    ranked = keyed.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    counts = keyed.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_before"))
    out = _add_offsets(ranked, _slice_offsets(counts, groups, ["_before"]), groups)
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_slice", "_h")


def hash_cut(df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed, quota: Column) -> DataFrame:
    """The hash key of the ``quota``-th smallest row of each group (one row per group).

    ``quota`` may use the column ``n`` (rows of the group). Two column-pruned
    passes: slice counts, then a rank inside the single slice that holds the cut.
    """
    groups, ids = list(groups), list(ids)
    keyed = df.select(*groups, *ids, hash_key(seed, *ids).alias("_h")).withColumn("_slice", _hash_slice(F.col("_h"), slice_count(df)))
    counts = keyed.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    by_slice = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.withColumn("n", F.sum("_c").over(Window.partitionBy(*groups)))
        .withColumn("_upto", F.sum("_c").over(by_slice))
        .withColumn("_q", F.least(quota.cast("bigint"), F.col("n")))
        .where((F.col("_q") > F.col("_upto") - F.col("_c")) & (F.col("_q") <= F.col("_upto")))
        .select(*groups, "_slice", (F.col("_q") - F.col("_upto") + F.col("_c")).alias("_k"))
    )
    inside = null_safe_join(keyed, cuts, [*groups, "_slice"])
    w = Window.partitionBy(*groups, "_slice").orderBy("_h", *ids)
    return (
        inside.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") == F.col("_k"))
        .select(*groups, F.struct("_h", *ids).alias("_cut"))
    )


def hash_select(df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed, quota: Column, name: str = "picked") -> DataFrame:
    """Flag the ``quota`` rows of each group with the smallest hash keys.

    The wide rows are only compared with their group's cut-off and never sorted; whether the cut-offs are broadcast is
    Spark's choice by their measured size.
    """
    groups, ids = list(groups), list(ids)
    cuts = hash_cut(df, groups, ids, seed, quota)
    mine = F.struct(hash_key(seed, *ids).alias("_h"), *ids)
    if not groups:
        return df.withColumn(name, F.coalesce(mine <= cuts.scalar(), F.lit(False)))
    joined = null_safe_join(df, cuts, groups, "left")
    return joined.withColumn(name, F.coalesce(mine <= F.col("_cut"), F.lit(False))).drop("_cut")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    back: Mapping[str, Column | str] | None = None,
    ahead: Mapping[str, Column | str] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Previous and next values by position, computed inside chunks with a one-row halo."""
    keys = list(keys)
    owner = F.floor(F.col(pos) / chunk)
    homes = [owner]
    if ahead:
        homes.append(F.when((F.col(pos) % chunk == 0) & (F.col(pos) > 0), owner - 1))
    if back:
        homes.append(F.when(F.col(pos) % chunk == chunk - 1, owner + 1))
    spread = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    for name, c in (ahead or {}).items():
        spread = spread.withColumn(name, F.lead(_col(c)).over(w))
    for name, c in (back or {}).items():
        spread = spread.withColumn(name, F.lag(_col(c)).over(w))
    return spread.where(F.col("_chunk") == owner).drop("_chunk")


def running_sums(df: DataFrame, keys: Sequence[str], pos: str, sums: Mapping[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sums by position; long groups are summed chunk by chunk."""
    keys = list(keys)
    for name, c in sums.items():
        df = df.withColumn(name, c)
    parts = df.withColumn("_slice", F.floor(F.col(pos) / chunk))
    totals = parts.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_o_{n}") for n in sums])
    offsets = _slice_offsets(totals, keys, [f"_o_{n}" for n in sums])
    w = Window.partitionBy(*keys, "_slice").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(n).over(w).alias(f"_l_{n}") for n in sums])
    out = _add_offsets(local, offsets, keys)
    for name in sums:
        out = out.withColumn(name, F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_o_{name}", F.lit(0)))
    return out.drop("_slice", *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bins: int = 1024, levels: int = 2) -> DataFrame:
    """Linear-interpolation quantiles per group by rank selection: no ranking of all rows, all probabilities at once.

    Equal values are merged first. A histogram of the group's range says in which bin each wanted rank lies; the bin's
    own least and greatest value are the range of the next histogram, of that bin's rows alone. After ``levels`` of
    them about one of ``bins ** levels`` values is left per rank to be put in order. Bins are the same at every size,
    and a bin that stays full because values crowd there only costs more ordering. Nulls don't count; infinities and
    NaN (the greatest) have bins of their own.
    """
    keys = list(keys)
    x = F.col("_x")
    merged = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = merged.withColumn("_x", F.col("_v").cast("double"))
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    stats = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(F.when(finite, x)).alias("_lo"), F.max(F.when(finite, x)).alias("_hi"))
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ranks = F.array_distinct(F.array(*[f(a).cast("bigint") for a in at.values() for f in (F.floor, F.ceil)]))
    # halves, so that the width of a range cannot overflow
    share = (x / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    inside = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    bin_ = F.when(finite, inside).when(x == float("-inf"), F.lit(-1)).when(x == float("inf"), F.lit(bins)).otherwise(F.lit(bins + 1))

    def histogram(rows: DataFrame, by: list[str]) -> DataFrame:
        filled = rows.groupBy(*by, bin_.cast("int").alias("_bin")).agg(F.sum("_c").alias("_c"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        return filled.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))

    def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return null_safe_join(rows, groups, keys) if keys else rows.join(F.broadcast(groups))  # one row, or one per rank

    mine = (F.col("_r") >= F.col("_upto") - F.col("_c")) & (F.col("_r") < F.col("_upto"))
    first = with_groups(histogram(with_groups(counts, stats.drop("_n")), keys), stats.select(*keys, ranks.alias("_ranks")))
    found = first.withColumn("_r", F.explode("_ranks")).where(mine).select(*keys, "_r", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi")
    for _ in range(levels - 1):
        rows = with_groups(counts, found).where(x.between(F.col("_lo"), F.col("_hi")))
        next_ = histogram(rows, [*keys, "_r", "_below"]).withColumn("_upto", F.col("_upto") + F.col("_below"))
        found = next_.where(mine).select(*keys, "_r", (F.col("_upto") - F.col("_c")).alias("_below"), "_lo", "_hi")
    left = with_groups(counts, found).where(x.between(F.col("_lo"), F.col("_hi")))
    order = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = left.withColumn("_upto", F.sum("_c").over(order) + F.col("_below")).where(mine)
    values = with_groups(picked.select(*keys, "_r", "_v"), stats.select(*keys, "_n"))
    aggs = []
    for name, a in at.items():
        low, high = (F.max(F.when(F.col("_r") == f(a), F.col("_v"))) for f in (F.floor, F.ceil))
        between = F.max(a - F.floor(a))
        aggs.append(F.when(between == 0, low).otherwise(low + (high - low) * between).alias(name))
    return values.groupBy(*keys).agg(*aggs)
