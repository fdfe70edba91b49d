"""What is done, what is missing: resume points and completeness reports over logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tsprobe.operators.ordering import null_safe_join, positions

#: attempts per bit mask
MASK_BITS = 63


def pending_attempts(expected: DataFrame, done: DataFrame, idx: str, n: int) -> DataFrame:
    """(idx, attempt) pairs of 0..n-1 that are not logged yet.

    The log is reduced to one bit mask for every ``MASK_BITS`` attempts of an id before it moves, and masks meet ids in a
    sort-merge join: Spark's estimate of an exploded log is far below its size, and a broadcast of it fills the driver.
    """
    attempt = F.col("attempt").cast("bigint")
    valid = (F.col("attempt") == attempt) & attempt.between(0, n - 1)
    logged = done.where(valid).select(F.col(idx).alias("_idx"), F.floor(attempt / MASK_BITS).cast("int").alias("_m"), F.expr(f"shiftleft(1L, CAST(pmod(attempt, {MASK_BITS}) AS INT))").alias("_bit"))
    masks = logged.groupBy("_idx", "_m").agg(F.bit_or("_bit").alias("_mask")).hint("merge")
    wanted = expected.select(idx, F.explode(F.sequence(F.lit(0), F.lit((n - 1) // MASK_BITS))).alias("_w"))
    joined = wanted.join(masks, (wanted[idx] == masks["_idx"]) & (F.col("_w") == F.col("_m")), "left")
    first = F.col("_w") * MASK_BITS
    last = F.least(first + (MASK_BITS - 1), F.lit(n - 1))
    tried = joined.select(wanted[idx], F.coalesce("_mask", F.lit(0).cast("bigint")).alias("_mask"), F.explode(F.sequence(first, last)).alias("attempt"))
    return tried.where(F.getbit("_mask", F.pmod("attempt", F.lit(MASK_BITS))) == 0).select(idx, "attempt")


def attempt_progress(log: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Attempts per id so far and whether the first attempt was right."""
    return log.groupBy(*keys, idx).agg(
        F.countDistinct("attempt").alias("n_done"),
        F.max(F.when(F.col("attempt") == 0, F.col("correct"))).alias("first_correct"),
    )


def first_incomplete_batch(log: DataFrame, runs: DataFrame, keys: Sequence[str], test_len: int, batch_size: int) -> DataFrame:
    """Per run the first batch with fewer rows than expected, or the number of batches when all are full.

    The full batches are numbered; the first whose number is not its index follows the gap.
    """
    keys = list(keys)
    n_batches = -(-test_len // batch_size)
    seen = log.groupBy(*keys, "batch_idx").agg(F.count(F.lit(1)).alias("_seen"))
    expected = F.least(F.lit(batch_size), F.lit(test_len) - F.col("batch_idx") * batch_size)
    full = seen.where(F.col("batch_idx").between(0, n_batches - 1) & (F.col("_seen") >= expected))
    placed = positions(full, keys, ["batch_idx"], "_p")
    gap = F.min(F.when(F.col("batch_idx") != F.col("_p"), F.col("_p")))
    gaps = placed.groupBy(*keys).agg(F.coalesce(gap, F.count(F.lit(1))).cast("int").alias("batch_start"))
    return null_safe_join(runs.select(*keys), gaps, keys, "left").fillna({"batch_start": 0})


def run_completeness(log: DataFrame, keys: Sequence[str], idx: str, n: int, expected: DataFrame) -> DataFrame:
    """Coverage of each run: ids seen, ids with all attempts 0..n-1, unique rows, rows expected.

    ``expected`` has the run keys and ``expected_examples`` (from the split table).
    """
    keys = list(keys)
    tries = log.where(F.col(idx).isNotNull() & F.col("attempt").isNotNull())
    unique = tries.groupBy(*keys, idx, "attempt").agg(F.lit(1).alias("_one"))
    in_range = F.count_if((F.col("attempt") >= 0) & (F.col("attempt") < n))
    per = unique.groupBy(*keys, idx).agg(F.count(F.lit(1)).alias("_rows"), in_range.alias("_hit"))
    runs = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present_idxs"), F.count_if(F.col("_hit") == n).alias("complete_idxs"), F.sum("_rows").alias("rows_present")
    )
    out = null_safe_join(expected, runs, keys, "left").fillna(0, ["present_idxs", "complete_idxs", "rows_present"])
    out = out.withColumn("rows_expected", F.col("expected_examples") * n)
    done = (F.col("rows_present") >= F.col("rows_expected")) & (F.col("complete_idxs") >= F.col("expected_examples"))
    return out.withColumn("complete", done)


def progress_totals(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("correct", F.lit(0))).alias("acc"),
        F.avg(F.coalesce("correct", F.lit(0))).alias("accuracy"),
    )


def variant_progress(log: DataFrame, keys: Sequence[str], expected: int = 10) -> DataFrame:
    """Variants present per run and kind set (order-free), and their line count."""
    kinds = F.array_join(F.array_sort(F.split(F.replace(F.col("kinds"), F.lit("-"), F.lit(",")), ",")), ",")
    return log.groupBy(*keys, kinds.alias("kinds"), "cot").agg(
        F.countDistinct("variant").alias("n_variants"), F.count(F.lit(1)).alias("n_lines")
    ).withColumn("complete", F.col("n_variants") == expected)


def grid(spark: SparkSession, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """The expected run grid from a handful of dimension lists."""
    base = spark.range(1)
    for name, values in dims.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base.drop("id")


def completeness(expected: DataFrame, observed: DataFrame, keys: Sequence[str], readable: Column | None = None) -> DataFrame:
    """Expected runs with status present / missing / unreadable and their row count."""
    keys = list(keys)
    ok = readable if readable is not None else F.lit(True)
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("_bad"))
    out = null_safe_join(expected, seen, keys, "left")
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("_bad") > 0, "unreadable").otherwise("present")
    return out.withColumn("status", status).withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).drop("_bad")

