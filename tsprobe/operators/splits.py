"""Splits, samples, folds, few-shot picks and chance baselines.

Random choices are hash order (see ``functions.hashing``). A choice of k rows per
group is a comparison with the group's cut-off key, so the wide rows are not
sorted and a class that holds most rows is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsprobe.functions.hashing import HASH_RANGE, hash_key
from tsprobe.operators.ordering import hash_cut, hash_rank, hash_select, null_safe_join, positions


def group_split(df: DataFrame, people: DataFrame, subject: str, n_test: int, n_dev: int = 0, seed=42) -> DataFrame:
    """Add ``split``: whole subjects go to test, dev or train; at least one must stay in train."""
    distinct = people.select(subject).distinct()
    held = n_test + n_dev

    def cut(k: int) -> Column:
        message = F.lit(f"n_test + n_dev = {held} leaves no train subject")
        quota = F.when(F.col("n") > held, F.lit(k)).otherwise(F.raise_error(message).cast("int"))
        return hash_cut(distinct, [], [subject], seed, quota).scalar()

    me = F.struct(hash_key(seed, subject).alias("_h"), subject)
    split = F.lit("train")
    if n_dev:
        split = F.when(F.coalesce(me <= cut(held), F.lit(False)), "dev").otherwise(split)
    if n_test:
        split = F.when(F.coalesce(me <= cut(n_test), F.lit(False)), "test").otherwise(split)
    return df.withColumn("split", split)


def stratified_split(df: DataFrame, label: str, ids: Sequence[str], train_frac: float, seed=42) -> DataFrame:
    """Per class floor(frac * n) train rows, at least 1 and at most n - 1 (a single row trains)."""
    n = F.col("n")
    k = F.floor(F.lit(train_frac) * n)
    quota = F.when(n == 1, 1).otherwise(F.least(F.greatest(F.lit(1), k), n - 1))
    picked = hash_select(df, [label], ids, seed, quota, "_train")
    return picked.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def stratified_sample(df: DataFrame, label: str, ids: Sequence[str], n: int, seed=42) -> DataFrame:
    """About ``n`` rows in class proportion (at least one per class), trimmed at random to at most ``n``."""
    size = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    share = F.bround(F.lit(n) * F.col("n") / size)
    quota = F.when(size <= n, F.col("n")).otherwise(F.least(F.greatest(F.lit(1), share), F.col("n")))
    picked = hash_select(df, [label], ids, seed, quota, "_in").where("_in").drop("_in")
    return uniform_sample(picked, ids, n, f"{seed}-trim")


def uniform_sample(df: DataFrame, ids: Sequence[str], n: int, seed=42) -> DataFrame:
    """``n`` random rows; -1 or a large n keeps everything."""
    if n == -1:
        return df
    return hash_select(df, [], ids, seed, F.lit(n), "_in").where("_in").drop("_in")


def first_n(df: DataFrame, idx: str, n: int) -> DataFrame:
    """Rows with the first ``n`` indices; -1 keeps all, other negatives are an error."""
    if n == -1:
        return df
    if n < 0:
        raise ValueError(f"n must be -1 or nonnegative, got {n}")
    return df.where(F.col(idx) < n)


def shuffle_reindex(df: DataFrame, groups: Sequence[str], ids: Sequence[str], seed=42, name: str = "new_idx") -> DataFrame:
    """A random order within each split as a dense 0-based index."""
    return hash_rank(df, groups, ids, seed, name)


def reindex(df: DataFrame, groups: Sequence[str], idx: str, name: str = "new_idx") -> DataFrame:
    """Dense 0-based index of the remaining rows, in ``idx`` order."""
    return positions(df, groups, [idx], name)


def few_shots(train: DataFrame, label: str, ids: Sequence[str], k: int, seed=42) -> DataFrame:
    """``k`` rows per class with their ``rank``; each task forwards at most k rows per class."""
    w = Window.partitionBy(label).orderBy("_h", *ids)
    ranked = train.withColumn("_h", hash_key(seed, *ids)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).drop("_h")


def interleave_shots(shots: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """Round-robin order over classes (first of each class, second of each class, ...), at most ``n`` per class."""
    kept = shots if n is None else shots.where(F.col("rank") <= n)
    return positions(kept, [], ["rank", label], "shot_order")


def take_with_shots(shots: DataFrame, subset: DataFrame, idx: str) -> DataFrame:
    """Keep the shots whose row is in ``subset`` and point them at the subset's new positions."""
    return shots.join(subset.select(idx, "new_idx"), idx, "inner")


def chronological_split(df: DataFrame, keys: Sequence[str], idx: str, train_frac: float = 0.7) -> DataFrame:
    """First floor(frac * n) positions train, the rest test."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = null_safe_join(df, sizes, keys) if keys else df.withColumn("_n", sizes.scalar())
    part = F.when(F.col(idx) < F.floor(F.lit(train_frac) * F.col("_n")), "train").otherwise("test")
    return out.withColumn("split", part).drop("_n")


def kfold_contiguous(df: DataFrame, idx: str, k: int, name: str = "fold") -> DataFrame:
    """Plain unshuffled folds: the first n mod k folds hold one row more."""
    out = positions(df, [], [idx], "_p").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    small, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    fold = F.when(F.col("_p") < extra * (small + 1), F.floor(F.col("_p") / (small + 1))).otherwise(
        F.floor((F.col("_p") - extra) / F.greatest(small, F.lit(1)))
    )
    return out.withColumn(name, fold.cast("int")).drop("_p", "_n")


def kfold_stratified(df: DataFrame, label: str, idx: str, k: int, name: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """Unshuffled stratified folds, of each group of ``keys`` on its own.

    Classes are laid end to end in order of first appearance; a class gets as many
    rows in fold i as it has places j with j mod k = i, handed out in index order.
    """
    own = [*keys, label]
    classes = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    layout = classes.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_first")
    out = null_safe_join(positions(df, own, [idx], "_p"), layout, own)
    s, n = F.col("_s"), F.col("_n")
    upto, fold = F.lit(0), F.lit(0)
    for i in range(k - 1):
        upto = upto + F.floor((s + n - 1 - i) / k) - F.floor((s - 1 - i) / k)
        fold = fold + (F.col("_p") >= upto).cast("int")
    return out.withColumn(name, fold.cast("int")).drop("_p", "_s", "_n")


def time_folds(df: DataFrame, idx: str, k: int) -> DataFrame:
    """Expanding-window folds: one output row per (row, fold) it takes part in, with ``role`` train or val."""
    out = positions(df, [], [idx], "_p").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    step = F.floor(F.col("_n") / (k + 1))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("_n") - (k - F.col("fold")) * step
    role = F.when(F.col("_p") < start, "train").when(F.col("_p") < start + step, "val")
    return out.withColumn("role", role).where(F.col("role").isNotNull()).drop("_p", "_n")


def class_histogram(df: DataFrame, keys: Sequence[str], label: str, name: str = "n", subjects: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(name)]
    if subjects:
        aggs.append(F.countDistinct(subjects).alias("n_subjects"))
    return df.groupBy(*keys, label).agg(*aggs)


def prior(train: DataFrame, label: str) -> DataFrame:
    """Share of each train label."""
    size = train.where(F.col(label).isNotNull()).agg(F.count(F.lit(1))).scalar()
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / size)


def baseline_predict(train: DataFrame, test: DataFrame, label: str, idx: str, mode: str = "prior", seed=42) -> DataFrame:
    """Chance predictions for ``test``: uniform over labels, drawn from the train prior, or the majority label.

    Only the train label table (one row per class) crosses over, as a scalar subquery.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"), F.min(idx).alias("first"))
    h = hash_key(seed, idx)
    if mode == "majority":
        pick = counts.agg(F.max_by(label, F.struct("c", -F.col("first")))).scalar()
        return test.withColumn("pred", pick)
    table = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "c"))).alias("t")).scalar()
    out = test.withColumn("_t", table)
    if mode == "uniform":
        return out.withColumn("pred", F.element_at("_t", (h % F.size("_t")).cast("int") + 1)["label"]).drop("_t")
    if mode == "prior":
        whole = F.aggregate("_t", F.lit(0).cast("bigint"), lambda a, r: a + r["c"])
        draw = h / F.lit(float(HASH_RANGE)) * whole
        hit = F.aggregate(
            "_t",
            F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast(train.schema[label].dataType).alias("label")),
            lambda a, r: F.struct(
                (a["upto"] + r["c"]).alias("upto"),
                F.when(a["label"].isNull() & (draw < a["upto"] + r["c"]), r["label"]).otherwise(a["label"]).alias("label"),
            ),
        )
        return out.withColumn("pred", hit["label"]).drop("_t")
    raise ValueError(f"unknown mode {mode!r}")


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels in test that never occur in train."""
    return test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")
