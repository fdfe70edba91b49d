"""Scores from prediction logs.

Everything starts from confusion cells (group, gt, pred, count): the one pass over
the log is a partial aggregation, whatever the number of runs or the run sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tsprobe.operators.ordering import null_safe_join, running_sums


def confusion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("cnt"))


def metrics_from_cells(cells: DataFrame, keys: Sequence[str], weight: str = "cnt") -> DataFrame:
    """n, accuracy and macro-F1 per group; labels are the union of truth and prediction, an empty F1 is 0."""
    keys = list(keys)
    w = F.col(weight)
    hit = F.when(F.col("gt").eqNullSafe(F.col("pred")), w).otherwise(0)
    sides = cells.select(
        *keys, w.alias("_w"),
        F.explode(F.array(
            F.struct(F.col("gt").alias("label"), hit.alias("tp"), w.alias("support"), F.lit(0).cast("bigint").alias("called")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), w.alias("called")),
        )).alias("s"),
    )
    per_label = sides.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.called").alias("called")
    )
    # a label drawn zero times on both sides (bootstrap) does not exist in that replicate
    per_label = per_label.where(F.col("support") + F.col("called") > 0)
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("called"))
    return per_label.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
    )


def classification_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy and macro-F1 of each run in one job."""
    return metrics_from_cells(confusion(df, keys), keys)


def results_rows(predictions: DataFrame, path: str, at: Column | None = None) -> DataFrame:
    """Scored runs as rows of a results table (accuracy, macro_f1, pred_path, timestamp), one for each prediction file."""
    time = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
    return classification_metrics(predictions, [path]).select("accuracy", "macro_f1", F.col(path).alias("pred_path"), time.alias("timestamp"))


def with_empty_runs(scores: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs without rows score n = 0 and zeros."""
    out = null_safe_join(runs, scores, list(keys), "left")
    return out.fillna({"n": 0, "accuracy": 0.0, "macro_f1": 0.0})


def correct_flag(gt: Column, pred: Column) -> Column:
    """1 when right, 0 when wrong or unparsed (negative)."""
    return F.when((pred >= 0) & (pred == gt), 1).otherwise(0)


def running_accuracy(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Accuracy after each row in arrival order."""
    hit = correct_flag(F.col("gt"), F.col("pred")).cast("bigint")
    out = running_sums(df, keys, pos, {"seen": F.lit(1).cast("bigint"), "right": hit})
    return out.withColumn("running_accuracy", F.col("right") / F.col("seen"))


def running_mae(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Mean absolute error over all points so far, ``gt`` and ``pred`` being arrays; rows without a valid forecast add none (NULL before the first)."""
    valid = F.col("gt").isNotNull() & F.col("pred").isNotNull() & (F.size("gt") == F.size("pred"))
    errors = F.zip_with("gt", "pred", lambda g, p: F.abs(g - p))
    total = F.when(valid, F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)).otherwise(0.0)
    out = running_sums(df, keys, pos, {"points": F.when(valid, F.size("gt")).otherwise(0).cast("bigint"), "abs_error": total})
    return out.withColumn("running_mae", F.try_divide("abs_error", "points"))


def pass_at_k_value(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a running product; 0 without a hit, 1 when fewer than k misses remain."""
    ratio = F.aggregate(
        F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - F.lit(float(k)) / i)
    )
    too_many = F.raise_error(F.concat(F.lit(f"k={k} cannot be larger than n="), n.cast("string"))).cast("double")
    return (
        F.when((c <= 0) | F.lit(k <= 0), 0.0)
        .when(F.lit(k) > n, too_many)
        .when(n - c < k, 1.0)
        .otherwise(1.0 - ratio)
    )


def pass_at_k(df: DataFrame, keys: Sequence[str], idx: str, ks: Sequence[int] = (1, 5, 10, 15, 20), n: int | None = None) -> DataFrame:
    """pass@k per run: mean over ids; with ``n`` every id must have exactly n attempts."""
    keys = list(keys)
    per = df.groupBy(*keys, idx).agg(F.count(F.lit(1)).alias("_n"), F.sum("correct").alias("_c"))
    if n is not None:
        wrong = F.concat(F.lit("attempts of "), F.col(idx).cast("string"), F.lit(f" != {n}: "), F.col("_n").cast("string"))
        per = per.withColumn("_n", F.when(F.col("_n") == n, F.col("_n")).otherwise(F.raise_error(wrong).cast("bigint")))
    aggs = [F.avg(pass_at_k_value(F.col("_n"), F.col("_c"), k)).alias(f"pass@{k}") for k in ks]
    return per.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_idxs"), F.max("_n").alias("n_per_idx"))


def vote(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Most frequent answer per id with its tally; a tie goes to the answer voted first. No answer (NULL) counts as -1."""
    keys = list(keys)
    df = df.withColumn("pred", F.coalesce("pred", F.lit(-1)))
    tally = df.groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_first"))
    out = tally.groupBy(*keys, "gt").agg(
        F.max_by("pred", F.struct(F.col("_c"), -F.col("_first"))).alias("master_pred"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pred", "_c")))).alias("vote_tally"),
        F.sum("_c").alias("n_votes"),
    )
    return out.withColumn("correct", (F.col("master_pred") == F.col("gt")).cast("int"))


def vote_list(df: DataFrame, keys: Sequence[str], order: str, others: Sequence[str] = ()) -> DataFrame:
    """``vote`` with ``votes``: every vote as (round, pred, others ...), in order of rounds; the rounds of an id are few."""
    keys = list(keys)
    one = F.struct(F.col(order), F.coalesce("pred", F.lit(-1)).alias("pred"), *others)
    votes = df.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("votes"))
    return null_safe_join(vote(df, keys, order), votes, keys)


def forecast_pairs(df: DataFrame) -> DataFrame:
    """Truth and forecast under one name each; ``is_valid`` when both lists exist and are equally long."""
    have = set(df.columns)
    gt = F.coalesce(*[F.col(c) for c in ("ground_truth", "gt") if c in have])
    pred = F.coalesce(*[F.col(c) for c in ("forecast", "pred") if c in have])
    out = df.withColumn("_g", gt).withColumn("_p", pred)
    valid = F.col("_g").isNotNull() & F.col("_p").isNotNull() & (F.size("_g") == F.size("_p"))
    return out.withColumn("is_valid", valid)


def forecast_error_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of per-row MSE and MAE over valid rows, with counts of all, valid and failed rows."""
    pairs = forecast_pairs(df)

    def mean(fn):
        return F.aggregate(F.zip_with("_g", "_p", fn), F.lit(0.0), lambda a, e: a + e) / F.size("_g")

    ok = F.col("is_valid")
    return pairs.groupBy(*keys).agg(
        F.avg(F.when(ok, mean(lambda g, p: (g - p) * (g - p)))).alias("avg_mse"),
        F.avg(F.when(ok, mean(lambda g, p: F.abs(g - p)))).alias("avg_mae"),
        F.count(F.lit(1)).alias("num_entries"),
        F.count_if(ok).alias("num_non_errors"),
        F.count_if(~ok).alias("num_errors"),
    )


def forecast_error_pooled(df: DataFrame, keys: Sequence[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """MSE and MAE over all points, however they are spread over rows; NaN without points."""
    errors = F.zip_with(gt, pred, lambda g, p: p - g)
    usable = F.filter(errors, lambda e: e.isNotNull())
    per_row = df.select(
        *keys,
        F.aggregate(usable, F.lit(0.0), lambda a, e: a + e * e).alias("_s"),
        F.aggregate(usable, F.lit(0.0), lambda a, e: a + F.abs(e)).alias("_a"),
        F.size(usable).alias("_n"),
    )
    n = F.sum("_n")
    nan = F.lit(float("nan"))
    return per_row.groupBy(*keys).agg(
        F.when(n > 0, F.sum("_s") / n).otherwise(nan).alias("mse"),
        F.when(n > 0, F.sum("_a") / n).otherwise(nan).alias("mae"),
        n.alias("n_points"),
    )


def fill_forecast(steps: DataFrame, keys: Sequence[str], step: str, pred: str, last_history: str) -> DataFrame:
    """Carry the last value into missing steps of a horizon, starting from the last history value."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("filled", F.coalesce(F.last(pred, ignorenulls=True).over(w), F.col(last_history)))


def next_lookback(history: Column, filled: Column, lookback: int) -> Column:
    """Window for the next step: the last ``lookback`` values of history and forecasts so far."""
    return F.slice(F.concat(history, filled), -lookback, lookback)
