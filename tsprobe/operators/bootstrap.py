"""Bootstrap intervals of macro-F1.

Resampling n rows with replacement only changes how often each confusion cell is
drawn, so a run is reduced to its cells (at most labels squared) before any draw:
the cost per replicate no longer depends on the number of predictions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tsprobe.functions.hashing import hash_key
from tsprobe.operators.metrics import confusion, metrics_from_cells
from tsprobe.operators.ordering import null_safe_join, slice_count


def _cells_per_run(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("gt", "pred", "cnt")))
    return confusion(df, keys).groupBy(*keys).agg(cells.alias("cells"), F.sum("cnt").alias("n"))


def _macro_f1(draws: np.ndarray, gt: np.ndarray, pred: np.ndarray) -> np.ndarray:
    labels = np.unique(np.concatenate([gt, pred]))
    truth = (gt[:, None] == labels).astype(float)
    called = (pred[:, None] == labels).astype(float)
    size = draws @ truth + draws @ called
    f1 = np.divide(2 * (draws @ (truth * called)), size, out=np.zeros_like(size), where=size > 0)
    return f1.sum(axis=1) / (size > 0).sum(axis=1)


def bootstrap_scores(df: DataFrame, keys: Sequence[str], n_boot: int = 10_000, seed: int = 42, chunk: int = 250) -> DataFrame:
    """One row per (run, replicate) with its macro-F1; blocks of replicates are drawn in parallel."""
    keys = list(keys)
    runs = _cells_per_run(df, keys)
    blocks = runs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // chunk) - 1))))
    blocks = blocks.repartition(*keys, "block")
    schema = T.StructType(
        [runs.schema[k] for k in keys] + [T.StructField("replicate", T.IntegerType()), T.StructField("macro_f1", T.DoubleType())]
    )

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                gt = np.array([c["gt"] for c in row.cells])
                pred = np.array([c["pred"] for c in row.cells])
                cnt = np.array([c["cnt"] for c in row.cells], dtype=float)
                run = {k: getattr(row, k) for k in keys}
                salt = zlib.crc32(repr([str(v) for v in run.values()]).encode())
                rng = np.random.default_rng([seed, salt, int(row.block)])
                m = min(chunk, n_boot - row.block * chunk)
                scores = _macro_f1(rng.multinomial(int(cnt.sum()), cnt / cnt.sum(), size=m), gt, pred)
                yield pd.DataFrame({**{k: [v] * m for k, v in run.items()}, "replicate": row.block * chunk + np.arange(m), "macro_f1": scores})

    return blocks.mapInPandas(draw, schema)


def interval(scores: DataFrame, keys: Sequence[str], ci: float = 95.0) -> DataFrame:
    """Mean and percentile interval over replicates (their number is a parameter, so a group is bounded)."""
    tail = (100 - ci) / 200
    return scores.groupBy(*keys).agg(
        F.avg("macro_f1").alias("mean"),
        F.percentile("macro_f1", tail).alias("ci_lower"),
        F.percentile("macro_f1", 1 - tail).alias("ci_upper"),
        F.count(F.lit(1)).alias("n_boot"),
    )


def bootstrap_ci(df: DataFrame, keys: Sequence[str], n_boot: int = 10_000, seed: int = 42, ci: float = 95.0) -> DataFrame:
    """Bootstrap mean and interval of macro-F1 for every run, with the run size."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"))
    out = interval(bootstrap_scores(df, keys, n_boot, seed), keys, ci)
    return null_safe_join(out, sizes, keys) if keys else out.withColumn("sample_size", sizes.scalar())


def bootstrap_hash_scores(df: DataFrame, keys: Sequence[str], idx: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Row-level variant with hash draws, for small logs and for checking: replicate b of row i draws row h(b, i) mod n.

    Costs rows times replicates; use ``bootstrap_ci`` for anything large.
    """
    keys = list(keys)
    runs = _cells_per_run(df, keys).select(*keys, "cells", "n", _running("cells").alias("_upto"))
    bounds = runs.select(*keys, "n", "_upto")
    # narrow rows over all tasks, however few the files; the draw is hashed before the bounds of its run come along
    logged = df.select(*keys, F.col(idx).alias("_i")).repartition(slice_count(df), "_i")
    drawn = logged.select(*keys, "_i", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    drawn = drawn.select(*keys, "replicate", hash_key(seed, "replicate", "_i").alias("_h"))
    met = null_safe_join(drawn, bounds, keys) if keys else drawn.crossJoin(bounds)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of the cell that each row draws: the first whose running count passes the draw."""
        for batch in batches:
            h, n, upto = (batch.column(c) for c in ("_h", "n", "_upto"))
            draw = h.to_numpy(zero_copy_only=False) % n.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(upto).to_numpy(zero_copy_only=False))
            flat = upto.flatten().to_numpy(zero_copy_only=False)
            low = np.append(0, ends[:-1])
            first, high = low.copy(), ends - 1
            while (low < high).any():  # by halving, all rows at once
                middle = (low + high) // 2
                below = flat[middle] <= draw
                low, high = np.where(below & (low < high), middle + 1, low), np.where(below, high, middle)
            yield batch.drop_columns(["_h", "n", "_upto"]).append_column("_c", pa.array(low - first, pa.int32()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.drop("_h").schema)
    counted = met.mapInArrow(cells_of, f"{fields}, _c int").groupBy(*keys, "replicate", "_c").agg(F.count(F.lit(1)).alias("cnt"))
    named = runs.select(*keys, F.posexplode("cells").alias("_c", "_cell")).select(*keys, "_c", "_cell.gt", "_cell.pred")
    cells = null_safe_join(counted, named, [*keys, "_c"])
    return metrics_from_cells(cells.select(*keys, "replicate", "gt", "pred", "cnt"), [*keys, "replicate"])


def _running(cells: str) -> Column:
    """Inclusive running counts of an array of cells."""
    return F.transform(cells, lambda _, i: F.aggregate(F.slice(cells, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x["cnt"]))
