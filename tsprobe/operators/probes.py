"""Linear probes: logistic regressions that descend together, and ridge from one pass of moments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tsprobe.functions.series import dot
from tsprobe.operators import logistic
from tsprobe.operators.metrics import classification_metrics, metrics_from_cells
from tsprobe.operators.ordering import positions, segments
from tsprobe.operators.scaling import apply_vector_scaler, fit_vector_scaler, invert_vector_scaler
from tsprobe.operators.splits import kfold_stratified
from tsprobe.session import materialise

# The parameter grids of the probes.
C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
ALPHA_GRID = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
TIME_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


@dataclass
class ProbeResult:
    """Best parameters and scores of one probe, and its test predictions."""

    layer: int
    best_c: float
    max_iter: int
    best_cv_f1_macro: float
    test_accuracy: float
    test_f1_macro: float
    cv_scores: dict = field(default_factory=dict)
    predictions: DataFrame | None = None
    weights: np.ndarray | None = None  # one line per class (one for two classes), the intercept last

    def record(self) -> dict:
        return {
            "layer": self.layer, "grid": {"C": sorted(self.cv_scores), "max_iter": [self.max_iter]}, "best_c": self.best_c, "best_cv_f1_macro": self.best_cv_f1_macro,
            "test_accuracy": self.test_accuracy, "test_f1_macro": self.test_f1_macro,
        }


#: bytes of L-BFGS state on the driver at once; more layers than fit are fitted in several rounds
STATE_BYTES = 512 << 20


def logistic_probe_layers(
    embeddings: DataFrame, layers: Sequence[int], cs: Sequence[float] = C_GRID, folds: int = 5, max_iter: int = 1000, balanced: bool = False
) -> list[ProbeResult]:
    """Grid search over C by stratified folds and macro-F1, refit on all train rows, predictions of test: for every layer.

    ``embeddings`` has ``layer``, ``split`` (train, test), ``idx``, ``y`` and ``vec``. The labels of a layer's train rows, in
    order, are its classes; two of them have one weight vector, more have one each. A test label that train never saw is
    an error of every prediction. Fits minimise C * sum of losses + |w|^2 / 2 (intercept free), with ``balanced`` class
    weights n / (classes * rows of the class) of the rows that a fit sees. All layers, C and folds descend together
    (``operators/logistic.py``); the refits start from the mean of the chosen folds' models.
    """
    train = embeddings.where((F.col("split") == "train") & F.col("layer").isin(list(layers))).select("layer", "idx", "y", "vec")
    folded = materialise(kfold_stratified(train, "y", "idx", folds, keys=["layer"]))
    counts = folded.groupBy("layer", "fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).collect()
    d_of = {layer: max(r["d"] for r in counts if r["layer"] == layer) for layer in layers}
    labels = {layer: sorted({r["y"] for r in counts if r["layer"] == layer}) for layer in layers}
    width = {layer: 1 if len(labels[layer]) <= 2 else len(labels[layer]) for layer in layers}
    state = {layer: 8 * (2 * logistic.HISTORY + 6) * width[layer] * (d_of[layer] + 1) * (len(cs) * folds + 1) for layer in layers}
    out: dict[int, ProbeResult] = {}
    left = list(layers)
    while left:
        group = [left.pop(0)]
        while left and sum(state[x] for x in [*group, left[0]]) <= STATE_BYTES:
            group.append(left.pop(0))
        out |= _probe_group(embeddings, folded, counts, group, labels, {x: (width[x], d_of[x] + 1) for x in group}, cs, max_iter, balanced)
    return [out[layer] for layer in layers]


def _probe_group(embeddings, folded, counts, group, labels, shapes, cs, max_iter, balanced) -> dict[int, ProbeResult]:
    def fit(layer: int, c: float, held: int) -> tuple[logistic.Fit, int]:
        n = {y: sum(r["n"] for r in counts if (r["layer"], r["y"]) == (layer, y) and r["fold"] != held) for y in labels[layer]}
        seen, present = sum(n.values()), sum(v > 0 for v in n.values())
        weights = [seen / (present * n[y]) if balanced and n[y] else 1.0 for y in labels[layer]]
        return logistic.Fit(layer, c, held, tuple([*weights, 1.0] if len(weights) == 1 else weights)), max(1, seen)

    code = reduce(lambda other, layer: F.when(F.col("layer") == layer, F.array_position(F.array(*map(F.lit, labels[layer])), F.col("y"))).otherwise(other), group, F.lit(None))
    coded = folded.where(F.col("layer").isin(group)).withColumn("label", code - 1)
    rdd = logistic.blocks(coded, sum(8 * r["n"] * r["d"] for r in counts if r["layer"] in group))
    try:
        seen_folds = {layer: sorted({r["fold"] for r in counts if r["layer"] == layer}) for layer in group}
        tried = [fit(layer, c, f) for layer in group for c in cs for f in seen_folds[layer]]
        fits, sizes = [t[0] for t in tried], [t[1] for t in tried]
        states = logistic.solve(rdd, fits, [np.zeros(shapes[t.layer]) for t in fits], sizes, max_iter)
        cells = logistic.held_out_cells(rdd, fits, [s.x for s in states])
        rows = [(i, int(a), int(b), int(n)) for i, m in enumerate(cells) for (a, b), n in np.ndenumerate(m) if n]
        spark = embeddings.sparkSession
        scored = metrics_from_cells(spark.createDataFrame(rows, "fit int, gt int, pred int, cnt long"), ["fit"]).collect()
        f1 = {r["fit"]: r["macro_f1"] for r in scored}
        cv = {layer: {c: float(np.mean([f1[i] for i, t in enumerate(fits) if (t.layer, t.c) == (layer, c)])) for c in cs} for layer in group}
        best = {layer: max(cs, key=lambda c: (cv[layer][c], -list(cs).index(c))) for layer in group}
        starts = [np.mean([s.x for s, t in zip(states, fits, strict=True) if (t.layer, t.c) == (layer, best[layer])], axis=0) for layer in group]
        whole = [fit(layer, best[layer], -1) for layer in group]
        final = logistic.solve(rdd, [t[0] for t in whole], starts, [t[1] for t in whole], max_iter)
    finally:
        rdd.unpersist()
    points = {layer: s.x for layer, s in zip(group, final, strict=True)}
    test = embeddings.where((F.col("split") == "test") & F.col("layer").isin(group))
    predictions = logistic.predicted(test, points, labels)
    scores = {r["layer"]: r for r in classification_metrics(predictions.select("layer", "gt", "pred"), ["layer"]).collect()}

    def result(layer: int) -> ProbeResult:
        score = scores.get(layer) or {"accuracy": 0.0, "macro_f1": 0.0}
        mine = predictions.where(F.col("layer") == layer)
        return ProbeResult(layer, best[layer], max_iter, cv[layer][best[layer]], float(score["accuracy"]), float(score["macro_f1"]), cv[layer], mine, points[layer])

    return {layer: result(layer) for layer in group}


def logistic_probe(
    train: DataFrame, test: DataFrame, cs: Sequence[float] = C_GRID, folds: int = 5, max_iter: int = 1000, balanced: bool = False, layer: int = 0
) -> ProbeResult:
    """``logistic_probe_layers`` of one table of train rows and one of test rows (``idx``, ``y``, ``vec``)."""
    parts = [df.select(F.lit(layer).alias("layer"), F.lit(split).alias("split"), "idx", "y", "vec") for df, split in ((train, "train"), (test, "test"))]
    return logistic_probe_layers(parts[0].unionByName(parts[1]), [layer], cs, folds, max_iter, balanced)[0]


def layer_records(results: Sequence[ProbeResult], **keys: str) -> DataFrame:
    """The best-parameter records of all layers as one table, with the run's keys (model, dataset, path ...) and the time."""
    spark = results[0].predictions.sparkSession
    rows = [(*keys.values(), r.layer, sorted(r.cv_scores), r.max_iter, r.best_c, r.best_cv_f1_macro, r.test_accuracy, r.test_f1_macro) for r in results]
    names = "".join(f"{k} string, " for k in keys)
    table = spark.createDataFrame(rows, names + "layer int, grid_c array<double>, max_iter int, best_c double, best_cv_f1_macro double, test_accuracy double, test_f1_macro double")
    return table.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


# --------------------------------------------------------------------------- ridge


def centres(df: DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Means of both vectors, one partial sum per task."""
    row = df.agg(*[vector_to_array(Summarizer.mean(array_to_vector(F.col(c).cast("array<double>")))).alias(c) for c in (x, y)]).first()
    return np.array(row[x], dtype=float), np.array(row[y], dtype=float)


#: a task adds up matrices of several groups at once if one has at most this many bytes, and sends them on beyond the other
SMALL_MATRIX, HELD_MATRICES = 1 << 20, 64 << 20


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def moments(df: DataFrame, x: str, y: str, group: Column, shift: Callable[[int], np.ndarray]) -> DataFrame:
    """Lines (g, i, line) of the sum of z z' with z = (1, (x, y) - shift(g)) per ``group``, added up in the cluster.

    Shifting by the means first keeps the digits that centring would lose. Rows reach numpy as Arrow lists and are summed by
    matrix products. A task holds a bounded number of small matrices; of large ones it holds one at a time, and its
    rows are sorted by group for that.
    """

    def lines(g: int, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(m), 256):
            part = m[at : at + 256]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(part), pa.int32()), pa.array(np.arange(at, at + len(part)), pa.int32()), flat], ["g", "i", "line"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("g").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                mine = batch.filter(pa.array(groups == g))
                v = np.hstack([_vectors(mine.column("x")), _vectors(mine.column("y"))]) - shift(int(g))
                z = np.hstack([np.ones((len(v), 1)), v])
                m = z.T @ z
                if int(g) in held:
                    held[int(g)] += m
                    continue
                if held and (m.nbytes > SMALL_MATRIX or (1 + len(held)) * m.nbytes > HELD_MATRICES):
                    for other, sums in held.items():
                        yield from lines(other, sums)
                    held = {}
                held[int(g)] = m
        for g, m in held.items():
            yield from lines(g, m)

    rows = df.select(group.cast("int").alias("g"), *[F.col(c).cast("array<double>").alias(n) for c, n in ((x, "x"), (y, "y"))]).where("g IS NOT NULL")
    if 8 * (1 + len(shift(0))) ** 2 > SMALL_MATRIX:
        rows = rows.sortWithinPartitions("g")
    return rows.mapInArrow(partial, "g int, i int, line array<double>").groupBy("g", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line"))


def each_group(summed: DataFrame, size: int) -> Iterator[np.ndarray]:
    """The moment matrices in order of their groups; one at a time reaches the driver."""
    held, m = None, np.zeros((size, size))
    for r in summed.orderBy("g", "i").toLocalIterator():
        if r["g"] != held and held is not None:
            yield m
            m = np.zeros((size, size))
        held = r["g"]
        m[r["i"]] = r["line"]
    if held is not None:
        yield m


def solve_ridge(m: np.ndarray, d: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (D, H) and intercepts (H) from moments; the intercept is not penalised."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred[:d, :d] + alpha * np.eye(d), centred[:d, d:])
    return w, mean[d:] - mean[:d] @ w


def _mse(m: np.ndarray, d: int, w: np.ndarray, b: np.ndarray) -> float:
    """Mean squared error over rows and outputs, from the moments alone."""
    h = m.shape[0] - 1 - d
    coef = np.vstack([-b[None, :], -w, np.eye(h)])
    return float(np.mean(np.diag(coef.T @ m @ coef)) / m[0, 0])


@dataclass
class RidgeResult:
    best_alpha: float
    cv_mse: dict
    weights: np.ndarray
    intercept: np.ndarray

    def predict(self, x: Column) -> Column:
        """ARRAY of the H outputs; the coefficients travel as one constant."""
        lines = [{"b": float(b), "w": [float(v) for v in w]} for b, w in zip(self.intercept, self.weights.T)]
        table = F.from_json(F.lit(json.dumps(lines)), "array<struct<b double, w array<double>>>")
        return F.transform(table, lambda r: r["b"] + dot(x.cast("array<double>"), r["w"]))


def _search(df: DataFrame, x: str, y: str, group: Column, alphas: Sequence[float], growing: bool) -> RidgeResult:
    """Alpha by the folds in ``group``, refit on all rows.

    A plain fold is held out of the sum of all; of growing folds each is held out of those before it. The driver holds
    the running sum, one fold's matrix and the solver's copy: a few times (1 + D + H)^2 numbers, however many rows.
    """
    mean_x, mean_y = centres(df, x, y)
    d, size = len(mean_x), 1 + len(mean_x) + len(mean_y)
    summed = moments(df, x, y, group, lambda _, both=np.concatenate([mean_x, mean_y]): both).persist(StorageLevel.DISK_ONLY)
    try:
        errors: dict[float, list[float]] = {a: [] for a in alphas}
        whole = np.zeros((size, size))
        if not growing:
            for m in each_group(summed, size):
                whole += m
        for i, m in enumerate(each_group(summed, size)):
            fit = whole if growing else whole - m
            if not growing or i:
                for a in alphas:
                    errors[a].append(_mse(m, d, *solve_ridge(fit, d, a)))
            if growing:
                whole += m
    finally:
        summed.unpersist()
    cv = {a: float(np.mean(e)) for a, e in errors.items()}
    best = min(alphas, key=lambda a: (cv[a], list(alphas).index(a)))
    w, b = solve_ridge(whole, d, best)
    return RidgeResult(best, cv, w, b + mean_y - mean_x @ w)


def _segmented(train: DataFrame, x: str, y: str, idx: str, starts: Callable[[int], list[int]]) -> tuple[DataFrame, Column]:
    """Rows, and the number of their segment of those that begin at ``starts(number of rows)``.

    Rows of one id are in the order of a hash of their vectors. The rows stay where they are; only if a cut falls between
    rows that are equal in everything they are numbered.
    """
    rows = train.select(x, y, idx, F.lit(0).alias("_l"), F.xxhash64(x, y).alias("_h"))
    n = train.count()
    begins = [r for r in starts(n) if r < n]
    try:
        return rows, segments(rows, "_l", [idx, "_h"], {0: begins})
    except ValueError:
        numbered = materialise(positions(rows, [], [idx, "_h"], "_p"))
        return numbered, reduce(lambda a, b: a + b, [(F.col("_p") >= r).cast("int") for r in begins], F.lit(0))


def _plain_starts(folds: int) -> Callable[[int], list[int]]:
    return lambda n: [i * (n // folds) + min(i, n % folds) for i in range(1, folds)]


def _time_starts(folds: int) -> Callable[[int], list[int]]:
    def starts(n: int) -> list[int]:
        step = n // (folds + 1)
        return [n - (folds - i) * step for i in range(folds)] if step else []

    return starts


def ridge_probe(train: DataFrame, x: str, y: str, idx: str, alphas: Sequence[float] = ALPHA_GRID, folds: int = 5) -> RidgeResult:
    """Multi-output ridge, alpha by plain contiguous folds: the whole grid search is one pass over the data and one for the means.

    The ids are read three times more, for the cuts between folds; a costly ``train`` is worth writing before.
    """
    return _search(*_with(_segmented(train, x, y, idx, _plain_starts(folds)), x, y), alphas, growing=False)


def ridge_time_probe(train: DataFrame, x: str, y: str, idx: str, alphas: Sequence[float] = TIME_ALPHAS, folds: int = 5) -> RidgeResult:
    """As ``ridge_probe`` with expanding time folds: moments per time segment, training sums by prefix."""
    return _search(*_with(_segmented(train, x, y, idx, _time_starts(folds)), x, y), alphas, growing=True)


def _with(found: tuple[DataFrame, Column], x: str, y: str) -> tuple[DataFrame, str, str, Column]:
    return found[0], x, y, found[1]


def scaled_ridge(train: DataFrame, test: DataFrame, x: str, y: str, idx: str, alphas: Sequence[float] = TIME_ALPHAS, folds: int = 5) -> tuple[RidgeResult, DataFrame]:
    """Ridge on standardised features and targets, both fitted on train alone; ``pred`` of test is on the scale of ``y`` again."""
    of_x, of_y = fit_vector_scaler(train, x), fit_vector_scaler(train, y)
    scaled = apply_vector_scaler(apply_vector_scaler(train, x, of_x), y, of_y)
    fit = ridge_time_probe(scaled, x, y, idx, alphas, folds)
    out = apply_vector_scaler(test.withColumn("_x", F.col(x)), "_x", of_x).withColumn("pred", fit.predict(F.col("_x"))).drop("_x")
    return fit, invert_vector_scaler(out, "pred", of_y)


def layer_search(matrices: Iterator[np.ndarray], d: int, mean: np.ndarray, alphas: Sequence[float]) -> RidgeResult:
    """The standardised ridge of one layer from the moments of its time segments, in order, shifted by ``mean``.

    Standardising is done on the moments; weights and intercept are those of the unscaled vectors. The error of an alpha
    is in units of the scaled targets.
    """
    segments = list(matrices)
    whole = sum(segments)
    spread = np.sqrt(np.maximum(0, np.diag(whole)[1:] / whole[0, 0] - (whole[0, 1:] / whole[0, 0]) ** 2))
    spread = np.where(spread == 0, 1, spread)
    scale = np.append(1, 1 / spread)
    before, errors = np.zeros_like(whole), {a: [] for a in alphas}
    for i, m in enumerate(segments):
        m = m * scale[:, None] * scale[None, :]
        if i:
            for a in alphas:
                errors[a].append(_mse(m, d, *solve_ridge(before, d, a)))
        before += m
    cv = {a: float(np.mean(e)) if e else 0.0 for a, e in errors.items()}
    best = min(alphas, key=lambda a: (cv[a], list(alphas).index(a)))
    w, b = solve_ridge(before, d, best)
    w = w / spread[:d, None] * spread[None, d:]
    return RidgeResult(best, cv, w, b * spread[d:] + mean[d:] - mean[:d] @ w)


def ridge_layers(embeddings: DataFrame, layers: Sequence[int], x: str, y: str, idx: str, alphas: Sequence[float] = TIME_ALPHAS, folds: int = 5) -> DataFrame:
    """Test rows of every layer with ``pred`` (on the scale of ``y``) and ``best_alpha`` of the layer's scaled ridge.

    ``embeddings`` has ``layer`` and ``split`` (train, test). Cuts between segments, means and moments of all layers come from
    one pass each, and no row is moved for them; a task then searches the alphas of one layer, from as many matrices of (1 + features + targets)^2 numbers as
    there are time segments. The driver gets the fitted weights.
    """
    place = {layer: i for i, layer in enumerate(layers)}
    of_layer = reduce(lambda other, layer: F.when(F.col("layer") == layer, F.lit(place[layer])).otherwise(other), layers, F.lit(None).cast("int"))
    train = embeddings.where((F.col("split") == "train") & F.col("layer").isin(list(layers))).select(of_layer.alias("_l"), idx, x, y, F.xxhash64(x, y).alias("_h"))
    vectors = [vector_to_array(Summarizer.mean(array_to_vector(F.col(c).cast("array<double>")))).alias(f"_{i}") for i, c in enumerate((x, y))]
    known = {r["_l"]: r for r in train.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"), *vectors).collect()}
    means = [np.array([*known[i]["_0"], *known[i]["_1"]]) for i in range(len(layers))]
    dims = [len(known[i]["_0"]) for i in range(len(layers))]
    starts = {i: _time_starts(folds)(known[i]["_n"]) for i in range(len(layers))}
    try:
        segment = segments(train, "_l", [idx, "_h"], starts)
    except ValueError:  # a cut between equal rows
        train = materialise(positions(train, ["_l"], [idx, "_h"], "_p"))
        segment = F.lit(0)
        for i, begins in starts.items():
            segment = F.when(F.col("_l") == i, reduce(lambda a, b: a + b, [(F.col("_p") >= r).cast("int") for r in begins], F.lit(0))).otherwise(segment)
    summed = moments(train, x, y, F.col("_l") * (folds + 1) + segment, lambda g: means[g // (folds + 1)])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["g", "i"])
        at = int(frame["g"].iloc[0]) // (folds + 1)
        fit = layer_search((np.array(m["line"].tolist()) for _, m in frame.groupby("g")), dims[at], means[at], alphas)
        return pd.DataFrame({"l": [at], "best_alpha": [fit.best_alpha], "w": [fit.weights.ravel()], "b": [fit.intercept]})

    fitted = summed.groupBy(F.floor(F.col("g") / (folds + 1)).alias("layer")).applyInPandas(search, "l int, best_alpha double, w array<double>, b array<double>")
    models = {r["l"]: (r["best_alpha"], np.array(r["w"]).reshape(dims[r["l"]], -1), np.array(r["b"])) for r in fitted.collect()}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layer = batch.column("layer").to_numpy(zero_copy_only=False)
            best, rows, preds = np.zeros(len(layer)), [], []
            for of in np.unique(layer):
                alpha, w, b = models[place[of.item()]]
                mine = np.flatnonzero(layer == of)
                pred = _vectors(batch.column(x).take(pa.array(mine))) @ w + b
                best[mine] = alpha
                rows.append(mine)
                preds.append(pa.ListArray.from_arrays(pa.array(np.arange(0, pred.size + 1, pred.shape[1]), pa.int32()), pa.array(pred.ravel())))
            if rows:
                back = pa.array(np.argsort(np.concatenate(rows)))
                yield batch.append_column("pred", pa.concat_arrays(preds).take(back)).append_column("best_alpha", pa.array(best))

    test = embeddings.where((F.col("split") == "test") & F.col("layer").isin(list(layers)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema)
    return test.mapInArrow(predict, f"{fields}, pred array<double>, best_alpha double")
