"""Many logistic regressions at once: every pass over the rows evaluates all of them.

A grid search fits a model for each layer, C and fold. They read the same rows, so a pass works out the loss and the
gradient of all models that are not done yet, in one matrix product per block of rows, and adds them up in a tree. The
driver steps every model by its own L-BFGS; it holds numbers of models x classes x features, never rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

#: bytes of vectors per partition of the blocks, and numbers of one block's scores
PART_BYTES, SCORES = 4 << 20, 4 << 20
HISTORY = 10


@dataclass(frozen=True)
class Fit:
    """One model: its layer, C, the fold it does not see (-1: it sees all), and the weight of each class."""

    layer: int
    c: float
    held: int
    weights: tuple[float, ...]


def blocks(rows: DataFrame, n_bytes: int) -> RDD:
    """(layer, vectors, labels, folds) of rows with ``layer``, ``label`` (0, 1, ...), ``fold`` and ``vec``; persisted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layer, label, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for one in np.unique(layer):
                mine = np.flatnonzero(layer == one)
                vec = batch.column(3).take(pa.array(mine))
                x = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
                parts = [[int(one)], [len(mine)], [x.tobytes()], [label[mine].astype(np.int32).tobytes()], [fold[mine].astype(np.int32).tobytes()]]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names=["layer", "n", "x", "label", "fold"])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = rows.select(F.col("layer").cast("int"), F.col("label").cast("int"), F.col("fold").cast("int"), F.col("vec").cast("array<double>"))
    sized = fields.coalesce(max(1, n_bytes // PART_BYTES)) if n_bytes // PART_BYTES < width else fields
    packed = sized.mapInArrow(pack, "layer int, n int, x binary, label binary, fold binary")
    return packed.rdd.map(lambda r: (r.layer, np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.label, np.int32), np.frombuffer(r.fold, np.int32))).persist(StorageLevel.MEMORY_AND_DISK)


def _pieces(block: tuple, models: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block in slices of rows, with a one after each vector."""
    _, x, y, fold = block
    step = max(1, SCORES // max(1, models))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        yield np.hstack([part, np.ones((len(part), 1))]), y[at : at + step], fold[at : at + step]


def losses(block: tuple, w: np.ndarray, held: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed losses (m) and gradients (m, k, d + 1) of m models on a block; ``w`` is (m, k, d + 1), with k = 1 for two classes."""
    m, k, d = w.shape
    loss, grad = np.zeros(m), np.zeros((m * k, d))
    for x, y, fold in _pieces(block, m * k):
        z = (x @ w.reshape(m * k, d).T).reshape(len(x), m, k)
        use = (fold[:, None] != held[None, :]) * weights[:, y].T
        if k == 1:
            z = z[:, :, 0]
            loss += ((np.logaddexp(0, z) - y[:, None] * z) * use).sum(axis=0)
            r = (0.5 * (1 + np.tanh(z / 2)) - y[:, None]) * use
        else:
            z -= z.max(axis=2, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=2)
            loss += ((np.log(total) - z[np.arange(len(x)), :, y]) * use).sum(axis=0)
            r = p / total[:, :, None]
            r[np.arange(len(x)), :, y] -= 1
            r *= use[:, :, None]
        grad += r.reshape(len(x), -1).T @ x
    return loss, grad.reshape(m, k, d)


def classes_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Predicted class numbers (rows, m) for vectors with a one after them."""
    m, k, d = w.shape
    z = (x @ w.reshape(m * k, d).T).reshape(len(x), m, k)
    return (z[:, :, 0] > 0).astype(int) if k == 1 else z.argmax(axis=2)


def _summed(rdd: RDD, by_layer: dict, work: Callable) -> dict:
    """The sums over all blocks of what ``work`` returns for a block and its layer's share of ``by_layer``."""
    sent = rdd.context.broadcast(by_layer)

    def task(part: Iterator[tuple]) -> Iterator[dict]:
        total: dict = {}
        for block in part:
            if block[0] in sent.value:
                new = work(block, *sent.value[block[0]])
                old = total.get(block[0])
                total[block[0]] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
        yield total

    def add(a: dict, b: dict) -> dict:
        return {key: tuple(x + y for x, y in zip(a[key], b[key], strict=True)) if key in a and key in b else a.get(key, b.get(key)) for key in a.keys() | b.keys()}

    try:
        return rdd.mapPartitions(task).treeReduce(add)
    finally:
        sent.unpersist()


def _layers(fits: Sequence[Fit], which: Sequence[int], points: Sequence[np.ndarray]) -> dict[int, tuple[list[int], tuple]]:
    out: dict[int, tuple[list[int], tuple]] = {}
    for layer in sorted({fits[i].layer for i in which}):
        mine = [i for i in which if fits[i].layer == layer]
        out[layer] = mine, (np.stack([points[i] for i in mine]), np.array([fits[i].held for i in mine]), np.array([fits[i].weights for i in mine]))
    return out


@dataclass
class Descent:
    """L-BFGS of one model with halved steps; ``trial`` is the point that the next pass evaluates."""

    x: np.ndarray
    tol: float
    f: float = np.inf
    g: np.ndarray | None = None
    step: float = 1.0
    iterations: int = 0
    done: bool = False
    past: deque = field(default_factory=lambda: deque(maxlen=HISTORY))

    def __post_init__(self):
        self.trial, self.direction = self.x, np.zeros_like(self.x)

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.g is not None:
            if not f <= self.f + 1e-4 * self.step * (self.g * self.direction).sum() + 1e-12 * abs(self.f):
                self.step /= 2
                self.done = self.step < 1e-12
                self.trial = self.x + self.step * self.direction
                return
            s, y = self.trial - self.x, g - self.g
            if (s * y).sum() > 1e-12 * np.sqrt((s * s).sum() * (y * y).sum()):
                self.past.append((s, y, 1 / (s * y).sum()))
        self.x, self.f, self.g = self.trial, f, g
        self.iterations += 1
        if np.abs(g).max() <= self.tol:
            self.done = True
            return
        q, taken = g.copy(), []
        for s, y, rho in reversed(self.past):
            a = rho * (s * q).sum()
            taken.append(a)
            q -= a * y
        if self.past:
            s, y, rho = self.past[-1]
            q *= 1 / (rho * (y * y).sum())
        for (s, y, rho), a in zip(self.past, reversed(taken), strict=True):
            q += (a - rho * (y * q).sum()) * s
        self.direction = -q
        self.step = 1.0 if self.past else min(1.0, 1 / np.sqrt((g * g).sum()))
        self.trial = self.x + self.step * self.direction


def solve(rdd: RDD, fits: Sequence[Fit], starts: Sequence[np.ndarray], sizes: Sequence[float], max_iter: int = 1000, tol: float = 1e-6) -> list[Descent]:
    """Minimise, for every fit, the mean over its ``size`` of C times the weighted losses plus half the squared weights, the intercept left free.

    A model is done when no entry of the gradient of that mean (of losses, without C) is above ``tol``, or after ``max_iter`` steps.
    """
    states = [Descent(np.array(x, float), tol) for x in starts]
    while which := [i for i, s in enumerate(states) if not s.done and s.iterations < max_iter]:
        asked = _layers(fits, which, [s.trial for s in states])
        found = _summed(rdd, {layer: share for layer, (_, share) in asked.items()}, losses)
        for layer, (mine, _) in asked.items():
            for i, f, g in zip(mine, *found[layer], strict=True):
                free = states[i].trial.copy()
                free[:, -1] = 0
                states[i].tell((f + (free * free).sum() / (2 * fits[i].c)) / sizes[i], (g + free / fits[i].c) / sizes[i])
    return states


def held_out_cells(rdd: RDD, fits: Sequence[Fit], points: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Rows by label and predicted class, of each model's held-out fold."""

    def count(block: tuple, w: np.ndarray, held: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray]:
        out = np.zeros((len(w), weights.shape[1], weights.shape[1]), np.int64)
        for x, y, fold in _pieces(block, w.shape[0] * w.shape[1]):
            row, model = np.nonzero(fold[:, None] == held[None, :])
            np.add.at(out, (model, y[row], classes_of(x, w)[row, model]), 1)
        return (out,)

    asked = _layers(fits, range(len(fits)), points)
    found = _summed(rdd, {layer: share for layer, (_, share) in asked.items()}, count)
    cells: dict[int, np.ndarray] = {}
    for layer, (mine, _) in asked.items():
        cells |= dict(zip(mine, found[layer][0], strict=True))
    return [cells[i] for i in range(len(fits))]


def predicted(rows: DataFrame, points: dict[int, np.ndarray], labels: dict[int, list[int]]) -> DataFrame:
    """idx, gt, pred and layer of rows with ``layer``, ``idx``, ``y`` and ``vec``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layer = batch.column(2).to_numpy(zero_copy_only=False)
            pred = np.zeros(batch.num_rows, np.int32)
            for one in np.unique(layer):
                mine = np.flatnonzero(layer == one)
                x = batch.column(3).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                pred[mine] = np.array(labels[int(one)])[classes_of(np.hstack([x, np.ones((len(mine), 1))]), points[int(one)][None])[:, 0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), batch.column(2)], names=["idx", "gt", "pred", "layer"])

    idx = rows.schema["idx"].dataType.simpleString()
    asked = rows.select("idx", F.col("y").cast("int"), F.col("layer").cast("int"), F.col("vec").cast("array<double>"))
    return asked.mapInArrow(run, f"idx {idx}, gt int, pred int, layer int")
