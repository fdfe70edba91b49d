"""Nearest neighbours, exact with pruning or approximate by hashing, and kNN probes.

Train rows are dealt into cells: a cell is what is nearest to one of a bounded number of pivot rows. Cells are packed into
places of bounded bytes (a cell that is larger has several). A query row is searched in the place of its own cell first,
own cell before others; the k-th distance found there rules out every other cell that the triangle inequality puts beyond
it, and the row visits the places that have a cell left. The result is exact; what is pruned is proven to be too far.
``visited_pairs`` counts the pairs. The approximate search deals rows by the signs of random projections instead, and a
query visits the cells whose signs it is nearest to having.

Places meet query rows in co-groups: a train row travels once for each chunk of queries, a query row once for each place
that it visits, however many cells of the place it visits there. Only each query row's best ``k`` of a place leave a task.
All pairs that nothing rules out are worked out, so vectors without clusters cost the product of both sides; their tasks
hold one place, one chunk of queries and one tile of distances at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tsprobe.functions.hashing import hash_key
from tsprobe.operators.metrics import classification_metrics
from tsprobe.operators.splits import kfold_stratified
from tsprobe.operators.windows import majority
from tsprobe.session import materialise

#: bytes of the vectors of a place, and of the query rows that meet it in one task
BLOCK_BYTES = 32 << 20
#: bytes of one distance matrix; a cell is worked off in tiles of query rows and train rows
TILE_BYTES = 32 << 20
#: query rows of a tile
TILE_ROWS = 4096
#: pivot rows at most, and rows for each
PIVOTS, PIVOT_ROWS = 256, 512
K_GRID = (1, 3, 5, 7, 9, 11, 15, 21)
FOUND = "idx long, nb_idx long, nb_y int, dist double"


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
        return 1.0 - (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)).T
    if metric == "euclidean":
        # direct differences, a few query rows at a time: no cancellation, bounded memory
        return np.concatenate([np.sqrt(((row[None, :] - b) ** 2).sum(axis=1))[None, :] for row in a])
    if metric == "manhattan":
        return np.concatenate([np.abs(row[None, :] - b).sum(axis=1)[None, :] for row in a])
    raise ValueError(f"unknown metric {metric!r}")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which have no direction."""
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n == 0, 1, n)[:, None], n == 0


def _places(rows: np.ndarray, cap: int, order: Sequence[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """First place and number of places of each cell, and of all: cells share a place of ``cap`` rows, in ``order``."""
    first, chunks, at, filled = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for cell in order:
        if filled and filled + rows[cell] > cap:
            at, filled = at + 1, 0
        first[cell] = at
        if rows[cell] > cap:
            chunks[cell] = -(-rows[cell] // cap)
            at += chunks[cell]
        else:
            filled += rows[cell]
    return first, chunks, at + (filled > 0)


def _chain(points: np.ndarray) -> list[int]:
    """All points, each followed by the nearest one that is left, so that neighbours share places."""
    left, out = list(range(len(points))), []
    while left:
        at = 0 if not out else int(((points[left] - points[out[-1]]) ** 2).sum(axis=1).argmin())
        out.append(left.pop(at))
    return out


@dataclass
class Cells:
    """Where train rows and queries go: the pivots, the radius and number of rows around each, and places of cells.

    Rows without a direction (cosine) have no place on the sphere: they are in a cell after all others, which every query
    visits, and visit all cells themselves.
    """

    pivots: np.ndarray
    metric: str
    radius: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # the first place of each cell, and how many it has
    chunks: np.ndarray
    places: int

    def gaps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots in a metric that is in the order of the asked one, and rows that have none."""
        if self.metric == "manhattan":
            return _distances(x, self.pivots, "manhattan"), np.zeros(len(x), bool)
        p, lost = self.pivots, np.zeros(len(x), bool)
        if self.metric == "cosine":
            (x, lost), p = _unit(x), _unit(p)[0]
        # one matrix product: the digits it loses are in ``room``
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T)), lost

    def room(self, x: np.ndarray) -> np.ndarray:
        """More than what rounding can change of a row's gaps and of the radii."""
        scale = 2 if self.metric == "cosine" else np.abs(x).sum(axis=1) + np.abs(self.pivots).sum(axis=1).max() + self.radius.max()
        return 4e-6 * scale

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps, lost = self.gaps(x)
        near = gaps.argmin(axis=1)
        return np.where(lost, len(self.pivots), near), gaps[np.arange(len(x)), near]

    def reach(self, worst: np.ndarray) -> np.ndarray:
        """The k-th distance so far in the metric of the gaps, with room for rounding."""
        worst = worst + 2e-9
        return np.sqrt(2 * worst) if self.metric == "cosine" else worst

    def visits(self, x: np.ndarray, worst: np.ndarray | None) -> np.ndarray:
        """Which cells each row visits: its own at first, and once it knows its k-th distance all within reach."""
        gaps, lost = self.gaps(x)
        if worst is None:
            own = np.zeros((len(x), len(self.rows)), bool)
            own[np.arange(len(x)), gaps.argmin(axis=1)] = True
            return own & (self.rows > 0)
        near = np.ones((len(x), len(self.rows)), bool)
        near[:, :-1] = ~(gaps - self.radius[:-1] > (self.reach(worst) + self.room(x))[:, None]) | lost[:, None]
        return near & (self.rows > 0)


def _with_home(train: DataFrame, cells: Cells) -> DataFrame:
    """``home`` (number of the cell) and ``gap`` of each train row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, gap = cells.home(_matrix(batch.column("vec")))
                yield batch.append_column("home", pa.array(home, pa.int32())).append_column("gap", pa.array(gap))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema)
    return train.mapInArrow(run, f"{fields}, home int, gap double")


def _fit_cells(train: DataFrame, metric: str, n: int, d: int) -> Cells:
    """Pivots by hashing, one for ``PIVOT_ROWS`` rows but at most ``PIVOTS``; their radius and rows in one pass."""
    wanted = max(1, min(PIVOTS, -(-n // PIVOT_ROWS)))
    rows = train.orderBy(hash_key("pivot", "idx"), "idx").limit(wanted).select("vec").collect()
    cells = Cells(np.array([r["vec"] for r in rows], float).reshape(len(rows), d), metric, *[np.zeros(0)] * 4, 0)
    found = _with_home(train.select("vec"), cells).groupBy("home").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect()
    cells.radius, cells.rows = np.zeros(len(rows) + 1), np.zeros(len(rows) + 1, np.int64)
    for r in found:
        cells.radius[r["home"]], cells.rows[r["home"]] = r["r"], r["n"]
    points = _unit(cells.pivots)[0] if metric == "cosine" else cells.pivots
    cells.first, cells.chunks, cells.places = _places(cells.rows, _cap(d), [*_chain(points), len(rows)])
    return cells


def _cap(d: int) -> int:
    """Rows of a place, and of a chunk of queries."""
    return max(1, BLOCK_BYTES // (8 * d))


def _dealt(homed: DataFrame, first: np.ndarray, chunks: np.ndarray, parts: int) -> DataFrame:
    """Train rows with their ``place``, once for each part of the queries."""
    at, n = (F.get(F.array(*[F.lit(int(x)) for x in each]), F.col("home")) for each in (first, chunks))
    place = (at + F.pmod(hash_key("chunk", "idx"), n)).cast("int")
    return homed.withColumn("place", place).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _part(parts: int) -> Column:
    return (hash_key("part", "idx") % parts).cast("int").alias("part")


def _routed(queries: DataFrame, first: np.ndarray, chunks: np.ndarray, places: int, wanted: Callable, had: Callable | None = None) -> DataFrame:
    """Query rows, once for each place with a cell that they visit (``wanted``), but for places that they ``had``."""
    inside = np.zeros((len(first), places), np.float32)
    for cell, (at, n) in enumerate(zip(first, chunks, strict=True)):
        inside[cell, at : at + n] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("vec"))
                worst = part.column("worst").to_numpy(zero_copy_only=False) if "worst" in part.schema.names else None
                go = wanted(x, worst).astype(np.float32) @ inside > 0
                if had is not None:
                    go &= ~(had(x, None).astype(np.float32) @ inside > 0)
                row, place = np.nonzero(go)
                yield part.take(pa.array(row)).append_column("place", pa.array(place, pa.int32()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{fields}, place int")


class _Tile:
    """The best ``k`` so far of some query rows, and the distance beyond which a train row is of no use to each."""

    def __init__(self, q: np.ndarray, metric: str, k: int, worst: np.ndarray, folds: np.ndarray | None):
        self.q, self.metric, self.k, self.worst, self.folds = q, metric, k, worst.copy(), folds
        self.squares = (q**2).sum(axis=1)
        self.held, self.size, self.pairs = [], 0, 0

    def meet(self, rows: np.ndarray, t: np.ndarray, at: int, ids: np.ndarray, folds: np.ndarray | None) -> None:
        """Work off ``rows`` against a cell's vectors, which are train rows ``at`` and on; one tile of distances at a time."""
        self.pairs += len(rows) * len(t)
        step = max(1, TILE_BYTES // (8 * max(1, len(rows))))
        for first in range(0, len(t), step):
            part = t[first : first + step]
            near, slack = self.near(rows, part)
            if folds is not None:
                near[self.folds[rows, None] == folds[None, first : first + step]] = np.inf
            worst = self.worst[rows]
            if part.shape[0] >= self.k and np.isinf(worst).any():  # the k-th distance of the tile is a bound
                kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + slack
                worst = np.minimum(worst, np.sqrt(np.maximum(0, kth)) if self.metric == "euclidean" else kth)
            # what rounding to nine places and the matrix product may change is let in and measured
            worst = worst + 1e-9
            hit = near <= ((worst**2 if self.metric == "euclidean" else worst) + slack)[:, None]
            if np.isinf(worst).any():
                hit &= np.isfinite(near)
            row, column = np.nonzero(hit)
            if len(row):
                self.add(rows[row], at + first + column, np.round(self.exact(rows[row], part, column), 9), ids)

    def near(self, rows: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances (euclidean: their squares) by one matrix product, and how far they may be off."""
        q = self.q[rows]
        if self.metric == "manhattan":
            return _distances(q, t, "manhattan"), np.full(len(rows), 1e-12) * np.abs(q).sum(axis=1)
        out = q @ t.T
        off = (q.shape[1] + 8) * 1e-15
        if self.metric == "cosine":
            return np.subtract(1, out, out=out), np.full(len(rows), 2 * off)
        squares = (t**2).sum(axis=1)
        out *= -2
        out += self.squares[rows, None]
        out += squares[None, :]
        return out, off * (self.squares[rows] + squares.max())

    def exact(self, rows: np.ndarray, t: np.ndarray, column: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows)), max(1, TILE_BYTES // (16 * max(1, t.shape[1])))
        for at in range(0, len(rows), step):
            a, b = self.q[rows[at : at + step]], t[column[at : at + step]]
            if self.metric == "cosine":
                out[at : at + step] = 1 - np.einsum("ij,ij->i", a, b)
            elif self.metric == "euclidean":
                out[at : at + step] = np.sqrt(((a - b) ** 2).sum(axis=1))
            else:
                out[at : at + step] = np.abs(a - b).sum(axis=1)
        return out

    def add(self, rows: np.ndarray, found: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        some = (dist <= self.worst[rows]) & np.isfinite(dist)
        self.held.append((rows[some], found[some], dist[some]))
        self.size += int(some.sum())
        if self.size > 4 * self.k * len(self.q) + (1 << 16):
            self.settle(ids)

    def settle(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best ``k`` of each row, ties by id; a train row that was met in two cells counts once."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, found, dist = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids[found], dist, rows))
        rows, found, dist = rows[order], found[order], dist[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (ids[found[1:]] != ids[found[:-1]]))[: len(rows)]
        rows, found, dist = rows[new], found[new], dist[new]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = place == self.k - 1
        self.worst[rows[full]] = np.minimum(self.worst[rows[full]], dist[full])
        best = place < self.k
        self.held, self.size = [(rows[best], found[best], dist[best])], int(best.sum())
        return self.held[0]


def _useful(t: np.ndarray, home: np.ndarray, ids: np.ndarray, folds: np.ndarray | None, k: int) -> np.ndarray:
    """Rows by cell; of rows that are equal in vector, cell and fold only the ``k`` with the least ids can be an answer."""
    keys = np.hstack([t + 0.0, home[:, None], np.zeros((len(t), 1)) if folds is None else folds[:, None]])
    same = np.unique(np.ascontiguousarray(keys).view(f"V{keys.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    kept = np.sort(order[place < k])
    return kept[np.argsort(home[kept], kind="stable")]


def _search(train: DataFrame, queries: DataFrame, k: int, metric: str, visits: Callable, other_fold: bool = False, own: bool = True, count: bool = False) -> DataFrame:
    """The best ``k`` of each query row in each of its places, or (``count``) the pairs that this takes.

    Both sides have ``place`` and ``part``. With ``own`` a row without a bound begins with its own cell; ``visits`` says which
    cells it then visits.
    """

    def best(place: pa.Table, asked: pa.Table) -> pa.Table:
        out, pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))], 0
        if len(place) and len(asked):
            q, t = _matrix(asked.column("vec")), _matrix(place.column("vec"))
            q_idx, t_idx, t_y, home = (c.to_numpy() for c in (asked.column("idx"), place.column("idx"), place.column("y"), place.column("home")))
            q_fold, t_fold = (x.column("fold").to_numpy() if other_fold else None for x in (asked, place))
            kept = _useful(t, home, t_idx, t_fold, k)
            t, t_idx, t_y, home = t[kept], t_idx[kept], t_y[kept], home[kept]
            t_fold = t_fold[kept] if other_fold else None
            raw = q
            if metric == "cosine":
                q, t = _unit(q)[0], _unit(t)[0]
            worst = asked.column("worst").to_numpy() if "worst" in asked.column_names else np.full(len(q), np.inf)
            cells, first = np.unique(home, return_index=True)
            spans = list(zip(cells.tolist(), first.tolist(), [*first[1:].tolist(), len(home)], strict=True))
            for at in range(0, len(q), TILE_ROWS):
                end = min(len(q), at + TILE_ROWS)
                tile = _Tile(q[at:end], metric, k, worst[at:end], q_fold[at:end] if other_fold else None)
                mine = np.zeros((end - at, 1), bool)
                rounds = [lambda x, _: visits(x, None)] if own and "worst" not in asked.column_names else []
                for go in [*rounds, visits]:
                    wanted = go(raw[at:end], tile.worst)
                    wanted, mine = wanted & ~mine, mine | wanted
                    for cell, a, b in spans:
                        rows = np.flatnonzero(wanted[:, cell])
                        if len(rows):
                            tile.meet(rows, t[a:b], a, t_idx, t_fold[a:b] if other_fold else None)
                    rows, found, dist = tile.settle(t_idx)
                pairs += tile.pairs
                out.append((q_idx[at + rows], t_idx[found], t_y[found], dist))
        if count:
            return pa.table({"pairs": pa.array([pairs], pa.int64())})
        idx, nb_idx, nb_y, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"idx": pa.array(idx, pa.int64()), "nb_idx": pa.array(nb_idx, pa.int64()), "nb_y": pa.array(nb_y.astype(np.int32)), "dist": pa.array(dist)})

    return train.groupBy("place", "part").cogroup(queries.groupBy("place", "part")).applyInArrow(best, "pairs long" if count else FOUND)


def _shape(train: DataFrame, test: DataFrame) -> tuple[int, int, int]:
    """Train rows, test rows and dimensions."""
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    return shape["n"], test.count(), max(1, shape["d"] or 1)


def _parts(spark: SparkSession, asked: int, places: int, d: int) -> int:
    """Chunks of queries: of bounded bytes, and where tables are small so many that all cores have a place to search."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, -(-asked // _cap(d)), min(-(-asked // TILE_ROWS), -(-2 * cores // max(1, places))))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("idx").orderBy("dist", "nb_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sides(train: DataFrame, test: DataFrame, other_fold: bool) -> tuple[DataFrame, DataFrame]:
    fold = ["fold"] if other_fold else []

    def vec(df: DataFrame) -> Column:
        kept = df.schema["vec"].dataType.simpleString() in ("array<float>", "array<double>")
        return (F.col("vec") if kept else F.col("vec").cast("array<double>")).alias("vec")

    of_train = train.select(F.col("idx").cast("long").alias("idx"), F.col("y").cast("int").alias("y"), vec(train), *fold)
    return of_train, test.select(F.col("idx").cast("long").alias("idx"), vec(test), *fold)


def _rounds(train: DataFrame, test: DataFrame, k: int, metric: str, other_fold: bool) -> tuple[Cells, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, train rows by place, the query rows on their first and on their second round, and what the first one found."""
    n, asked_rows, d = _shape(train, test)
    train, test = _sides(train, test, other_fold)
    test = test.where(F.lit(n > 0))  # without train rows nothing is asked
    cells = _fit_cells(train, metric, n, d)
    where = (cells.first, cells.chunks, cells.places)
    parts = _parts(train.sparkSession, asked_rows, cells.places, d)
    dealt = _dealt(_with_home(train, cells).drop("gap"), cells.first, cells.chunks, parts)
    asked = _routed(test, *where, cells.visits).select("*", _part(parts))
    near = _ranked(_search(dealt, asked, k, metric, cells.visits, other_fold), k)
    so_far = near.groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("dist", "nb_idx", "nb_y"))).alias("found"), F.when(F.count("*") == k, F.max("dist")).otherwise(float("inf")).alias("worst")
    )
    so_far = materialise(so_far)  # k rows a query: bounds of the second round, and part of the result
    again = test.join(so_far.select("idx", "worst"), "idx", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    again = _routed(again, *where, lambda x, worst: cells.visits(x, worst), cells.visits).select("*", _part(parts))
    return cells, dealt, asked, again, so_far.select("idx", F.inline("found")).select("idx", "nb_idx", "nb_y", "dist")


def nearest(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine", other_fold: bool = False) -> DataFrame:
    """The ``k`` nearest train rows of every test row: (idx, rank, nb_idx, nb_y, dist); ties by smaller nb_idx.

    Inputs have ``idx``, ``y`` and ``vec`` (and ``fold`` with ``other_fold``, which keeps
    only neighbours of another fold). Distances are rounded to nine places.
    """
    if metric not in ("cosine", "euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    cells, dealt, _, again, found = _rounds(train, test, k, metric, other_fold)
    return _ranked(found.unionByName(_search(dealt, again, k, metric, cells.visits, other_fold)), k)


def visited_pairs(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """One row: the pairs whose distance ``nearest`` works out, and the pairs of the full product."""
    cells, dealt, asked, again, _ = _rounds(train, test, k, metric, False)
    met = [_search(dealt, queries, k, metric, cells.visits, count=True) for queries in (asked, again)]
    total = met[0].unionByName(met[1]).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return total.withColumn("product", F.lit(train.count() * test.count()))


def nearest_approximate(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine", tables: int = 4, bits: int = 6, probes: int = 12, seed: int = 0) -> DataFrame:
    """As ``nearest``, but only among train rows whose hashes a query row probes: what it misses depends on the parameters.

    A hash is the signs of ``bits`` random projections, after the mean of a sample of train is taken off. Each of ``tables``
    independent hashes has 2^bits cells, of which a query probes those that it would fall into if the least of its
    projections changed sign. The share of pairs looked at is about ``tables * probes / 2^bits`` at most; more tables or
    probes find more. Cells are packed into places like those of ``nearest``, so that no bucket is too large for a task.
    """
    n, asked_rows, d = _shape(train, test)
    train, test = _sides(train, test, False)
    test = test.where(F.lit(n > 0))
    sample = train.orderBy(hash_key("pivot", "idx"), "idx").limit(PIVOTS).select("vec").collect()
    known = np.array([r["vec"] for r in sample], float).reshape(len(sample), d)
    centre = (_unit(known)[0] if metric == "cosine" else known).mean(axis=0) if len(known) else np.zeros(d)
    planes = np.random.default_rng(seed).normal(size=(d, tables * bits))
    codes = (np.arange(1 << bits)[:, None] >> np.arange(bits)[None, :] & 1).astype(bool)

    def projected(x: np.ndarray) -> np.ndarray:
        x = _unit(x)[0] if metric == "cosine" else x
        return ((x - centre) @ planes).reshape(len(x), tables, bits)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = ((projected(_matrix(batch.column("vec"))) > 0) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
                row = np.repeat(np.arange(batch.num_rows), tables)
                yield batch.take(pa.array(row)).append_column("home", pa.array(code.ravel(), pa.int32()))

    def visits(x: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(x), tables << bits), bool)
        for at in range(0, len(x), 1024):
            margin = projected(x[at : at + 1024])
            cost = (np.where((margin > 0)[:, :, None, :] == codes[None, None], 0, margin[:, :, None, :] ** 2)).sum(axis=3)
            bound = np.partition(cost, min(probes, cost.shape[2]) - 1, axis=2)[:, :, min(probes, cost.shape[2]) - 1]
            out[at : at + 1024] = (cost <= bound[:, :, None]).reshape(len(margin), -1)
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.schema)
    homed = train.mapInArrow(placed, f"{fields}, home int")
    rows = np.zeros(tables << bits, np.int64)
    for r in homed.groupBy("home").count().collect():
        rows[r["home"]] = r["count"]
    first, chunks, places = _places(rows, _cap(d), range(len(rows)))
    parts = _parts(train.sparkSession, asked_rows, places, d)
    asked = _routed(test, first, chunks, places, visits).select("*", _part(parts))
    return _ranked(_search(_dealt(homed, first, chunks, parts), asked, k, metric, visits, own=False).distinct(), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the exact neighbours, how many of them are found, and their share."""
    both = exact.select("idx", "nb_idx").join(found.select("idx", "nb_idx", F.lit(1).alias("hit")), ["idx", "nb_idx"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))


def _ranked_labels(neighbours: DataFrame) -> DataFrame:
    """Neighbour labels of each row, nearest first (an array of at most k)."""
    return neighbours.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("rank", "nb_y")))["nb_y"].alias("labels"))


def knn_predict(train: DataFrame, test: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Majority label of the ``k`` nearest train rows; a tie goes to the smallest label."""
    votes = _ranked_labels(nearest(train, test, k, metric))
    out = test.select("idx", F.col("y").alias("gt")).join(votes, "idx", "left")
    return out.select("idx", "gt", majority(F.col("labels"))["label"].alias("pred"))


def knn_cv(train: DataFrame, ks: Sequence[int] = K_GRID, folds: int = 5, metric: str = "cosine") -> DataFrame:
    """Mean macro-F1 over stratified folds for every k, from one neighbour search."""
    folded = materialise(kfold_stratified(train, "y", "idx", folds))  # searched twice, scored once
    votes = _ranked_labels(nearest(folded, folded, max(ks), metric, other_fold=True))
    rows = folded.select("idx", F.col("y").alias("gt"), "fold").join(votes, "idx")
    tried = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    tried = tried.withColumn("pred", majority(F.slice("labels", 1, F.col("k")))["label"])
    scored = classification_metrics(tried.select("k", "fold", "gt", "pred"), ["k", "fold"])
    return scored.groupBy("k").agg(F.avg("macro_f1").alias("cv_f1"))


def knn_grid(train: DataFrame, test: DataFrame, ks: Sequence[int] = K_GRID, folds: int = 5, metric: str = "cosine") -> DataFrame:
    """Test predictions with the k of the best cross-validated macro-F1 (ties: the first k)."""
    best = knn_cv(train, ks, folds, metric).agg(F.max_by("k", F.struct(F.round("cv_f1", 9), -F.col("k")))).scalar()
    votes = _ranked_labels(nearest(train, test, max(ks), metric))
    out = test.select("idx", F.col("y").alias("gt")).join(votes, "idx", "left").withColumn("k", best)
    return out.select("idx", "gt", "k", majority(F.slice("labels", 1, F.col("k")))["label"].alias("pred"))
