"""Embedding whitening: the leading components by Chebyshev-filtered subspace iteration over distributed passes, then the rows on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import table, written

#: Components returned, further columns of the iterated block, and degree of a filter.
COMPONENTS, GUARD, DEGREE = 4, 8, 10
#: A component is certified once its residual and, where it lies apart from the next, its angle's bound are under these (shares of the largest eigenvalue).
RESIDUAL, ANGLE = 1e-13, 1e-10
#: Filters at most; a spectrum with gaps under ANGLE stops here, with the residuals it has.
SWEEPS = 40
#: Multiplier of the grid on which vectors are fitted.
GRID = 256
SEED = 13
#: Tasks that add up the sums of the others.
REDUCERS = 8
#: Vectors of a part of a batch; the grid's entries end at this size.
PART, LARGEST = 4096, 1 << 61


def grid(vector: Column) -> Column:
    """The vector on the grid, as longs: floor(GRID * entry), of doubles. Null for a null vector and one with a null or non-finite entry. Entries end at LARGEST on either side."""
    entries = vector.cast("array<double>")
    fit = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(entries, lambda x: F.floor(F.greatest(F.least(x * float(GRID), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Space:
    """What is known of the fit list: number of vectors, sums and largest entry of each dimension; and its components."""

    n: int
    sums: list[int]
    largest: int
    trace: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None  # a column a component
    residuals: np.ndarray | None = None
    identity_error: float = 0.0
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole parts are taken off as integers, so no digits go where the mean is large."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact; null where it passes 64 bits."""
        size = self.n * 2 * max(self.largest, 1)
        if len(self.sums) * size * size < 1 << 63:
            y = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        out = []
        for row in x.tolist():
            d = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True))
            out.append(d if d < 1 << 63 else None)
        return out


def _summed(fit: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """Sum over the fit list of make(part), an array of `width` numbers. Tasks add up their parts, REDUCERS tasks the tasks' sums, and the driver theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for lo in range(0, len(x), PART):
                total += make(x[lo : lo + PART])
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for batch in batches:
            for own in batch.column(0):
                total += np.frombuffer(own.as_py())
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = fit.mapInArrow(run, "sums binary").repartition(REDUCERS).mapInArrow(add, "sums binary").collect()  # REDUCERS rows at most
    return sum((np.frombuffer(r["sums"]) for r in sums), np.zeros(width))


def _times(fit: DataFrame, space: Space, q: np.ndarray) -> np.ndarray:
    """The covariance times a block: one pass of centred X'(XQ) / n over the fit list."""
    d, k = q.shape
    shared = fit.sparkSession.sparkContext.broadcast((space, q))  # a block of d x k numbers

    def part(x: np.ndarray) -> np.ndarray:
        own, block = shared.value
        y = own.centred(x)
        return (y.T @ (y @ block)).ravel()

    space.passes += 1
    return _summed(fit, d * k, part, d).reshape(d, k) / space.n


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of degree DEGREE of the covariance times q: small over the unwanted spectrum 0 to `high`, scaled by its value at `top`.

    The three-term recurrence runs over passes; dividing by the value at `top` in each step keeps numbers in range.
    """
    half = high / 2
    sigma = first = half / (top - half)
    old, new = q, (times(q) - half * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - sigma)
        old, new = new, (times(new) - half * new) * (2 * following / half) - old * (sigma * following)
        sigma = following
    return new


def fit_components(fit: DataFrame, space: Space, components: int = COMPONENTS, guard: int = GUARD) -> Space:
    """The leading components of the covariance of the fit list (column x, distinct vectors).

    A random block is multiplied by a Chebyshev filter, made orthonormal (QR) and rotated onto its Ritz vectors, until the residuals of the wanted
    pairs are certified: the largest |Vq - eq| is under RESIDUAL of the largest eigenvalue, and, where a component's eigenvalue lies apart
    from all others of the block, residual over distance is under ANGLE. Each product with the covariance is one distributed pass; the driver holds blocks of dimension x (components + guard).
    A block as wide as the dimension needs no filter. Equal eigenvalues give some basis of their space.
    """
    d = len(space.sums)
    k = min(d, components + guard)
    wanted = min(d, components)
    times = lambda q: _times(fit, space, q)
    shared = fit.sparkSession.sparkContext.broadcast(space)
    space.trace = float(_summed(fit, 1, lambda x: np.array([np.square(shared.value.centred(x)).sum()]), d)[0]) / space.n
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, k)))[0]
    for _ in range(SWEEPS):
        product = times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        turn, values = turn[:, ::-1], np.maximum(values[::-1], 0.0)
        q, product = q @ turn, product @ turn
        residual = np.linalg.norm(product - q * values, axis=0)[:wanted]
        space.values, space.vectors, space.residuals = values[:wanted], q[:, :wanted], residual
        top = values[0]
        apart = np.array([min((abs(values[i] - values[j]) for j in range(k) if j != i), default=top) for i in range(wanted)])
        angle = residual / np.maximum(apart, 1e-300)
        if top <= 0 or k == d or bool(((residual <= RESIDUAL * top) & ((angle <= ANGLE) | (apart <= ANGLE * top))).all()):
            break
        high = min(max(values[-1], 1e-9 * top), 0.999 * top)  # what lies under the block's least value is unwanted
        q = np.linalg.qr(_filtered(times, q, high, top))[0]
    return space


def _projected(space: Space, x: np.ndarray) -> np.ndarray:
    """Rows on the components, over the roots of the eigenvalues; NaN on a component of no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(space.values > np.finfo(float).eps * len(space.sums) * max(space.trace, 1e-300), 1 / np.sqrt(space.values), np.nan)
    return (space.centred(x) @ space.vectors) * scale


def _sums(fit: DataFrame, dims: int) -> Space:
    """Number, exact sums and largest entry: longs within a part of a batch, decimals beyond, as sums may pass 64 bits. A row a dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column(0), dims)
            for lo in range(0, len(whole), PART):
                x = whole[lo : lo + PART]
                most = np.abs(x).max(0)
                sums = x.sum(0).tolist() if most.max() < (1 << 62) // PART else [sum(c) for c in x.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, len(x))), pa.array(sums, pa.decimal128(38, 0)), pa.array(most)], names=["at", "n", "s", "m"])

    parts = fit.mapInArrow(run, "at long, n long, s decimal(38,0), m long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"))
    rows = sorted(parts.collect())
    return Space(rows[0]["n"], [int(r["s"]) for r in rows], max(r["m"] for r in rows))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    Vectors that are null, empty or hold a null or non-finite entry give no row. Covariances are over the distinct vectors on the grid, so repeats
    count once there and give their rows each; null and repeated ids stay as they are. Where lengths differ, the space is that of the most frequent length (of ties the longest), and other vectors
    give no row. There are as many components as dimensions at most. A component without variance gives null in `whitened`, and counts as nothing in
    `identity_error`; `explained` is null where no dimension varies. Ties among eigenvalues give some basis. An empty table gives an empty result. Other columns are ignored.
    The fit list is written once, grouped with sums in the tasks first, so one vector may hold any share of the rows; the rows themselves are not shuffled.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), grid(F.col(vector_col)).alias("x")).filter("size(x) > 0")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["dims"]
    rows = rows.filter(F.size("x") == dims)
    fit = written(rows.select("x").distinct(), "fit")
    space = fit_components(fit, _sums(fit, dims), components)
    k = len(space.values)

    shared = spark.sparkContext.broadcast(space)  # dimension x components numbers
    moments = _summed(fit, k * k, lambda x: (lambda w: (w.T @ w).ravel())(_projected(shared.value, x)), dims).reshape(k, k) / space.n
    there = ~np.isnan(np.diag(moments))
    space.identity_error = float(np.abs(moments - np.eye(k))[np.ix_(there, there)].max(initial=0.0))
    explained = [float(e / space.trace) if space.trace > 0 else None for e in space.values]
    final = spark.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = final.value
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                part = batch.slice(lo, PART)
                x = _matrix(part.column(1), dims)
                y = _projected(own, x)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, own.n, np.int64)), pa.array(own.deviations(x), pa.int64()).take(at),
                        pa.array(y.ravel(), from_pandas=True), pa.array(explained * len(x), pa.float64()), pa.array(np.full(len(x) * k, own.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
