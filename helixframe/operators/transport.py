"""Minibatch optimal transport: costs, log-domain Sinkhorn coupling, pairs, interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import exprs as X


def costs(left: DataFrame, right: DataFrame, batch: str = "batch") -> DataFrame:
    """``(batch, i, j, cost)``: squared distances of unit vectors within a batch (minibatches, bounded by their size)."""
    a = left.select(batch, F.col("i"), X.unit(F.col("x")).alias("_a"))
    b = right.select(batch, F.col("j"), X.unit(F.col("x")).alias("_b"))
    return a.join(b, batch).select(batch, "i", "j", X.squared_distance(F.col("_a"), F.col("_b")).alias("cost"))


def _log_sums(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithms of sums of exponentials; of nothing but minus infinity, that."""
    with np.errstate(divide="ignore"):
        return np.logaddexp.reduce(x, axis=axis)


def sinkhorn(cost: np.ndarray, epsilon: float = 0.05, iterations: int = 80, settled: float = 1e-13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Couplings with uniform marginals of many minibatches at once, and their potentials: ``(p, f, g)``.

    ``cost (batches, n, m)`` is infinite where a minibatch has no such row or
    column, so minibatches of other sizes stand in one array; there the coupling
    is 0. Rows and columns are scaled in turn, in logarithms, until no potential
    moves by more than ``settled``, or ``iterations`` times; columns are exact. A
    minibatch without rows or columns couples nothing.
    """
    k = -cost / epsilon
    there = np.isfinite(k)
    own, other = there.any(2), there.any(1)
    share = lambda x: -np.log(np.maximum(x.sum(1, keepdims=True), 1))
    f, g = np.zeros(own.shape), np.zeros(other.shape)
    for _ in range(iterations):
        before = f
        f = np.where(own, share(own) - np.where(own, _log_sums(k + g[:, None, :], 2), 0), 0)
        g = np.where(other, share(other) - np.where(other, _log_sums(k + f[:, :, None], 1), 0), 0)
        if np.abs(f - before).max(initial=0) <= settled:
            break
    return np.where(there, np.exp(np.where(there, k + f[:, :, None] + g[:, None, :], 0)), 0), f, g


#: Cells of the array of minibatches that are scaled together.
TOGETHER = 1 << 22


def couple(costs_: DataFrame, *, epsilon: float = 0.05, iterations: int = 80) -> DataFrame:
    """``(batch, i, j, p)`` of the cost rows of minibatches, which are bounded by their size: each is a row, and a task scales many together.

    A pair without a cost row is never coupled; of equal pairs the least cost counts for each.
    """
    cell = F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("cost").cast("double").alias("cost"))
    packed = costs_.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cells")
            size = cells.value_lengths().to_numpy()
            start = 0
            while start < len(b):
                # Minibatches up to a bound of cells, as if all were as large as the largest.
                stop = start + 1
                while stop < len(b) and size[start : stop + 1].max() * (stop + 1 - start) <= TOGETHER:
                    stop += 1
                yield one(b.slice(start, stop - start), size[start:stop])
                start = stop

    def one(b: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        flat = b.column("cells").flatten()
        i, j, c = (flat.field(n).to_numpy() for n in ("i", "j", "cost"))
        at = np.repeat(np.arange(len(b)), size)

        def places(x: np.ndarray) -> np.ndarray:
            """Ranks of a minibatch's row or column numbers."""
            pair, back = np.unique(np.stack([at, x]), axis=1, return_inverse=True)
            return np.arange(pair.shape[1])[back] - np.searchsorted(pair[0], at)

        r, k = places(i), places(j)
        cost = np.full((len(b), r.max(initial=-1) + 1, k.max(initial=-1) + 1), np.inf)
        np.minimum.at(cost, (at, r, k), c)
        p, _, _ = sinkhorn(cost, epsilon, iterations)
        return pa.RecordBatch.from_arrays([b.column("batch").take(pa.array(at)), pa.array(i), pa.array(j), pa.array(p[at, r, k])], names=["batch", "i", "j", "p"])

    return packed.mapInArrow(scaled, "batch long, i long, j long, p double")


def draw_pairs(coupling: DataFrame, n: int, seed: int | str) -> DataFrame:
    """``n`` pairs a batch with replacement, by their coupling: ``(batch, draw, i, j)``."""
    from helixframe.operators.sampling import weighted

    flat = coupling.withColumn("item", F.format_string("%012d:%012d", "i", "j"))
    got = weighted(flat, "batch", "item", "p", n, seed)
    return got.select("batch", "draw", F.substring_index("item", ":", 1).cast("long").alias("i"), F.substring_index("item", ":", -1).cast("long").alias("j"))


def interpolate(pairs: DataFrame, x0: DataFrame, x1: DataFrame, t0: float, t1: float, seed: int | str, *, states: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(batch, draw, tau, xt, target[, state_t])``: points on the way of each pair and the velocity along it.

    ``x0(batch, i, x)``, ``x1(batch, j, x)``; ``states`` likewise, taken at the
    same pairs and the same tau.
    """
    if t1 <= t0:
        raise ValueError("an interval must go forward in time")
    rows = pairs.join(x0.select("batch", "i", F.col("x").alias("_0")), ["batch", "i"]).join(x1.select("batch", "j", F.col("x").alias("_1")), ["batch", "j"])
    rows = rows.withColumn("tau", X.uniform("batch", "draw", F.lit(f"{seed}:tau")))
    out = ["batch", "draw", "tau", X.between(F.col("_0"), F.col("_1"), F.col("tau")).alias("xt"), X.velocity(F.col("_0"), F.col("_1"), F.lit(t1 - t0)).alias("target")]
    if states:
        s0, s1 = states
        rows = rows.join(s0.select("batch", "i", F.col("x").alias("_s0")), ["batch", "i"]).join(s1.select("batch", "j", F.col("x").alias("_s1")), ["batch", "j"])
        out.append(X.between(F.col("_s0"), F.col("_s1"), F.col("tau")).alias("state_t"))
    return rows.select(*out)
