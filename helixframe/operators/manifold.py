"""A map of vectors in a plane that keeps neighbours: fuzzy weights of the neighbour graph, a spectral start, sampled forces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import exprs as X
from helixframe.operators import decompose
from helixframe.operators.neighbours import nearest
from helixframe.operators.profile import ordinals
from helixframe.sources.scratch import kept, superseded

#: Side of the square that the spectral start fills.
SIDE = 20.0
# The curve 1 / (1 + a d^2b) that is near 1 up to a distance of 0.1 and falls off as exp does.
CURVE_A, CURVE_B = 1.577, 0.895


def fuzzy(neighbours: DataFrame, k: int) -> DataFrame:
    """``(id, neighbour, w)`` of ``(id, neighbour, distance, rank)``: how far a neighbour belongs to a row, 1 for its nearest.

    Distances over that of the nearest fall off exponentially, at a scale of the
    row's own: weights of a row add up to the logarithm of ``k``. A row's
    neighbours are a list of ``k``.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n, who = b.column(1).value_lengths().to_numpy(), b.column(1).flatten()
            d = np.full((len(b), n.max()), np.inf)
            d[np.arange(n.max()) < n[:, None]] = np.sqrt(np.maximum(b.column(2).flatten().to_numpy(), 0))
            over = np.maximum(d - d[:, :1], 0)
            lo, hi = np.full(len(b), -20.0), np.full(len(b), 20.0)
            for _ in range(48):  # halving the logarithm of the scale
                mid = (lo + hi) / 2
                more = np.exp(-over / np.exp(mid)[:, None]).sum(1) > np.log2(k)
                lo, hi = np.where(more, lo, mid), np.where(more, mid, hi)
            w = np.exp(-over / np.exp((lo + hi) / 2)[:, None])[np.isfinite(d)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n))), who, pa.array(w)], names=["id", "neighbour", "w"])

    one = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance")))
    rows = neighbours.groupBy("id").agg(one.alias("l")).select("id", F.col("l.neighbour").alias("n"), F.col("l.distance").alias("d"))
    return rows.mapInArrow(weigh, "id long, neighbour long, w double")


def union(weights: DataFrame) -> DataFrame:
    """``(id, neighbour, w)`` both ways: an edge is there if either end says so, ``a + b - ab``."""
    both = weights.select("id", "neighbour", "w").unionByName(weights.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "w"))
    return both.groupBy("id", "neighbour").agg((1 - F.product(1 - F.col("w"))).alias("w"))


def spectral(edges: DataFrame, seed: int | str) -> DataFrame:
    """``(id, x, y)``: the second and third leading vectors of the graph's normalised weights, of one span in both directions."""
    degree = edges.groupBy("id").agg(F.sum("w").alias("d"))
    other = degree.select(F.col("id").alias("neighbour"), F.col("d").alias("e"))
    m = edges.join(degree, "id").join(other, "neighbour").select(F.col("id").alias("cell"), F.col("neighbour").alias("gene"), (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("value"))
    # One is added to the diagonal, so that leading means largest and not largest in size.
    m = m.unionByName(degree.select(F.col("id").alias("cell"), F.col("id").alias("gene"), F.lit(1.0).alias("value")))
    loadings, _ = decompose.svd(m, 3, cells=degree.count(), power=4, seed=seed)
    axis = lambda c: F.coalesce(F.max(F.when(F.col("pc") == c, F.col("weight"))), F.lit(0.0))
    at = loadings.groupBy(F.col("gene").alias("id")).agg(axis(1).alias("x"), axis(2).alias("y")).join(degree, "id")
    at, path = kept(at.select("id", (F.col("x") / F.sqrt("d")).alias("x"), (F.col("y") / F.sqrt("d")).alias("y")), "spectral")
    ends = at.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]).first()

    def span(c: str) -> Column:
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        return F.lit(SIDE / (high - low)) * (F.col(c) - F.lit(low)) if high is not None and high > low else F.lit(0.0)

    # Equal places are moved apart a little, by the row's key.
    return at.select("id", *[(span(c) + 0.01 * X.uniform("id", F.lit(f"{seed}:{c}"))).alias(c) for c in ("x", "y")])


def layout(edges: DataFrame, start: DataFrame, *, epochs: int = 20, negatives: int = 5, rate: float = 1.0, seed: int | str = 0) -> DataFrame:
    """``(id, x, y)`` after ``epochs`` rounds of forces: along a keyed sample of edges by weight towards the neighbour, and away from ``negatives`` other rows.

    Each round is a join of edges with the places of their far ends and a sum by
    row; places are written, so a lost executor costs a round. Rows are numbered
    once; a negative is a keyed draw of a number, which falls on the row itself
    or a neighbour as often as chance says. The same edges and seed give the
    same map.
    """
    spark = edges.sparkSession
    ids, _ = kept(ordinals(start.select("id", F.lit(0).alias("_s")), "_s", "id").select("id", "ordinal"), "layout-ids")
    n = ids.count()
    if not n:
        return start
    e, _ = kept(edges.select("id", "neighbour", "w"), "layout-edges")
    top = e.agg(F.max("w")).first()[0] or 1.0
    at, path = kept(start, "layout")
    used = [path]
    for k in range(epochs):
        step = rate * (1 - k / epochs)
        pulled = e.where(X.uniform("id", "neighbour", F.lit(f"{seed}:{k}")) * top < F.col("w")).select("id", F.col("neighbour").alias("to"), F.lit(True).alias("near"))
        draw = F.explode(F.sequence(F.lit(0), F.lit(negatives - 1)))
        pushed = ids.select("id", draw.alias("_d")).select("id", F.floor(X.uniform("id", "_d", F.lit(f"{seed}:{k}:away")) * n).cast("long").alias("ordinal"))
        pushed = pushed.join(ids.select("ordinal", F.col("id").alias("to")), "ordinal").where("id <> to").select("id", "to", F.lit(False).alias("near"))
        far = at.select(F.col("id").alias("to"), F.col("x").alias("u"), F.col("y").alias("v"))
        own = at.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
        x = pulled.unionByName(pushed).join(far, "to").join(own, "id")
        dx, dy = F.col("_x") - F.col("u"), F.col("_y") - F.col("v")
        d2 = dx * dx + dy * dy
        power = F.pow(d2, CURVE_B)
        pull = F.when(d2 > 0, -2 * CURVE_A * CURVE_B * F.pow(d2, CURVE_B - 1) / (1 + CURVE_A * power)).otherwise(0.0)
        push = 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * power))
        force = F.when(F.col("near"), pull).otherwise(push)
        cut = lambda v: F.least(F.greatest(force * v, F.lit(-4.0)), F.lit(4.0))
        # All forces act at once, so a row takes their mean: a sum would throw it over its neighbours.
        part = lambda v, near: F.coalesce(F.avg(F.when(F.col("near") == near, cut(v))), F.lit(0.0))
        moved = x.groupBy("id").agg((part(dx, True) + part(dx, False)).alias("fx"), (part(dy, True) + part(dy, False)).alias("fy"))
        new = at.join(moved, "id", "left").select("id", (F.col("x") + step * F.coalesce("fx", F.lit(0.0))).alias("x"), (F.col("y") + step * F.coalesce("fy", F.lit(0.0))).alias("y"))
        at, path = kept(new, "layout")
        used.append(path)
        if len(used) > 2:
            superseded(spark, used.pop(0))
    return at


def fit(vectors: DataFrame, id_col: str, column: str, *, k: int = 15, epochs: int = 20, seed: int | str = 0) -> DataFrame:
    """``(id, x, y)``: a map of all vectors that have neighbours; others have no place."""
    near, path = kept(nearest(vectors, id_col, column, k), "map-neighbours")
    edges, _ = kept(union(fuzzy(near, k)), "map-edges")
    superseded(vectors.sparkSession, path)
    return layout(edges, spectral(edges, seed), epochs=epochs, seed=seed)


def place(rows: DataFrame, fitted: DataFrame, at: DataFrame, id_col: str, column: str, *, k: int = 15) -> DataFrame:
    """``(id, x, y)`` of new rows: the mean place of their neighbours among the ``fitted`` vectors, by fuzzy weight. ``at(id, x, y)`` are their places."""
    near = fuzzy(nearest(fitted, id_col, column, k, queries=rows), k)
    x = near.join(at.select(F.col("id").alias("neighbour"), "x", "y"), "neighbour")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    return x.groupBy("id").agg(mean("x"), mean("y"))
