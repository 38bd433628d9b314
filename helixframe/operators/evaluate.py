"""Held-out evaluation of vector fields, metric roll-ups, velocity projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import writers


def batches(spark: SparkSession, make: Callable[[], DataFrame], path: str, n: int) -> DataFrame:
    """The ``n`` evaluation batches under ``path``, drawn by ``make`` (rows with a ``batch``) and written if nothing is there yet.

    A later run, or another model, is scored on the very same rows. Another
    number of batches than ``n`` is an error.
    """
    if not writers.exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    got = spark.read.parquet(path)
    if (found := got.select("batch").distinct().count()) != n:
        raise ValueError(f"{path} holds {found} batches, not {n}")
    return got


def errors(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """One row an element: ``(batch, g, err)``."""
    return rows.select("batch", F.posexplode(F.zip_with(predicted, target, lambda p, t: p.cast("double") - t.cast("double"))).alias("g", "err"))


def scores(elements: DataFrame, dt: Column, gene_sets: DataFrame | None = None) -> DataFrame:
    """``(batch, eval_gene_set, n_eval_genes, loss, velocity_mae, displacement_mse, displacement_mae)``.

    ``gene_sets(eval_gene_set, g)``; the set ``full`` is always there. Sets are
    few and bounded by the panel, so they are broadcast.
    """
    x = elements.withColumn("eval_gene_set", F.lit("full"))
    if gene_sets is not None:
        x = x.unionByName(elements.join(F.broadcast(gene_sets), "g").select("batch", "g", "err", "eval_gene_set"))
    e, d = F.col("err"), F.col("err") * dt
    return x.groupBy("batch", "eval_gene_set").agg(
        F.countDistinct("g").alias("n_eval_genes"), F.avg(e * e).alias("loss"), F.avg(F.abs(e)).alias("velocity_mae"), F.avg(d * d).alias("displacement_mse"), F.avg(F.abs(d)).alias("displacement_mae")
    )


def metric_fields(rows: DataFrame, path: str) -> DataFrame:
    """Time scale, panel, variant and training of an artifact path; blank training is ``scratch``."""
    p = F.col(path)
    return rows.withColumns(
        {
            "time_scale": F.nullif(F.regexp_extract(p, r"_(days|relative)(?:/|_)", 1), F.lit("")),
            "panel": F.nullif(F.regexp_extract(p, r"panel([0-9]+)", 1), F.lit("")).try_cast("int"),
            "variant": F.nullif(F.regexp_extract(p, r"/(mlp|film|cross_attention)", 1), F.lit("")),
            "training": F.coalesce(F.nullif(F.regexp_extract(p, r"_(transfer|zero_shot)", 1), F.lit("")), F.lit("scratch")),
        }
    )


def roll_up(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def project_velocity(neighbours: DataFrame, states: DataFrame) -> DataFrame:
    """``(id, vx, vy)``: velocity on the map as neighbours' offsets weighed by how the velocity points at them.

    ``neighbours(id, neighbour)``, ``states(id, x, v, px, py)``: weights are the
    exponentials of the cosine between v and the difference to the neighbour,
    less the plain mean.
    """
    from helixframe.functions import exprs as X

    a = states.select("id", F.col("x").alias("_x"), F.col("v").alias("_v"), F.col("px").alias("_px"), F.col("py").alias("_py"))
    b = states.select(F.col("id").alias("neighbour"), F.col("x").alias("_y"), F.col("px").alias("_qx"), F.col("py").alias("_qy"))
    # The far end's state is all that moves once an edge; the row's own comes once a row, where its edges are summed.
    rows = neighbours.select("id", "neighbour").join(b, "neighbour").drop("neighbour").join(a, "id").withColumn("_d", F.zip_with("_x", "_y", lambda p, q: q.cast("double") - p.cast("double")))
    cos = X.cosine(F.col("_d"), F.col("_v"))
    rows = rows.withColumn("_w", F.exp(cos)).withColumn("_dx", F.col("_qx") - F.col("_px")).withColumn("_dy", F.col("_qy") - F.col("_py"))
    w = F.col("_w")
    return rows.groupBy("id").agg((F.sum(w * F.col("_dx")) / F.sum(w) - F.avg("_dx")).alias("vx"), (F.sum(w * F.col("_dy")) / F.sum(w) - F.avg("_dy")).alias("vy"))


def velocity_grid(rows: DataFrame, size: float, least: int = 1) -> DataFrame:
    """``(gx, gy, vx, vy, n)``: mean velocity of the cells of a square grid on the map, with ``least`` rows or more. Rows without a place or velocity count nowhere."""
    x = rows.dropna(subset=["px", "py", "vx", "vy"])
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return x.groupBy(at("px").alias("gx"), at("py").alias("gy")).agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.count("*").alias("n")).where(F.col("n") >= least)
