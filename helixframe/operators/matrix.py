"""Sparse matrices as rows ``(cell, gene, value)``: normalisation, variance, panels, projection, decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X


def collapsed(entries: DataFrame) -> DataFrame:
    """One row a cell and gene: the sum; what sums to zero is not stored."""
    return entries.groupBy("cell", "gene").agg(F.sum("value").alias("value")).where("value <> 0")


def totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("cell").agg(F.sum("value").alias("total"))


def normalised(matrix: DataFrame, target: float = 1e4) -> DataFrame:
    """``log1p`` of library-size fractions. The total is a window over the cell: one shuffle, no join."""
    total = F.sum("value").over(Window.partitionBy("cell"))
    return matrix.withColumn("total", total).withColumn("value", X.log_normalised("value", "total", target)).drop("total")


def looks_like_counts(matrix: DataFrame, most: float = 50.0) -> DataFrame:
    """One row: largest value, whether all values are near whole numbers, and both together."""
    v = F.col("value")
    whole = F.bool_and(F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v)))
    return matrix.where("value is not null and not isnan(value)").agg(F.max("value").alias("largest"), whole.alias("whole")).withColumn("count_like", (F.col("largest") > most) & F.col("whole"))


def variance(matrix: DataFrame, cells: int) -> DataFrame:
    """Population variance of each stored gene over ``cells`` cells, the zeros that are not stored included."""
    n = F.lit(float(cells))
    mean = F.sum("value") / n
    return matrix.groupBy("gene").agg(mean.alias("mean"), F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0)).alias("variance"))


def most_variable(variances: DataFrame, n: int) -> DataFrame:
    return variances.orderBy(F.desc("variance"), "gene").limit(n)


def select_panel(variances: DataFrame, genes: DataFrame, n: int, *, overfetch: int | None = None) -> DataFrame:
    """The ``n`` most variable genes that ``genes(gene, gene_id, ...)`` knows, one row a ``gene_id``: that of the largest variance.

    Ties go by gene. With ``overfetch`` only so many of the most variable genes
    are looked up before the cut to ``n``, so fewer than ``n`` may be left.
    """
    x = variances if overfetch is None else most_variable(variances, n + overfetch)
    x = x.join(genes, "gene")
    rank = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("variance"), "gene"))
    return x.withColumn("_k", rank).where("_k = 1").drop("_k").orderBy(F.desc("variance"), "gene").limit(n)


def gather_rows(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """The entries of some cells, each as often as ``cells(cell, ...)`` names it, with the columns given there."""
    return matrix.join(cells, "cell")


def gather(matrix: DataFrame, panel: DataFrame) -> DataFrame:
    """The columns of a panel; Spark broadcasts the panel if its size lets it."""
    return matrix.join(panel.select("gene").distinct(), "gene", "left_semi")


def project(matrix: DataFrame, loadings: DataFrame) -> DataFrame:
    """``(cell, pc, score)``: sums of values times ``loadings(gene, pc, weight)``, combined before the shuffle."""
    return matrix.join(loadings, "gene").groupBy("cell", "pc").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def gram(vectors: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, the column sums and the number of rows of an array column; tasks send a matrix of the columns' number squared."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = None, None, 0
        for b in batches:
            if not len(b):
                continue
            x = np.array(b.column(0).to_pylist(), np.float64)
            total = x.T @ x if total is None else total + x.T @ x
            mean = x.sum(0) if mean is None else mean + x.sum(0)
            n += len(x)
        if n:
            d = len(mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2)), pa.array([*total.tolist(), mean.tolist(), [float(n)]], pa.list_(pa.float64()))], names=["i", "row"])

    rows = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(part, "i long, row array<double>")
    rows = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # columns squared
    if not rows:
        return np.zeros((0, 0)), np.zeros(0), 0
    d = max(r["i"] for r in rows) - 1
    out, mean, n = np.zeros((d, d)), np.zeros(d), 0
    for r in rows:
        if r["i"] < d:
            out[r["i"], r["j"]] = r["v"]
        elif r["i"] == d:
            mean[r["j"]] = r["v"]
        else:
            n = int(r["v"])
    return out, mean, n


def svd(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Uncentred truncated decomposition: components ``(columns, k)``, singular values, shares of the total variance."""
    g, mean, n = gram(vectors, column)
    k = min(k, max(len(g) - 1, 1))
    value, vector = np.linalg.eigh(g)
    value, vector = np.maximum(value[::-1][:k], 0), vector[:, ::-1][:, :k]
    vector = vector * np.where(np.abs(vector).argmax(0) >= 0, np.sign(vector[np.abs(vector).argmax(0), np.arange(k)]), 1)
    spread = np.trace(g) / n - (mean / n) @ (mean / n)
    scores = value / n - ((mean / n) @ vector) ** 2
    return vector, np.sqrt(value), scores / spread
