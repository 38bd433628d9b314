"""Gene token metadata, weighted cell sentences and length buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.profile import numbered
from helixframe.operators.sampling import weighted
from helixframe.sources.readers import fetch
from helixframe.sources.writers import materialise

#: The special tokens of a sentence.
CLS, CLOSE, CHROM_OFFSET = 3, 2, 143_574


def category_codes(rows: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: rank of each value among all values, from 0."""
    x = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return x.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))


def gene_metadata(genes: DataFrame, tokens: DataFrame, positions: DataFrame, species: str) -> DataFrame:
    """``(gene, token_id, chrom_id, start, valid)`` by upper-cased symbol; misses are -1.

    ``genes(gene, symbol)``, ``tokens(symbol, token_id)`` (the last of equal
    symbols counts), ``positions(species, chromosome, symbol, start)`` of all
    species: chromosomes are coded before the species is chosen.
    """
    ids = tokens.groupBy(F.upper("symbol").alias("symbol")).agg(F.max("token_id").alias("token_id"))
    coded = positions.withColumn("place", F.concat_ws("_", "species", "chromosome"))
    coded = coded.join(category_codes(coded, "place"), "place").where(F.col("species") == species)
    coded = coded.groupBy(F.upper("symbol").alias("symbol")).agg(F.min(F.struct("start", "code")).alias("p")).select("symbol", F.col("p.code").alias("chrom_id"), F.col("p.start").cast("long").alias("start"))
    x = genes.withColumn("symbol", F.upper("symbol")).join(ids, "symbol", "left").join(coded, "symbol", "left")
    valid = F.col("token_id").isNotNull() & F.col("chrom_id").isNotNull() & F.col("start").isNotNull()
    return x.select("gene", *[F.when(valid, F.col(c)).otherwise(F.lit(-1)).cast("long").alias(c) for c in ("token_id", "chrom_id", "start")], valid.alias("valid"))


def sentences(matrix: DataFrame, genes: DataFrame, size: int, seed: int | str) -> DataFrame:
    """``(cell, sentence)``: CLS, then for each chromosome in a drawn order its token, its drawn genes by start, and a close.

    ``size`` genes are drawn with replacement, weighing ``log1p(value)``. Cells
    without a usable gene have no row.
    """
    from helixframe.functions import exprs as X

    usable = matrix.where("value > 0").join(genes.where("valid"), "gene").withColumn("w", F.log1p("value"))
    drawn = weighted(usable.select("cell", "gene", "w"), "cell", "gene", "w", size, seed)
    drawn = drawn.join(genes.where("valid"), "gene")
    per = drawn.groupBy("cell", "chrom_id").agg(F.sort_array(F.collect_list(F.struct("start", "draw", "token_id"))).alias("g"))
    body = F.concat(F.array(F.col("chrom_id") + CHROM_OFFSET), F.transform("g", lambda x: x["token_id"]), F.array(F.lit(CLOSE).cast("long")))
    per = per.select("cell", F.struct(X.uniform("cell", "chrom_id", F.lit(f"{seed}:order")).alias("u"), "chrom_id", body.alias("body")).alias("part"))
    parts = per.groupBy("cell").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return parts.select("cell", F.concat(F.array(F.lit(CLS).cast("long")), F.flatten(F.transform("parts", lambda p: p["body"]))).alias("sentence"))


def with_empty(rows: DataFrame, cells: DataFrame, column: str = "sentence") -> DataFrame:
    """All of ``cells``: those without a sentence have an empty one."""
    return cells.select("cell").join(rows, "cell", "left").withColumn(column, F.coalesce(column, F.array().cast(rows.schema[column].dataType)))


def embed(rows: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], dim: int, column: str = "sentence") -> DataFrame:
    """``(cell, vector)``: an encoder of equally long sentences, applied length by length in each batch; empty sentences are zero vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.compute.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            out = np.zeros((len(b), dim))
            for k in np.unique(n[n > 0]):
                at = np.flatnonzero(n == k)
                out[at] = encoder(b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["cell", "vector"])

    return rows.select("cell", column).mapInArrow(run, f"cell {rows.schema['cell'].dataType.simpleString()}, vector array<double>")


def length_buckets(rows: DataFrame, column: str = "sentence", batch: int = 100) -> DataFrame:
    """Adds ``length`` and ``bucket``: batches of up to ``batch`` rows of one length, in cell order. An empty sentence has length 0."""
    x = numbered(rows.withColumn("length", F.size(column).cast("long")), "length", ["cell"], "_nth")
    return x.withColumn("bucket", F.floor(F.col("_nth") / batch).cast("long")).drop("_nth")


def embed_regions(regions: DataFrame, sequences: DataFrame, length: int, encoder: Callable[[list[str]], np.ndarray], dim: int, path: str, *, signature: object, parts: int = 16, pool: int = 1, width: int = 1 << 16) -> DataFrame:
    """``(region_id, vector)`` of the sequence around each distinct ``region_id`` of ``regions(region_id, chrom, midpoint)``.

    Of rows with one id the one with the smallest place counts. ``encoder``
    takes sequences of ``length`` and gives ``pool`` rows of ``dim`` each,
    whose mean is the vector. The ids are dealt to ``parts`` tables under
    ``path`` that are written whole, one after another: a run that was cut off
    goes on with the first one missing. Another ``signature`` begins anew.
    Regions of unknown chromosomes have no row. ``width`` is that of the sequences' pieces.
    """
    one = regions.where("region_id is not null").groupBy("region_id").agg(F.min(F.struct("chrom", "midpoint")).alias("p")).select("region_id", "p.*")
    kind = regions.schema["region_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.asarray(encoder(b.column(1).to_pylist()), float).reshape(len(b), pool, dim).mean(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["region_id", "vector"])

    done = []
    for k in range(parts):
        mine = one.where(F.pmod(F.xxhash64("region_id"), F.lit(parts)) == k)
        made = fetch(sequences, mine, length, width).mapInArrow(run, f"region_id {kind}, vector array<double>")
        done.append(materialise(made, path, [signature, length, dim, pool, parts, k]))
    return reduce(DataFrame.unionByName, done)
