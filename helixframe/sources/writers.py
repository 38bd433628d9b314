"""Sinks: guarded, sharded, compressed, materialised by signature."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def csv(df: DataFrame, path: str, *, gzip: bool = False, header: bool = True, sep: str = ",", empty: str = '""') -> None:
    """Refuses a path that is there. ``empty`` stands for an empty string; a null is nothing at all."""
    df.write.mode("errorifexists").csv(path, header=header, sep=sep, compression="gzip" if gzip else "none", emptyValue=empty)


def bed(df: DataFrame, path: str) -> None:
    """Headerless gzip TSV: chrom, start, end, ccre_id, element_id, state, under these names."""
    cols = [F.col(c) if c in df.columns else F.lit(".").alias(c) for c in ("chrom", "start", "end", "ccre_id", "element_id", "state")]
    csv(df.select(*cols), path, gzip=True, header=False, sep="\t", empty="")


def shards(df: DataFrame, path: str, ordinal: str, rows: int) -> None:
    """Parquet in row ranges of ``rows`` by ordinal."""
    shard = F.floor(F.col(ordinal) / rows).cast("long")
    df.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", ordinal).write.mode("errorifexists").partitionBy("shard").parquet(path)


def manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON document, committed whole."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def materialise(df: DataFrame, path: str, signature: object) -> DataFrame:
    """Writes ``df`` under ``path`` once a signature: a later call with the same one reads what is there."""
    spark = df.sparkSession
    at = f"{path.rstrip('/')}/{hashlib.sha256(json.dumps(signature, sort_keys=True, default=str).encode()).hexdigest()[:24]}"
    if not exists(spark, f"{at}/_SUCCESS"):
        df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ids(rows: DataFrame, path: str, column: str, order: str) -> None:
    """A side file: the values of one column in order of another, as one headed CSV of a bounded list."""
    csv(rows.select(column, F.col(order).alias("_o")).coalesce(1).sortWithinPartitions("_o").select(column), path)


def weights(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], settings: dict) -> None:
    """The arrays of one model beside its settings; refuses a path that is there."""
    rows = [(k, list(map(int, v.shape)), np.asarray(v, float).ravel().tolist()) for k, v in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("errorifexists").parquet(path)
    manifest(spark, f"{path.rstrip('/')}-settings", settings)


def metrics(rows: DataFrame, path: str) -> None:
    """Appends metric rows to a Parquet log."""
    rows.write.mode("append").parquet(path)
