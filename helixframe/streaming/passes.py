"""Incremental passes over folders of shards: each file is read once, progress survives restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accumulate(spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str) -> None:
    """Adds the sums of every new shard of ``(cell, gene, value)`` to ``state``, one Parquet folder a micro-batch.

    A batch that is run again replaces its own folder, so a restart counts no shard twice.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    incoming = spark.readStream.schema(schema).parquet(folder)
    query = incoming.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def variances(spark: SparkSession, state: str, cells: int) -> DataFrame:
    """``(gene, mean, variance)`` of all that was accumulated."""
    x = spark.read.parquet(state).groupBy("gene").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / cells
    return x.select("gene", mean.alias("mean"), F.greatest(F.col("ss") / cells - mean * mean, F.lit(0.0)).alias("variance"))


def resume(todo: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")
