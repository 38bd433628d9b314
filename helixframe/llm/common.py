"""Shared storage, sizing and graph helpers of the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.scratch import superseded, workspace

# Functions sent to executors travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["helixframe"])


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here. The path is for ``superseded``."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`kept`, for a table that later plans read until the driver exits."""
    return kept(df, name)[0]


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(id, component)``.

    ``component`` is the smallest id reachable. Each round links every node's
    neighbours to the smallest of them and every node to its root (large and
    small star), so paths halve; both steps are a partial aggregate and a join
    that adaptive execution can split. Nodes without an edge are not returned;
    self loops are ignored; an empty input gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark = edges.sparkSession
    e, path = kept(e, "edges")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of u go to u's smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the exchange of the edges is the join's own and a node with very many of them can be split.
        least, lowest = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, middle = kept(large.where("u <> v").distinct(), "large")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e, after = kept(small.where("u <> v").distinct(), "small")
        superseded(spark, path, middle, lowest)
        path = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
