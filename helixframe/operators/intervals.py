"""Range joins of points with intervals, nearest-or-default fallback, ranking and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X


def range_join(points: DataFrame, intervals: DataFrame, key: str, window: int, *, point: str = "pos", middle: str = "midpoint") -> DataFrame:
    """Pairs of one key with ``middle`` within ``window`` of ``point``, both ends included.

    Positions fall in bins as wide as the window: a point looks in three, an
    interval stands in one, so the join has an equality on (key, bin) that
    Spark can deal out and split, and no pair comes twice.
    """
    size = max(int(window), 1)
    left = points.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(point) / size) + d)))
    right = intervals.withColumn("_bin", F.floor(F.col(middle) / size))
    found = left.join(right, [key, "_bin"]).where(F.abs(F.col(middle) - F.col(point)) <= window).drop("_bin")
    return found.withColumn("signed_distance", (F.col(middle) - F.col(point)).cast("long")).withColumn("abs_distance", F.abs("signed_distance"))


def link(points: DataFrame, intervals: DataFrame, *, key: str, point_id: str, interval_id: str, window: int, near: int, width: int = 512, id_cast: str = "string") -> DataFrame:
    """Each point's intervals within ``window``, ranked; exactly one is its promoter.

    ``points(point_id, key, pos)``, ``intervals(interval_id, key, start, end, midpoint)``.
    The nearest interval (ties: lower midpoint, then id) is the promoter if it
    is within ``near``; otherwise a synthetic one of ``width`` at the point is
    added. ``token_rank``: promoter first, then by distance and id.
    """
    found = range_join(points, intervals, key, window).withColumn("ref_id", F.col(interval_id).cast(id_cast))
    nearest = Window.partitionBy(point_id).orderBy("abs_distance", "midpoint", interval_id)
    found = found.withColumn("is_promoter", (F.row_number().over(nearest) == 1) & (F.col("abs_distance") <= near)).withColumn("is_synthetic", F.lit(False))
    fields = [point_id, key, "pos", "ref_id", "start", "end", "midpoint", "signed_distance", "abs_distance", "is_synthetic", "is_promoter"]
    has = found.where("is_promoter").select(point_id)
    made = points.join(has, point_id, "left_anti").select(
        point_id, key, "pos", F.concat(F.lit("synthetic_promoter:"), F.col(point_id).cast("string")).alias("ref_id"),
        X.window_start(F.col("pos"), width).alias("start"), (F.col("pos") + width // 2).cast("long").alias("end"), F.col("pos").alias("midpoint"),
        F.lit(0).cast("long").alias("signed_distance"), F.lit(0).cast("long").alias("abs_distance"), F.lit(True).alias("is_synthetic"), F.lit(True).alias("is_promoter"),
    )
    every = found.select(*fields).unionByName(made)
    order = Window.partitionBy(point_id).orderBy(F.desc("is_promoter"), "abs_distance", "ref_id")
    return every.withColumn("token_rank", (F.row_number().over(order) - 1).cast("long"))


def top(ranked: DataFrame, k: int, rank: str = "token_rank") -> DataFrame:
    return ranked.where(F.col(rank) < k)


def pack(links: DataFrame, vectors: DataFrame, *, group: str, ref: str, k: int, strict: bool = True) -> DataFrame:
    """Per group, the first ``k`` links in rank order as an array of ``(rank, distance, is_promoter, vector)``.

    ``vectors(ref, vector)`` must hold a reference once; with ``strict`` a
    missing one among the ranks kept is an error when the row is computed,
    otherwise its vector is null.
    """
    once = vectors.groupBy(ref).agg(F.count("*").alias("_n"), F.any_value("vector").alias("vector"))
    once = once.select(ref, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated reference "), F.col(ref).cast("string")))).otherwise(F.col("vector")).alias("vector"))
    joined = top(links, k).join(once, ref, "left")
    vector = F.col("vector")
    if strict:
        vector = F.when(vector.isNull() & ~F.col("is_synthetic"), F.raise_error(F.concat(F.lit("no vector for "), F.col(ref).cast("string")))).otherwise(vector)
    item = F.struct(F.col("token_rank").alias("rank"), F.col("signed_distance").cast("float").alias("distance"), "is_promoter", vector.alias("vector"))
    return joined.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("tokens"))


def missing(wanted: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Keys asked for that are not there: the rows of a failed check."""
    return wanted.select(on).distinct().join(known.select(on).distinct(), on, "left_anti")


def require(wanted: DataFrame, known: DataFrame, on: str) -> None:
    """Raises with the first ten missing keys."""
    found = [r[0] for r in missing(wanted, known, on).orderBy(on).limit(10).collect()]
    if found:
        raise KeyError(f"missing {on}: {found}")




def aligned(rows: DataFrame, state: DataFrame, shard: str, ordinal: str) -> DataFrame:
    """Rows with the state of the same place in their shard; shards whose row counts differ are an error when read."""
    a, b = rows.groupBy(shard).agg(F.count("*").alias("_a")), state.groupBy(shard).agg(F.count("*").alias("_b"))
    counts = a.join(b, shard, "full").withColumn("_ok", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    wrong = F.raise_error(F.concat(F.lit("rows and state differ in number in "), F.col(shard).cast("string")))
    checked = counts.withColumn("_ok", F.when(F.col("_ok"), True).otherwise(wrong.cast("boolean"))).where("_ok").select(shard)
    return rows.join(checked, shard).join(state, [shard, ordinal])
