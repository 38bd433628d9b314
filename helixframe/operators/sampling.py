"""Draws that depend on keys and a seed only: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X
from helixframe.operators.profile import numbered, ordinals
from helixframe.sources.writers import materialise


def bottom_k(rows: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """``k`` rows without replacement: those with the smallest draws."""
    return rows.withColumn("_u", X.uniform(key, F.lit(str(seed)))).orderBy("_u", key).limit(k).drop("_u")


def bottom_k_per(rows: DataFrame, group: str, key: str, k: int, seed: int | str) -> DataFrame:
    """As ``bottom_k``, of each group; ``draw`` numbers the draws from 0."""
    w = Window.partitionBy(group).orderBy("_u", key)
    # The bare rank lets Spark keep the first rows of a group before the shuffle.
    x = rows.withColumn("_u", X.uniform(key, F.lit(str(seed)))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return x.withColumn("draw", (F.col("_k") - 1).cast("long")).drop("_u", "_k")


#: Rounds of the bijection, and the most walks of a place beyond the range.
ROUNDS, WALKS = 6, 16


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Where a keyed bijection of ``[0, n)`` sends ``i``: a different order of the whole range for each key, and nothing is sorted.

    Numbers are pairs (left, right) of a table of ``a`` times ``b`` places,
    ``a`` the rounded up root of ``n``; rounds add a keyed hash of one to the
    other by turns. A place beyond ``n`` walks on; fewer than ``a`` lie there,
    so :data:`WALKS` are enough for all ``n`` up to 225, and for larger ones with
    a chance of ``n ** (-WALKS / 2)`` to miss, which is an error.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")
    noise = lambda k, x: F.conv(F.substring(F.md5(F.concat_ws(":", key, (k % ROUNDS).cast("string"), x.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    start = F.struct(F.floor(i / b).cast("long").alias("l"), F.pmod(i, b).cast("long").alias("r"), F.lit(False).alias("in"))

    def turn(at: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, F.pmod(at["l"] + noise(k, at["r"]), a)).otherwise(at["l"])
        right = F.when(k % 2 == 1, F.pmod(at["r"] + noise(k, at["l"]), b)).otherwise(at["r"])
        last = k % ROUNDS == ROUNDS - 1
        new = F.struct(left.alias("l"), right.alias("r"), (last & (left * b + right < n)).alias("in"))
        return F.when(at["in"], at).otherwise(new)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS - 1)), start, turn)
    return F.when(end["in"], end["l"] * b + end["r"]).otherwise(F.raise_error(F.lit("the bijection left its range")).cast("long"))


def batches(rows: DataFrame, group: str, key: str, size: int, n: int, seed: int | str) -> DataFrame:
    """``n`` batches of ``size`` rows of each group, ``(batch, group, draw, key)``: without replacement if the group has that many, else with.

    Each batch of a large group is a draw of its own: the first places of a
    keyed bijection of the group's row numbers. A small group gives independent
    draws. Rows are numbered once, in the order of their key; keys are unique.
    """
    line = numbered(rows.select(group, key), group, [key], "_i")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    place = permuted(F.col("draw").cast("long"), F.col("_n"), F.concat_ws(":", F.col(group).cast("string"), F.col("batch").cast("string"), F.lit(str(seed))))
    own = F.floor(X.uniform(group, "batch", "draw", F.lit(f"{seed}:own")) * F.col("_n"))
    draws = draws.withColumn("_i", F.when(F.col("_n") >= size, place).otherwise(own).cast("long")).drop("_n")
    return draws.join(line.select(group, "_i", key), [group, "_i"]).select(F.col("batch").cast("long").alias("batch"), group, F.col("draw").cast("long").alias("draw"), key)


def plot_sample(cells: DataFrame, matrix: DataFrame, places: DataFrame, order: str, n: int, seed: int | str, path: str, signature: object) -> tuple[DataFrame, DataFrame]:
    """``n`` cells of ``cells(cell, ...)`` drawn by key, and the entries of ``matrix(cell, gene, value)`` of these: both kept under ``path``.

    The cells get a place on a map from ``places``, whose rows stand in the
    order of ``order`` as the cells do in theirs: the k-th row is the k-th
    cell's. A cell beyond the last place has none. A later call with the same
    signature, number and seed reads what the first one wrote.
    """
    number = lambda x, by: ordinals(x.withColumn("_s", F.lit(0)), "_s", by).drop("_s")
    rows = bottom_k(number(cells, "cell"), "cell", n, seed).join(number(places, order).drop(order), "ordinal", "left")
    drawn = materialise(rows.orderBy("ordinal"), path, ["cells", n, str(seed), signature])
    return drawn, materialise(matrix.join(drawn.select("cell"), "cell", "left_semi"), path, ["entries", n, str(seed), signature])


def choose(n_batches: int, options: DataFrame, order: list[str | Column], seed: int | str) -> DataFrame:
    """For each batch one of the options (a small table), uniformly."""
    listed = options.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    spark = options.sparkSession
    picks = spark.range(n_batches).select(F.col("id").alias("batch"))
    joined = picks.crossJoin(F.broadcast(listed.select("_n").distinct())).withColumn("_i", F.floor(X.uniform("batch", F.lit(str(seed))) * F.col("_n")).cast("int")).drop("_n")
    return joined.join(F.broadcast(listed.drop("_n")), "_i").drop("_i")


def weighted(rows: DataFrame, group: str, item: str, weight: str, draws: int, seed: int | str) -> DataFrame:
    """``draws`` items of each group with replacement, with probability by weight: ``(group, draw, item)``.

    Items stand on a line at the sum of the weights before them, in item order,
    and draws at drawn points; a draw takes the last item at or before it. Both
    pass one sort of the group: no draw meets all items. Weights that are null
    or not positive are not drawn; a group without others has no rows.
    """
    w = Window.partitionBy(group).orderBy(item)
    run = rows.where(F.col(weight) > 0).select(group, F.col(item).alias("_item"), F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double").alias("_at"), F.col(weight).cast("double").alias("_w"))
    points = run.groupBy(group).agg(F.max(F.col("_at") + F.col("_w")).alias("_t")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    points = points.withColumn("_at", X.uniform(group, "draw", F.lit(str(seed))) * F.col("_t"))
    both = run.select(group, "_at", "_item", F.lit(None).cast("long").alias("draw")).unionByName(points.select(group, "_at", F.lit(None).cast(run.schema["_item"].dataType).alias("_item"), "draw"))
    line = Window.partitionBy(group).orderBy(F.col("_at"), F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(item, F.last("_item", ignorenulls=True).over(line)).where("draw is not null")
    return found.select(group, "draw", item)
