"""Exact order statistics of groups of any size: brackets from sketches, counted and narrowed until few values are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.scratch import kept, superseded

#: Values of a group that a window sorts at the end.
FEW = 4096
#: Parts of a group's rows that a sketch tells apart; a bracket keeps some four of them.
ACCURACY = 1000


def quantile(rows: DataFrame, group: str | None, column: str, share: float = 0.5) -> DataFrame:
    """``(group, n, value)``: the value at ``share`` of the way from a group's least to its largest, between two values by their distance.

    Exact, as if each group were sorted. A group that is small is sorted; of a
    larger one a sketch, which tasks begin before the shuffle, gives a bracket
    round the rank, the rows under it are counted, and only what lies in the
    bracket is looked at again, until :data:`FEW` values or equal ones are left.
    So no task holds a group. Nulls and NaN are no values; a group without any
    has no row; null is a group. Without ``group`` the whole table is one.
    """
    key = F.lit(0) if group is None else F.col(group)
    x = rows.select(key.alias("g"), F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    spark = rows.sparkSession
    x, used = kept(x, "quantile")
    spot = F.lit(share) * (F.col("n") - 1)
    # at: the lower rank, counted from the values in the bracket; up: how far to the next one.
    state = x.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.select("g", "n", F.floor(spot).alias("at"), (spot - F.floor(spot)).alias("up"), F.col("n").alias("inside"), "lo", "hi")
    state, path = kept(state, "quantile-state")
    while True:
        wide = state.where((F.col("inside") > FEW) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        both = x.join(wide.select(F.col("g").alias("_g"), "lo", "hi", "at", "inside"), F.col("g").eqNullSafe(F.col("_g"))).where("v between lo and hi")
        near = both.groupBy("g").agg(F.expr(f"approx_percentile(v, array({', '.join(str(k / ACCURACY) for k in range(ACCURACY + 1))}), {20 * ACCURACY})").alias("cuts"), F.max("at").alias("at"), F.max("inside").alias("inside"))
        place = F.floor(F.col("at") * ACCURACY / (F.col("inside") - 1)).cast("int")
        near = near.select("g", F.element_at("cuts", F.greatest(place - 1, F.lit(0)) + 1).alias("a"), F.element_at("cuts", F.least(place + 3, F.lit(ACCURACY)) + 1).alias("b"))
        near, at = kept(near, "quantile-near")
        held = both.join(near.withColumnRenamed("g", "_n"), F.col("g").eqNullSafe(F.col("_n"))).groupBy("g").agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if((F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).alias("kept"), F.max("a").alias("a"), F.max("b").alias("b"))
        # A sketch may be off; then the bracket stays as it was.
        fits = (F.col("under") <= F.col("at")) & (F.least(F.col("at") + 1, F.col("inside") - 1) < F.col("under") + F.col("kept"))
        new = state.join(held.withColumnRenamed("g", "_h"), F.col("g").eqNullSafe(F.col("_h")), "left")
        ok = F.coalesce(fits, F.lit(False))
        state_, after = kept(
            new.select("g", "n", F.when(ok, F.col("at") - F.col("under")).otherwise(F.col("at")).alias("at"), "up", F.when(ok, F.col("kept")).otherwise(F.col("inside")).alias("inside"), F.when(ok, F.col("a")).otherwise(F.col("lo")).alias("lo"), F.when(ok, F.col("b")).otherwise(F.col("hi")).alias("hi")), "quantile-state"
        )
        settled = state.agg(F.sum("inside")).first()[0] == state_.agg(F.sum("inside")).first()[0]
        superseded(spark, at, path)
        state, path = state_, after
        if settled:  # brackets of very many equal values beside others do not shrink: they are sorted
            break
    s = state.withColumnRenamed("g", "_g")
    flat = F.col("lo") == F.col("hi")
    few = x.join(s.where(~flat), F.col("g").eqNullSafe(F.col("_g"))).where("v between lo and hi")
    # One row a value: equal ones are counted, so that a bracket full of them is short.
    counted = few.groupBy("g", "v", "n", "at", "up").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    line = counted.withColumn("upto", upto)
    first = F.min(F.when(F.col("upto") > F.col("at"), F.col("v")))
    then = F.min(F.when(F.col("upto") > F.col("at") + 1, F.col("v")))
    found = line.groupBy("g").agg(F.max("n").alias("n"), first.alias("first"), then.alias("then"), F.max("up").alias("up"))
    found = found.select("g", "n", F.when(F.col("up") > 0, F.col("first") + (F.col("then") - F.col("first")) * F.col("up")).otherwise(F.col("first")).alias("value"))
    found = found.unionByName(state.where(flat).select("g", "n", F.col("lo").alias("value")))
    return found.select("n", "value") if group is None else found.select(F.col("g").alias(group), "n", "value")
