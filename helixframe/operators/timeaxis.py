"""Time axes from stage labels: order, coordinates, adjacent intervals and held-out splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X


def axis(labels: DataFrame, label: str, *, coordinate: str = "physical", scale: float = 1.0) -> DataFrame:
    """``(label, value, t, nth)`` of the distinct labels in order of value, equal values by label.

    ``physical``: value times scale; ``relative``: from 0 to 1 over the axis.
    """
    if coordinate not in ("physical", "relative"):
        raise ValueError(f"no coordinate named {coordinate}")
    x = labels.select(X.day_label(label).alias("label")).where("label is not null").distinct().withColumn("value", X.day_value("label"))
    every = Window.partitionBy()
    t = F.col("value") * scale if coordinate == "physical" else X.relative(F.col("value"), F.min("value").over(every), F.max("value").over(every))
    # Labels are few: the axis is one small partition by nature.
    return x.withColumn("t", t).withColumn("nth", (F.row_number().over(Window.orderBy("value", "label")) - 1).cast("long"))


def intervals(labels: DataFrame, held_out: list[str] | None = None) -> DataFrame:
    """Neighbours on the full axis, with ``touches_heldout``; what a held-out label parts is not joined anew."""
    w = Window.orderBy("value", "label")
    x = labels.select(F.col("label").alias("day0"), F.lead("label").over(w).alias("day1"), F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), "nth").where("day1 is not null")
    held = list(held_out or [])
    hit = F.col("day0").isin(held) | F.col("day1").isin(held) if held else F.lit(False)
    return x.withColumn("touches_heldout", hit)


def by_position(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels asked for, in order of the axis; unknown ones come last."""
    return wanted.join(labels.select("label", "nth"), "label", "left").withColumn("place", F.coalesce("nth", F.lit(1 << 31))).drop("nth")
