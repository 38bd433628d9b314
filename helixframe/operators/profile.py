"""Profiles of tables: label counts, roll-ups, histograms, densities, digests, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X
from helixframe.operators.quantiles import quantile
from helixframe.sources.scratch import workspace


def label_counts(rows: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Counts under several groupings in one pass; blank labels are NA, columns outside a grouping are null."""
    columns = sorted({c for g in groupings for c in g})
    x = rows.select(*[X.filled(c).alias(c) for c in columns])
    sets = ", ".join("(" + ", ".join(g) + ")" for g in groupings)
    view = f"_labels_{abs(hash((tuple(columns), sets))) % 10**8}"
    x.createOrReplaceTempView(view)
    return rows.sparkSession.sql(f"SELECT {', '.join(columns)}, count(*) AS n FROM {view} GROUP BY GROUPING SETS ({sets})")


def presence(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(X.filled(group).alias(group)).agg(*[F.countDistinct(X.filled(c)).alias(f"n_{c}") for c in columns], F.count("*").alias("n"))


def profile(rows: DataFrame, name: str) -> DataFrame:
    """A row a column: type, share of nulls, distinct values, first five of them in order. One pass over an unpivoted scan."""
    n = len(rows.columns)
    args = ", ".join(f"'{c}', cast(`{c}` as string)" for c in rows.columns)
    long = rows.selectExpr(f"stack({n}, {args}) as (column_name, v)")
    types = F.create_map(*[F.lit(x) for c, t in rows.dtypes for x in (c, t)])
    # Distinct values first, with their counts; the first five of a column are cut by a rank that Spark limits before the shuffle.
    values = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    stats = values.groupBy("column_name").agg((F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_fraction"), F.count("v").alias("n_unique"))
    w = Window.partitionBy("column_name").orderBy("v")
    few = values.where("v is not null").withColumn("_k", F.row_number().over(w)).where("_k <= 5")
    few = few.groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list("v")), ", ").alias("examples"))
    out = stats.join(few, "column_name", "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    return out.select(F.lit(name).alias("table_name"), "column_name", F.element_at(types, F.col("column_name")).alias("dtype"), "null_fraction", "n_unique", "examples")


def value_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), column).limit(n)


def top_or_other(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Counts of the ``n`` most frequent values, the rest as ``Other``."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), column).limit(n).select(F.col(column).alias("_best"))
    return counted.join(F.broadcast(best), F.col(column) == F.col("_best"), "left").groupBy(F.coalesce("_best", F.lit("Other")).alias(column)).agg(F.sum("n").alias("n"))


def centroids(rows: DataFrame, group: str, x: str, y: str, *, least: int = 1, skip: list[str] | None = None) -> DataFrame:
    """Exact medians of groups with ``least`` rows or more, without the labels to skip; null is a group. No task holds a group."""
    kept = rows.where(~F.coalesce(F.col(group).isin(skip), F.lit(False))) if skip else rows
    out = kept.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    for name, column in (("x", x), ("y", y)):
        half = quantile(kept, group, column).select(F.col(group).alias("_of"), F.col("value").alias(f"_{name}"))
        out = out.join(half, F.col("_group").eqNullSafe(F.col("_of")), "left").drop("_of")
    return out.select(F.col("_group").alias(group), "n", F.col("_x").alias("x"), F.col("_y").alias("y"))


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """``(bin, n)`` of ``bins`` equal bins from least to largest value, the largest in the last; of equal values all are in bin 0. Nulls count nowhere."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    wide = F.nullif((F.col("hi") - F.col("lo")).cast("double") / bins, F.lit(0.0))
    at = F.coalesce(F.floor((F.col(column) - F.col("lo")) / wide).cast("long"), F.lit(0))
    x = rows.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(ends))
    return x.select(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def hex_density(rows: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """``(hx, hy, n, log10_n)`` of hexagons: of two offset rectangular grids, the nearer centre takes the point."""
    a, b = F.col(x) / size, F.col(y) / (size * 3**0.5)
    ax, ay = F.floor(a + 0.5), F.floor(b + 0.5)
    bx, by = F.floor(a), F.floor(b)
    near = (a - ax) * (a - ax) + 3 * (b - ay) * (b - ay) <= (a - bx - 0.5) * (a - bx - 0.5) + 3 * (b - by - 0.5) * (b - by - 0.5)
    cell = rows.select(F.when(near, 2 * ax).otherwise(2 * bx + 1).cast("long").alias("hx"), F.when(near, 2 * ay).otherwise(2 * by + 1).cast("long").alias("hy"))
    return cell.groupBy("hx", "hy").agg(F.count("*").alias("n")).withColumn("log10_n", F.log10("n"))


def ordered_digest(rows: DataFrame, group: str, key: str) -> DataFrame:
    """One SHA-256 a group over its keys in order, as a digest of digests of runs of some 4096 keys.

    Keys fall in runs by a hash, each run is digested in order, and the digests
    in order of their run: no window over a group, and no list beyond a run's
    keys or a digest a run. Two groups have equal digests if they hold the same
    keys as often.
    """
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.ceil(F.count("*") / F.lit(4096)).cast("int").alias("_runs"))
    runs = rows.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).select(group, F.col(key).alias("_key"), (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("_runs")).alias("_run"))
    runs = runs.groupBy(group, "_run").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_key")), "\n"), 256).alias("d"))
    return runs.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "d"))), lambda s: s["d"]), "\n"), 256).alias("digest"))


def id_digest(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """``(group, n, digest)``: SHA-256 of a group's keys in order, one a line. A group is a bounded list, such as the genes of a panel."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k")))), lambda s: s["k"])
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def require_same_order(rows: DataFrame, group: str, key: str, order: str) -> None:
    """Raises if any two groups hold other keys or another order of them; names up to ten that differ from the first."""
    found = id_digest(rows, group, key, order)
    first = found.orderBy(group).first()
    other = [r[group] for r in found.where((F.col("digest") != first["digest"]) | (F.col("n") != first["n"])).orderBy(group).limit(10).collect()] if first else []
    if other:
        raise ValueError(f"{other} differ from {first[group]} in {key} or its order")


def usable_cells(cells: DataFrame, shard: str, order: str, label: str) -> DataFrame:
    """A row a cell with a stage label that has a value: its columns, ``label``, ``value`` and its ``ordinal`` over all cells of all shards."""
    x = ordinals(cells, shard, order).withColumn("label", X.day_label(label)).withColumn("value", X.day_value("label"))
    return x.where("value is not null")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in order, with the task ``_file`` that wrote them and their place ``_at`` among its rows: one shuffle by range.

    Both are columns of what is written, so they hold however many files a task
    makes of its rows.
    """
    path = workspace(rows.sparkSession, "ordered")
    # The id of a sorted partition's row is the partition's number above 33 bits and the row's place below.
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    x = x.withColumn("_file", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    x.write.parquet(path)
    return rows.sparkSession.read.schema(x.schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the number of each row in its group, from 0, in an order without ties; null is a group.

    Rows are sorted by range and written, so a group with most of the rows is
    many files; windows see one row a file and group.
    """
    x = _placed(rows, [group, *order])
    runs = x.groupBy(F.col(group).alias("_group"), F.col("_file").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_group", "_of", (before - F.col("_first")).alias("_add"))
    x = x.join(runs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_file") == F.col("_of")))
    return x.withColumn(name, (F.col("_at") + F.col("_add")).cast("long")).drop("_file", "_at", "_group", "_of", "_add")


def ordinals(rows: DataFrame, shard: str, order: str) -> DataFrame:
    """Adds ``ordinal``: dense row numbers over all shards, by shard and then ``order``; rows without a shard are left out. Written as in :func:`numbered`."""
    x = _placed(rows.where(F.col(shard).isNotNull()), [shard, order])
    files = x.groupBy(F.col("_file").alias("_of")).agg(F.count("*").alias("_n"))
    # One row a file.
    files = files.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_add"))
    return x.join(files, F.col("_file") == F.col("_of")).withColumn("ordinal", (F.col("_at") + F.col("_add")).cast("long")).drop("_file", "_at", "_of", "_add")


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that all tables hold: one aggregate over their union."""
    every = None
    for k, t in enumerate(tables):
        one = t.select(F.col(key).alias(key), F.lit(k).alias("_t"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.countDistinct("_t").alias("_n")).where(F.col("_n") == len(tables)).select(key)
