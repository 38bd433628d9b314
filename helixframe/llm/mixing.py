"""Mixing sources to target weights by nested hash thresholds, without a sort of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import written

#: Hexadecimal digits of a row's 60-bit key read at each level; the last level reads the rest.
LEVELS = (3, 3, 9)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keys(id_col: str, source_col: str, size: Column) -> dict[str, Column]:
    """The working columns of a row: source, size, and its key's digits by level."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    at, digits = 1, []
    for n in LEVELS:
        digits.append(F.conv(F.substring(digest, at, n), 16, 10).cast("long"))
        at += n
    return {"_source": F.col(source_col), "_size": F.coalesce(size, F.lit(0)).cast("long")} | {f"_k{i}": d for i, d in enumerate(digits)}


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: its size, target, whole repeats and hash threshold.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the total size; no target exceeds ``cap`` times its source's size, and what
    is over goes to the rest by weight until none is above. A source takes all
    its rows ``repeats`` times and once more the rows whose 60-bit key lies
    below the threshold (``t0``, ``t1``, ``t2``); the rows at the threshold
    share the words still missing (``short`` of ``tie``). Sums by source and
    key bucket find the threshold; only the rows of the boundary bucket are
    summed again, at the next level's digits.

    Null sizes count 0. Rows with equal ids (or null ids) have equal keys and
    are taken together. An empty table gives an empty plan.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = written(docs.select(*[c.alias(n) for n, c in _keys(id_col, source_col, size).items()]), "mix-rows")
    hist = written(rows.groupBy("_source", "_k0").agg(F.sum("_size").alias("n")), "mix-hist")

    order = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = hist.groupBy("_source").agg(F.sum("n").alias("s")).withColumn("w", w.cast("long"))
    by_room = Window.orderBy(F.col("room"), F.col("_source").asc_nulls_last())
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("room", (F.col("s") * cap).cast("double") / F.col("w").cast("double"))
        .withColumn("total", F.sum("s").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(F.col("s") * cap).over(before), F.lit(0))).cast("double") / F.sum("w").over(rest).cast("double"))
        .withColumn("nth", F.row_number().over(by_room))
        .withColumn("share", F.min_by("level", F.when(F.col("level") <= F.col("room"), F.col("nth"))).over(every))
        .withColumn("target", F.least(F.col("share") * F.col("w"), (F.col("s") * cap).cast("double")))
        .withColumn("budget", F.floor(F.col("target") + 1e-6).cast("long"))
        .withColumn("repeats", F.when(F.col("s") > 0, F.least(F.expr("budget div s"), F.lit(cap))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("budget") - F.col("repeats") * F.col("s"))
        .select("_source", "s", "target", "repeats", "left")
    )
    edge = sources
    for i in range(len(LEVELS)):
        if i:
            keys = [F.col(f"r._k{j}") == F.col(f"e.t{j}") for j in range(i)]
            on = F.col("r._source").eqNullSafe(F.col("e._source"))
            for k in keys:
                on = on & k
            hist = rows.alias("r").join(edge.alias("e"), on).groupBy("r._source", f"r._k{i}").agg(F.sum("r._size").alias("n"))
        run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("_source").orderBy(f"_k{i}")))
        run = run.select(F.col("_source").alias("hs"), F.col(f"_k{i}").alias(f"t{i}"), "n", "upto")
        found = edge.join(run, edge["_source"].eqNullSafe(run["hs"]) & (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")), "left")
        edge = found.withColumn("left", F.col("left") - (F.col("upto") - F.col("n"))).withColumn("tie", F.col("n")).drop("hs", "n", "upto")
        edge = written(edge, f"mix-edge{i}")
    return edge.withColumnRenamed("left", "short")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes of a row, repeats counted).

    No row's ``taken`` exceeds ``cap`` times its size; the sum over a source is
    its target to less than a word a row at the threshold. The rows are filtered
    by the plan of :func:`mix_plan` alone: one row a source meets each row, the
    texts are not shuffled. Input columns with those names are replaced.
    """
    size = word_count(F.col("text")) if size is None else size
    inner = next(n for n in (f"_mix{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    own = docs.withColumn(inner, F.struct(*[c.alias(n) for n, c in _keys(id_col, source_col, size).items()]))
    plan = mix_plan(docs, id_col=id_col, source_col=source_col, size=size, weights=weights, cap=cap)
    plan = plan.select(F.struct(*plan.columns).alias(f"{inner}p"))
    k, p = F.col(inner), F.col(f"{inner}p")
    below, same = F.lit(False), F.lit(True)
    for i in range(len(LEVELS)):
        below, same = below | (same & (k[f"_k{i}"] < p[f"t{i}"])), same & (k[f"_k{i}"] == p[f"t{i}"])
    once = F.when(below, k["_size"]).when(same, F.expr(f"{inner}._size * {inner}p.short div {inner}p.tie")).otherwise(F.lit(0))
    out = own.join(plan, k["_source"].eqNullSafe(p["_source"]), "left")
    taken = (p["repeats"] * k["_size"] + F.coalesce(once, F.lit(0))).cast("long")
    return out.withColumns({"size": k["_size"], "source_size": p["s"], "target": p["target"], "taken": taken}).drop(inner, f"{inner}p")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, CAST(s * 3 AS DOUBLE) / CAST(w AS DOUBLE) AS room FROM w),
l AS (
  SELECT *, row_number() OVER o AS nth,
         CAST(sum(s) OVER () - coalesce(sum(s * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r WINDOW o AS (ORDER BY room, source NULLS LAST)),
t AS (
  SELECT source, s, least((SELECT min_by(level, nth) FROM l WHERE level <= room) * w, CAST(s * 3 AS DOUBLE)) AS target FROM l),
b AS (
  SELECT *, CASE WHEN s > 0 THEN least(CAST(floor(target + 1e-6) AS BIGINT) // s, 3) ELSE 0 END AS repeats FROM t),
c AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) - repeats * s AS short FROM b),
g AS (SELECT source, k, sum(size)::BIGINT AS n FROM d GROUP BY source, k),
u AS (SELECT source, k, n, (sum(n) OVER (PARTITION BY source ORDER BY k))::BIGINT AS upto FROM g)
SELECT d.doc_id, d.size, c.s AS source_size, c.target,
       CAST(c.repeats * d.size + CASE WHEN u.upto <= c.short THEN d.size
            WHEN u.upto - u.n <= c.short AND u.n > 0 THEN d.size * (c.short - (u.upto - u.n)) // u.n ELSE 0 END AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
       JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.k = u.k
"""
