"""What filters remove in every order: a trie of permutations over persisted survivors, one visit an unordered prefix."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written
from helixframe.sources.scratch import workspace

#: Most filters of an audit: the result has their factorial times their number of rows a part.
MOST = 7
BLANK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: few words, repetition, capitals, symbols."""
    words = F.array_remove(F.split(text, BLANK, -1), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, part, good, toxic, A, B, C, D, E)`` of every row of ``docs(doc_id, text, source)``, written.

    A to D are those of :func:`text_failures`; E holds if a row with a smaller
    ``doc_id`` has the same text anywhere in the table (by SHA-256). A null text
    is empty, a null source the empty part. A null ``doc_id`` is never larger
    nor smaller than another, and rows with equal ids do not repeat each other.
    ``good`` and ``toxic`` say that some row of ``labels(doc_id, quality, toxic)``
    with that id has a 1. Texts are read once and not shuffled; the joins see
    narrow rows and let adaptive execution split a frequent text or id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    rows = written(rows.select("doc_id", "part", F.sha2("_t", 256).alias("digest"), *[c.alias(n) for n, c in text_failures(F.col("_t")).items()]), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "audit-first")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = written(marks, "audit-marks")
    rows = rows.join(first.hint("merge"), "digest", "left").withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("digest", "first")
    rows = written(rows, "audit-repeats").join(marks.hint("merge"), "doc_id", "left")
    sure = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return written(rows.select("doc_id", "part", sure("good"), sure("toxic"), *"ABCDE"), "audit-flags")


def edges(rows: DataFrame, filters: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """``(part, state, n, removed, <mark>_lost...)``: for each set of filters applied before, what survives and what each filter would remove next.

    ``rows`` have a boolean column a filter (true: fails) and a mark, without
    nulls. The trie of all orders is walked depth first; a node applies its
    filter to its parent's persisted survivors, and all orders that come to the
    same set share one node, which is counted once. ``state`` has a bit a
    filter; the arrays have an element a filter, null where it is applied
    already. Only the frames on the way from the root are persisted at a time;
    a lost executor's blocks are filtered anew from ``rows``. Parts without a
    survivor have no row in a state.
    """
    if not 0 < len(filters) <= MOST:
        raise ValueError(f"an audit takes 1 to {MOST} filters, not {len(filters)}")
    spark, path, seen = rows.sparkSession, workspace(rows.sparkSession, "audit-edges"), set()
    every = (1 << len(filters)) - 1

    def counts(survivors: DataFrame, state: int) -> DataFrame:
        left = [None if state >> k & 1 else F.col(f) for k, f in enumerate(filters)]
        of = lambda *c: F.array(*[F.lit(None).cast("long") if x is None else F.count_if(x & c[0] if c else x) for x in left])
        return survivors.groupBy(part).agg(F.count("*").alias("n"), of().alias("removed"), *[of(F.col(m)).alias(f"{m}_lost") for m in marks])

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        counts(survivors, state).write.parquet(f"{path}/state={state}")
        for k, f in enumerate(filters):
            after = state | 1 << k
            if not state >> k & 1 and after != every and after not in seen:
                child = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(child, after)
                child.unpersist()

    root = rows.select(part, *filters, *marks).persist(StorageLevel.MEMORY_AND_DISK)
    visit(root, 0)
    schema = counts(root, 0).withColumn("state", F.lit(0)).schema
    root.unpersist()
    return spark.read.schema(schema).parquet(path)


def orders(rows: DataFrame, filters: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """A row a part, order of all filters and step: what the step's filter keeps and removes, and what it would in other places.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    <mark>_lost..., shapley)``, zeros included. ``redundant`` counts rows that
    fail the filter but are gone before it, ``unique_fails`` those that fail no
    other filter, ``shapley`` sums the filter's removals over all orders. All
    come from the counts of :func:`edges`: a part is one row with a count a set
    of filters, a bound set by the number of filters. An empty table gives no
    rows.
    """
    n, every = len(filters), (1 << len(filters)) - 1
    found = edges(rows, filters, marks, part)
    entry = F.struct("n", "removed", *[f"{m}_lost" for m in marks])
    parts = found.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct(F.col("state"), entry))).alias("_at"))
    count = lambda state, name, k: F.coalesce(F.col("_at")[state][name][k], F.lit(0))
    # A set stands before its next filter in (its size)! (the others' number)! orders.
    weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(every)}
    total = [sum((count(F.lit(s), "removed", k) * weight[s] for s in weight if not s >> k & 1), F.lit(0)) for k in range(n)]
    alone = [count(F.lit(every & ~(1 << k)), "removed", k) for k in range(n)]
    steps = [{"o": "".join(filters[k] for k in p), "s": i + 1, "b": sum(1 << k for k in p[:i]), "k": p[i]} for p in permutations(range(n)) for i in range(n)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, b int, k int>>")
    x = parts.select(part, "_at", F.array(*total).alias("_total"), F.array(*alone).alias("_alone"), F.explode(listed).alias("_o"))
    b, k = F.col("_o.b"), F.col("_o.k")
    removed = count(b, "removed", k)
    return x.select(
        part, F.col("_o.o").alias("filter_order"), F.col("_o.s").alias("step"),
        (F.coalesce(F.col("_at")[b]["n"], F.lit(0)) - removed).alias("kept"), removed.alias("removed"),
        (count(F.lit(0), "removed", k) - removed).alias("redundant"), F.col("_alone")[k].alias("unique_fails"),
        *[count(b, f"{m}_lost", k).alias(f"{m}_lost") for m in marks], F.col("_total")[k].alias("shapley"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
u(k) AS (SELECT unnest(range(1, 6))),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM u a, u b, u c, u d, u e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, step, o[step] AS k, o[1:step - 1] AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, s.o, step, k,
         coalesce(sum(n) FILTER (alive AND NOT fails[k]), 0) AS kept, coalesce(sum(n) FILTER (alive AND fails[k]), 0) AS removed,
         coalesce(sum(n) FILTER (NOT alive AND fails[k]), 0) AS redundant,
         coalesce(sum(n) FILTER (fails[k] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (alive AND fails[k]), 0) AS good_lost, coalesce(sum(toxic) FILTER (alive AND fails[k]), 0) AS toxic_lost
  FROM (SELECT g.*, s.*, NOT list_bool_or(list_transform(gone, lambda x: fails[x]) || [false]) AS alive FROM g, s) s GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda x: chr((64 + x)::INT)), 'string_agg', '') AS filter_order, step::INT AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM r
"""
