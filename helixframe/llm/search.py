"""Ranked lexical search: postings in term buckets, integer scores, the best documents of each item."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import written
from helixframe.sources.scratch import workspace

#: Buckets that terms fall in, each a folder of the postings.
BUCKETS = 32
#: Terms of items that go to every task at once; more items are searched in groups of that many.
TERMS = 200_000
#: Postings that a task hands over at once.
ROWS = 100_000
# Fixed value: what is no separator of terms, by bytes of UTF-8.
TERM = rb"[0-9A-Za-z\x80-\xff]+"


def _small(terms: DataFrame, n: int) -> DataFrame:
    """``terms`` of ``n`` rows for every task, or to be met by merging if they are more than a bound."""
    return F.broadcast(terms) if n <= 2 * TERMS else terms.hint("merge")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(docs: DataFrame) -> DataFrame:
    """``(row, doc, n, term, tf)``: how often a row of ``(row, doc, text)`` holds each of its terms, and all its terms together.

    Terms are the maximal runs of ASCII letters, digits and characters beyond
    ASCII, with A to Z in lower case and all else as it is. A row's first line
    has a null term and ``tf`` 0; rows without a term (null texts too) have no
    line at all.
    """

    def lines(doc: pa.Array, at: list, row: list, size: list, length: list, terms: list, times: list) -> pa.RecordBatch:
        spread = lambda v: pa.array(np.repeat(np.array(v, np.int64), length))
        return pa.RecordBatch.from_arrays([spread(row), doc.take(spread(at)), spread(size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["row", "doc", "n", "term", "tf"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        for b in batches:
            parts: tuple[list, ...] = ([], [], [], [], [], [])
            at, row, size, length, terms, times = parts
            for k, (r, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                # Only ASCII letters change in bytes.
                c = Counter(find(t.as_buffer().to_pybytes().lower())) if t.is_valid else None
                if c:
                    at.append(k)
                    row.append(r)
                    size.append(c.total())
                    length.append(len(c) + 1)
                    terms.append(None)
                    terms.extend(c)
                    times.append(0)
                    times.extend(c.values())
                if len(terms) >= ROWS:
                    yield lines(b.column(1), *parts)
                    for x in parts:
                        x.clear()
            if terms:
                yield lines(b.column(1), *parts)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("row", "doc", "text").mapInArrow(count, f"row long, doc {kind}, n long, term string, tf long")


def terms_of(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``, each once, written; rows with equal ids are one item."""
    x = items.select(F.lit(0).cast("long").alias("row"), F.col(item).alias("doc"), F.col(text).alias("text"))
    return written(counted(x).where("term is not null").select(F.col("doc").alias("item"), "term").distinct(), "search-items")


def postings(docs: DataFrame, only: DataFrame | None = None, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(bucket, term, row, doc, n, tf)``: every row's terms, written in term buckets; a row's line without a term is in bucket -1.

    Each row of ``docs`` is a document with its own ``row``, also where ids
    repeat. ``only(term)`` keeps the postings of those terms, by a semi join
    before the shuffle. Adaptive execution cuts a bucket by its size, so one with
    a term that all documents hold is many tasks and files.
    """
    x = counted(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).alias("text")))
    if only is not None:
        # Lines without a term stay.
        kept = written(only.select("term").distinct().withColumn("_kept", F.lit(True)), "search-terms")
        kept = _small(kept, kept.count())
        x = x.join(kept, "term", "left").where("term is null or _kept").select(*x.columns)
    x = x.select(F.when(F.col("term").isNull(), -1).otherwise(bucket(F.col("term"))).alias("bucket"), "term", "row", "doc", "n", "tf")
    path = workspace(docs.sparkSession, "postings")
    x.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema(x.select("term", "row", "doc", "n", "tf", "bucket").schema).parquet(path)


def search(index: DataFrame, wanted: DataFrame, k: int = 50) -> DataFrame:
    """``(item, rank, doc, score)``: the ``k`` best documents of :func:`postings` for each item of ``wanted(item, term)``.

    A term weighs ``floor(1000 ln((2N+2) / (2df+1)))``; a match scores that
    times ``(10^9 tf) div (1000 tf + 20 m)``, where ``m = 50 + (50 n N) div L``,
    N counts the documents with a term and L all their terms. Scores of 0 are
    left out; equal scores go by document id, null last, then by row. Items
    without a term and empty tables give no rows.

    Each document's postings are brought together, once a posting, and meet the
    items' terms there: matches are summed where they arise, and a task sends
    its best ``k`` of each item. The terms of :data:`TERMS` are broadcast; items
    with more of them go in groups, each of which reads the postings again.
    """
    size = index.where("bucket = -1").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    docs, words = size["docs"], size["words"] or 1
    df = index.where("bucket >= 0").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = written(df.select("bucket", "term", w.alias("w")).join(wanted, "term"), "search-weights")
    m = F.expr(f"50L + (50L * n * {docs}L) div {words}L")
    own = index.where("bucket >= 0").select("bucket", "term", "row", "doc", "tf", m.alias("m")).repartition("row")
    one = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
    groups = max(1, -(-weighed.count() // TERMS))
    part = F.pmod(F.xxhash64("item"), F.lit(groups))
    sizes = {r["g"]: r["n"] for r in weighed.groupBy(part.alias("g")).agg(F.count("*").alias("n")).collect()} if groups > 1 else {0: 0}  # a row a group
    # The bare rank lets Spark cut a task's rows to the best before the shuffle.
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    found = None
    for g, n in sorted(sizes.items()):
        summed = own.join(_small(weighed.where(part == g), n), ["bucket", "term"]).groupBy("item", "row", "doc").agg(F.sum(one).alias("score")).where("score > 0")
        top = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")
        found = top if found is None else found.unionByName(top)
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
c AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 50
"""
