"""Secrets in texts, and who holds them: spans by patterns, ownership of every value over the corpus. SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import written

# Kinds in order, with what a match looks like. The first three are the base, the others are kept for values of few owners only.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "vendor": r"gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "opaque": r"[A-Za-z0-9_-]{24,}",
}
BASE = ("assign", "access", "hex")
KINDS = tuple(PATTERNS)
#: Shortest value of an assignment; longest opaque value.
ASSIGNED, OPAQUE = 8, 128
#: Owners from which on a value is a widely copied example.
WIDE = 5


def _hits(text: Column) -> Column:
    """For each kind that occurs: what it matches in order, and the lengths of what lies before, between and after."""
    found = [F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.transform(F.split(text, p, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("match"))) for k, p in enumerate(PATTERNS.values())]
    return F.array_compact(F.array(*found))


def spans(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, doc)`` of all documents, and ``(row, repo, owner, kind, start, end, digest)`` of every candidate; both written.

    ``kind`` counts :data:`KINDS`, ``start`` and ``end`` (exclusive) count code
    points of the whole text (null: empty), ``digest`` is the SHA-256 of the
    value: group 2 of an assignment, else the match. Matches of a kind are
    leftmost and do not overlap; a match that fails its length is dropped after
    that. Opaque runs need a digit and letters of both cases. A vendor's token
    that overlaps a base span is left out, an opaque run that overlaps either.
    Texts are read once; positions are sums over a row's matches, so many
    matches in one text cost no square.
    """
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col(repo).alias("doc"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    x = written(x.select("row", "doc", "owner", _hits(F.col("_t")).alias("hits")), "secrets-rows")
    rows = x.where(F.size("hits") > 0).repartition("row").select("row", "doc", "owner", F.explode("hits").alias("h"))
    rows = rows.select("row", "doc", "owner", F.col("h.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("h.gap").alias("gap"), F.col("h.match").alias("match"))).alias("k", "m"))
    rows = rows.select("row", "doc", "owner", "kind", "k", F.col("m.gap").alias("gap"), F.col("m.match").alias("match")).where("match is not null")
    size, match = F.length("match"), F.col("match")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    kind = lambda name: F.col("kind") == KINDS.index(name)
    value = F.when(kind("assign"), F.regexp_extract(match, PATTERNS["assign"], 2)).otherwise(match)
    mixed = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]") & (size <= OPAQUE)
    rows = rows.select("row", "doc", "owner", "kind", (upto - size).alias("start"), upto.alias("end"), value.alias("value"), F.when(kind("assign"), F.length(value) >= ASSIGNED).when(kind("opaque"), mixed).otherwise(True).alias("holds"))
    rows = rows.where("holds")
    # Base spans before others of the same start, so that these see them.
    line = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)

    def overlaps(first: str) -> Column:
        """Whether a span of a kind before ``first`` shares a code point."""
        other = F.col("kind") < KINDS.index(first)
        return F.coalesce(F.max(F.when(other, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(other, F.col("start"))).over(after) < F.col("end"), F.lit(False))

    covered = F.when(kind("vendor"), overlaps("vendor")).when(kind("opaque"), overlaps("opaque")).otherwise(False)
    rows = rows.withColumn("covered", covered).where("not covered")
    return x.select("row", "doc"), written(rows.select("row", F.col("doc").alias("repo"), "owner", "kind", "start", "end", F.sha2("value", 256).alias("digest")), "secrets-spans")


def ownership(found: DataFrame) -> DataFrame:
    """``(digest, owners, repos)``: distinct owners of a value and distinct repositories of owners; null is an owner and a repository.

    Each step is an aggregate that tasks begin before the shuffle, so a value
    that most rows hold is a row an owner and repository at most.
    """
    one = found.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("_")).groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return one.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, *, text: str = "text", repo: str = "doc_id", owner: str = "source", wide: int = WIDE) -> DataFrame:
    """A row a document: ``(doc, spans)``, spans in order of start, kind, end as structs ``(start, kind, end, owners, repos)``.

    Base spans always stay. Those of other kinds stay if their value has fewer
    than ``wide`` distinct owners in the whole corpus: what many hold is an
    example, what few hold looks live. Every row of ``docs`` is a document, also
    where ids are null or repeat; an empty table gives no rows.
    """
    rows, found = spans(docs, text, repo, owner)
    held = written(ownership(found), "secrets-owners")
    # Merged, so that adaptive execution can split a value that many rows hold.
    known = found.join(held.hint("merge"), "digest").where((F.col("kind") < len(BASE)) | (F.col("owners") < wide))
    one = F.struct("start", "kind", "end", "owners", "repos")
    both = rows.withColumn("one", F.lit(None).cast(known.select(one.alias("one")).schema["one"].dataType)).unionByName(known.select("row", F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), one.alias("one")))
    return both.groupBy("row").agg(F.max("doc").alias("doc"), F.sort_array(F.collect_list("one")).alias("spans")).select("doc", "spans")


def digest(scanned: DataFrame, *, wide: int = WIDE) -> DataFrame:
    """Counts and texts of :func:`scan`: ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_example)``."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] < len(BASE))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")
    count = lambda f: F.size(F.filter(s, f)).cast("long")
    of = lambda k: count(lambda x: x["kind"] == k)
    return scanned.select(
        F.col("doc").alias("doc_id"), *[of(k).alias(f"n_{n}") for k, n in enumerate(BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(s).alias("spans"),
        count(lambda x: x["kind"] >= len(BASE)).alias("n_added"), count(lambda x: x["owners"] < wide).alias("n_live"), count(lambda x: x["owners"] >= wide).alias("n_example"),
    )


def _sql() -> str:
    """The same in DuckDB's SQL; letters in either case are written out, since its case folding goes beyond ASCII."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = {**PATTERNS, "assign": PATTERNS["assign"].replace("(?i)(password|passwd|secret|token|api_?key)", f"({names})")}
    quoted = {n: p.replace("'", "''") for n, p in patterns.items()}
    kinds = " UNION ALL ".join(f"SELECT rid, doc_id, owner, {k} AS kind, regexp_extract_all(t, '{p}') AS m, list_transform(string_split_regex(t, '{p}'), lambda g: length(g)) AS g FROM d" for k, p in enumerate(quoted.values()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
h AS ({kinds}),
e AS (SELECT rid, doc_id, owner, kind, unnest(range(1, len(m) + 1)) AS k, m, g FROM h WHERE len(m) > 0),
s AS (
  SELECT rid, doc_id, owner, kind, m[k] AS match, CASE kind WHEN 0 THEN regexp_extract(m[k], '{quoted["assign"]}', 2) ELSE m[k] END AS value,
         sum(g[k] + length(m[k])) OVER (PARTITION BY rid, kind ORDER BY k) AS upto FROM e),
c AS (
  SELECT rid, doc_id, owner, kind, (upto - length(match))::BIGINT AS a, upto::BIGINT AS b, value FROM s
  WHERE CASE kind WHEN 0 THEN length(value) >= {ASSIGNED} WHEN 4 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND length(value) <= {OPAQUE} ELSE true END),
f AS (SELECT * FROM c WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM c o WHERE o.rid = c.rid AND o.kind < c.kind AND o.a < c.b AND c.a < o.b)),
w AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners FROM f GROUP BY value),
x AS (
  SELECT rid, list((CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' WHEN 3 THEN 'vendor' ELSE 'opaque' END) || ':' || a || ':' || b ORDER BY a, kind, b) AS spans,
         list((CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END) || ':' || a || ':' || b ORDER BY a, kind, b) FILTER (kind < 3) AS base,
         count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         count(*) FILTER (kind > 2) AS n_added, count(*) FILTER (owners < {WIDE}) AS n_live, count(*) FILTER (owners >= {WIDE}) AS n_example
  FROM f JOIN w USING (value) WHERE kind < 3 OR owners < {WIDE} GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(array_to_string(base, ','), '')) AS base_sha256, coalesce(array_to_string(spans, ','), '') AS spans,
       coalesce(n_added, 0)::BIGINT AS n_added, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN x USING (rid)
"""


ORACLE = _sql()
