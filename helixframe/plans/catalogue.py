"""The registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import exprs as X
from helixframe.operators import decompose, evaluate, fields, intervals, manifold, matrix, neighbours, profile, quantiles, sampling, timeaxis, tokens, training, transport
from helixframe.sources import arrays, readers, writers
from helixframe.sources.scratch import workspace
from helixframe.streaming import passes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(x: Column | str) -> Column:
    return X.c(x).cast("long")


def u(key: str) -> str:
    """SQL of a draw by key."""
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"


# --- intervals ---------------------------------------------------------------------------------

WINDOW, NEAR, WIDTH = 172_800, 21_600, 512

EVENTS = """
e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type FROM events),
g AS (SELECT event_id AS point_id, user_id, pos FROM e WHERE event_type = 'error'),
i AS (SELECT event_id AS interval_id, user_id, pos AS "start", pos + 512 AS "end", pos AS midpoint FROM e WHERE event_type <> 'error'),
j AS (SELECT point_id, g.pos, interval_id, i."start", i."end", midpoint, midpoint - pos AS signed_distance, abs(midpoint - pos) AS abs_distance
      FROM g JOIN i ON g.user_id = i.user_id AND abs(midpoint - pos) <= 172800)"""

LINKS = f"""{EVENTS},
n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY abs_distance, midpoint, interval_id) = 1 AND abs_distance <= 21600 AS is_promoter FROM j),
a AS (SELECT point_id, CAST(interval_id AS VARCHAR) AS ref_id, "start", "end", signed_distance, abs_distance, false AS is_synthetic, is_promoter FROM n
      UNION ALL
      SELECT point_id, 'synthetic_promoter:' || point_id, greatest(0, pos - 256), pos + 256, 0, 0, true, true
      FROM g WHERE point_id NOT IN (SELECT point_id FROM n WHERE is_promoter)),
r AS (SELECT *, (row_number() OVER (PARTITION BY point_id ORDER BY is_promoter DESC, abs_distance, ref_id) - 1)::BIGINT AS token_rank FROM a)"""


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", "user_id", X.seconds("ts").alias("pos"), "event_type")
    points = e.where("event_type = 'error'").select(F.col("event_id").alias("point_id"), "user_id", "pos")
    spans = e.where("event_type <> 'error'").select(F.col("event_id").alias("interval_id"), "user_id", F.col("pos").alias("start"), (F.col("pos") + 512).alias("end"), F.col("pos").alias("midpoint"))
    return points, spans


def _links(spark: SparkSession, d: str) -> DataFrame:
    points, spans = _points(spark, d)
    return intervals.link(points, spans, key="user_id", point_id="point_id", interval_id="interval_id", window=WINDOW, near=NEAR, width=WIDTH)


@query(f"WITH {EVENTS} SELECT point_id, interval_id, signed_distance, abs_distance FROM j")
def q_link_range_join(spark, d):
    points, spans = _points(spark, d)
    return intervals.range_join(points, spans, "user_id", WINDOW).select("point_id", "interval_id", "signed_distance", "abs_distance")


@query(f'WITH {LINKS} SELECT point_id, ref_id, "start" AS span_start, "end" AS span_end, signed_distance, is_synthetic FROM r WHERE is_promoter')
def q_link_nearest_or_synthetic(spark, d):
    return _links(spark, d).where("is_promoter").select("point_id", "ref_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "signed_distance", "is_synthetic")


@query(f"WITH {LINKS} SELECT point_id, ref_id, abs_distance, is_promoter, is_synthetic, token_rank FROM r WHERE token_rank < 4")
def q_link_rank_topk(spark, d):
    return intervals.top(_links(spark, d), 4).select("point_id", "ref_id", "abs_distance", "is_promoter", "is_synthetic", "token_rank")


@query(
    f"""WITH {LINKS}, k AS (SELECT r.*, CASE WHEN is_synthetic THEN NULL ELSE ref_id::BIGINT % (SELECT count(*) FROM embeddings) END AS vec FROM r WHERE token_rank < 4)
SELECT point_id, count(*) AS n_tokens, string_agg(CAST(signed_distance AS VARCHAR), ',' ORDER BY token_rank) AS distances,
       sum(CASE WHEN is_promoter THEN 1 ELSE 0 END)::BIGINT AS n_promoters, round(sum(coalesce(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 0)), 4) AS vector_sum
FROM k LEFT JOIN embeddings ON vec_id = vec GROUP BY point_id"""
)
def q_token_pack(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("vector"))
    links = _links(spark, d).withColumn("vec", F.when(~F.col("is_synthetic"), F.col("ref_id").cast("long") % vectors.count()))
    packed = intervals.pack(links, vectors, group="point_id", ref="vec", k=4)
    t = F.col("tokens")
    return packed.select(
        "point_id", long(F.size(t)).alias("n_tokens"), F.array_join(F.transform(t, lambda x: x["distance"].cast("long").cast("string")), ",").alias("distances"),
        long(F.size(F.filter(t, lambda x: x["is_promoter"]))).alias("n_promoters"),
        F.round(F.aggregate(t, F.lit(0.0), lambda s, x: s + F.coalesce(F.aggregate(x["vector"], F.lit(0.0), lambda p, v: p + v.cast("double")), F.lit(0.0))), 4).alias("vector_sum"),
    )


# --- keys and lookups --------------------------------------------------------------------------


@query("SELECT DISTINCT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def q_missing_keys(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return intervals.missing(wanted, table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("key")), "key")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def q_semi_panel(spark, d):
    panel = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(panel, "l_partkey", "left_semi").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_partkey")


@query("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def q_first_per_key(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@query(
    """WITH f AS (SELECT s_nationkey, (row_number() OVER (ORDER BY min(s_suppkey)) - 1)::BIGINT AS nth FROM supplier GROUP BY s_nationkey)
SELECT s_suppkey, n_name, nth FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey JOIN f USING (s_nationkey)"""
)
def q_lookup(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m")).withColumn("nth", long(F.row_number().over(Window.orderBy("m")) - 1)).drop("m")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(first, "s_nationkey").select("s_suppkey", "n_name", "nth")


@query("SELECT d.doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_index_left_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", long("quality").alias("quality"), long("toxic").alias("toxic"))


@query("SELECT d.doc_id, quality::BIGINT AS quality FROM documents d JOIN labels l USING (doc_id)")
def q_lossy_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").select("doc_id", long("quality").alias("quality"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS o FROM documents),
b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS o FROM embeddings)
SELECT a.o::BIGINT AS ordinal, doc_id, vec_id FROM a JOIN b USING (o)"""
)
def q_positional_join(spark, d):
    docs = profile.ordinals(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("ordinal", "doc_id")
    return docs.join(profile.ordinals(table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id").select("ordinal", "vec_id"), "ordinal")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1)::BIGINT AS ordinal FROM documents")
def q_global_ordinal(spark, d):
    return profile.ordinals(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", "ordinal")


@query(
    """SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity >= 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 25
INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08"""
)
def q_common_keys(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    k = F.col("l_partkey").alias("key")
    return profile.common_keys([li.where("l_quantity >= 45").select(k), p.where("p_size < 25").select(F.col("p_partkey").alias("key")), li.where("l_discount > 0.08").select(k)], "key")


# --- sparse matrix -----------------------------------------------------------------------------

COO = """m AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
n AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS n FROM lineitem)"""


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.collapsed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value")))


def _cells(spark: SparkSession, d: str) -> int:
    return table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey")).first()[0]


@query(f"WITH {COO} SELECT cell, round(sum(value), 4) AS total FROM m GROUP BY cell")
def q_library_size(spark, d):
    return matrix.totals(_matrix(spark, d)).select("cell", F.round("total", 4).alias("total"))


@query(f"WITH {COO} SELECT cell, gene, round(CASE WHEN t > 0 THEN ln(1 + value * 10000.0 / t) ELSE 0 END, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS t FROM m)")
def q_norm_log1p(spark, d):
    return matrix.normalised(_matrix(spark, d)).select("cell", "gene", F.round("value", 6).alias("value"))


@query(
    f"""WITH {COO}, x AS (SELECT gene, CASE WHEN t > 0 THEN ln(1 + value * 10000.0 / t) ELSE 0 END AS v FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS t FROM m))
SELECT gene, round(sum(v) / max(n), 6) AS mean, round(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) * (sum(v) / max(n)), 0), 6) AS variance FROM x, n GROUP BY gene"""
)
def q_hvg_variance(spark, d):
    return matrix.variance(matrix.normalised(_matrix(spark, d)), _cells(spark, d)).select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


VARIANCE = f"""WITH {COO}, v AS (SELECT gene, greatest(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 0) AS variance FROM m, n GROUP BY gene)"""


@query(f"{VARIANCE} SELECT gene, round(variance, 6) AS variance FROM v ORDER BY v.variance DESC, gene LIMIT 50")
def q_hvg_topn(spark, d):
    return matrix.most_variable(matrix.variance(_matrix(spark, d), _cells(spark, d)), 50).select("gene", F.round("variance", 6).alias("variance"))


@query(
    f"""{VARIANCE} SELECT 'g' || p_partkey AS gene_id, coalesce(nullif(p_name, ''), p_type) AS gene_name, p_brand AS gene_type, round(variance, 6) AS variance
FROM v JOIN part ON gene = p_partkey WHERE p_size > 2 ORDER BY v.variance DESC, p_partkey LIMIT 100"""
)
def q_select_panel(spark, d):
    return _panel(spark, d, 100).select("gene_id", "gene_name", "gene_type", F.round("variance", 6).alias("variance"))


def _panel(spark: SparkSession, d: str, n: int, overfetch: int | None = None) -> DataFrame:
    genes = table(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("gene"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"), X.first_filled("p_name", "p_type").alias("gene_name"), F.col("p_brand").alias("gene_type"))
    return matrix.select_panel(matrix.variance(_matrix(spark, d), _cells(spark, d)), genes, n, overfetch=overfetch)


@query(
    f"""{VARIANCE}, t AS (SELECT * FROM v ORDER BY variance DESC, gene LIMIT 150), k AS (SELECT p_brand AS gene_id, gene, variance, row_number() OVER (PARTITION BY p_brand ORDER BY variance DESC, gene) AS k FROM t JOIN part ON gene = p_partkey)
SELECT gene_id, gene, round(variance, 6) AS variance FROM k WHERE k = 1 ORDER BY k.variance DESC, gene LIMIT 50"""
)
def q_select_panel_overfetch(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("gene_id"))
    x = matrix.select_panel(matrix.variance(_matrix(spark, d), _cells(spark, d)), genes, 50, overfetch=100)
    return x.select("gene_id", "gene", F.round("variance", 6).alias("variance"))


@query(f"""WITH {COO}, c AS (SELECT o_orderkey AS cell, o_orderpriority AS stage FROM orders ORDER BY {u("o_orderkey || ':13'")}, o_orderkey LIMIT 200) SELECT cell, stage, gene, round(value, 4) AS value FROM m JOIN c USING (cell)""")
def q_row_gather(spark, d):
    cells = sampling.bottom_k(table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("stage")), "cell", 200, 13)
    return matrix.gather_rows(_matrix(spark, d), cells).select("cell", "stage", "gene", F.round("value", 4).alias("value"))


@query("SELECT max(l_quantity) AS largest, bool_and(abs(l_quantity - round_even(l_quantity, 0)) <= 1e-8 + 1e-5 * abs(round_even(l_quantity, 0))) AS whole, max(l_quantity) > 50 AND bool_and(abs(l_quantity - round_even(l_quantity, 0)) <= 1e-8 + 1e-5 * abs(round_even(l_quantity, 0))) AS count_like FROM lineitem")
def q_count_like(spark, d):
    return matrix.looks_like_counts(table(spark, d, "lineitem").select(F.col("l_quantity").alias("value")))


@query(f"WITH {COO} SELECT cell, gene, round(value, 4) AS value FROM m WHERE gene IN (SELECT p_partkey FROM part WHERE p_size <= 3) AND value > 0")
def q_column_gather(spark, d):
    panel = table(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("gene"))
    return matrix.gather(_matrix(spark, d), panel).where("value > 0").select("cell", "gene", F.round("value", 4).alias("value"))


@query("SELECT l_partkey AS gene, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1")
def q_gene_chunk_concat(spark, d):
    m = _matrix(spark, d).withColumn("chunk", F.floor(F.col("gene") / 512))
    return m.groupBy("chunk", "gene").agg(F.round(F.sum("value"), 4).alias("total")).select("gene", "total")


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def q_chunked_mean(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_returnflag", F.pmod("l_partkey", F.lit(7)).alias("chunk")).agg(F.avg("l_extendedprice").alias("m"), F.count("*").alias("n"))
    return parts.groupBy("l_returnflag").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("mean"))


@query(
    """WITH x AS (SELECT vec_id AS cell, unnest(range(len(embedding))) AS gene, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT unnest(range(4)) AS pc)
SELECT cell, pc, round(sum(v * (((gene * 7 + pc * 3) % 11) - 5) / 10.0), 5) AS score FROM x, p GROUP BY cell, pc"""
)
def q_project_loadings(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("gene", "value")).select("cell", long("gene").alias("gene"), F.col("value").cast("double").alias("value"))
    g = spark.range(64).select(F.col("id").alias("gene")).withColumn("pc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    g = g.withColumn("weight", (F.pmod(F.col("gene") * 7 + F.col("pc") * 3, F.lit(11)) - 5) / 10.0)
    return matrix.project(x, g).select("cell", "pc", F.round("score", 5).alias("score"))


@query(
    f"""WITH {COO}, s AS (SELECT cell, j, sum(value * (1 - 2 * ((('0x' || substr(md5(gene || ':4'), j // 4 + 1, 1))::INT >> (j % 4)) & 1))) AS y FROM m, range(16) t(j) GROUP BY cell, j)
SELECT j, round(sum(y * y) / 1e6, 6) AS energy, count(*) AS n FROM s GROUP BY j"""
)
def q_sketch_energy(spark, d):
    """How much of a sparse matrix each random direction of its genes sees."""
    x = decompose.sketch(_matrix(spark, d), 16, 4)
    return x.groupBy(long("j").alias("j")).agg(F.round(F.sum(F.col("value") * F.col("value")) / 1e6, 6).alias("energy"), F.count("*").alias("n"))


@query(None)
def q_svd(spark, d):
    """The leading components of the sparse matrix of all cells and genes."""
    loadings, table_ = decompose.svd(matrix.normalised(_matrix(spark, d)), 8, cells=_cells(spark, d))
    return loadings.join(F.broadcast(table_), "pc")


def _waves(rows: int, columns: int, shift: int) -> np.ndarray:
    i, j = np.indices((rows, columns))
    return np.cos(shift + 3 * i + 7 * j) / np.sqrt(rows)


@query(
    """WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i) WHERE embedding IS NOT NULL),
h AS (SELECT vec_id, j, sum(v * cos(1 + 3 * i + 7 * j) / 8) AS z FROM e, range(32) t(j) GROUP BY vec_id, j),
p AS (SELECT vec_id, j, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM h),
g AS (SELECT vec_id, j, z * (1 + sign(z) * (1 - exp(-z * z / 2) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))) / 2 AS a FROM p)
SELECT vec_id, k AS gene, round(sum(a * cos(2 + 3 * j + 7 * k) / sqrt(32)), 6) AS velocity FROM g, range(64) t(k) GROUP BY vec_id, k"""
)
def q_mlp_field(spark, d):
    model = fields.MLP([(_waves(64, 32, 1), np.zeros(32)), (_waves(32, 64, 2), np.zeros(64))])
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(fields.apply(model, F.col("embedding").cast("array<double>"))).alias("gene", "velocity"))
    return x.select("vec_id", long("gene").alias("gene"), F.round("velocity", 6).alias("velocity"))


@query(
    """SELECT g AS gene, round(regr_slope(embedding[g + 2]::DOUBLE, embedding[1]::DOUBLE), 6) AS weight, round(regr_intercept(embedding[g + 2]::DOUBLE, embedding[1]::DOUBLE), 6) AS bias
FROM embeddings, range(63) t(g) WHERE embedding IS NOT NULL GROUP BY g"""
)
def q_ridge_field(spark, d):
    """A field fitted over all rows: here, each component by the first one."""
    x = table(spark, d, "embeddings").select(F.slice("embedding", 1, 1).alias("x"), F.slice("embedding", 2, 63).alias("y"))
    model = fields.ridge(x, "x", "y", 0.0)
    rows = [(g, float(w), float(b)) for g, (w, b) in enumerate(zip(model.weight[0], model.bias, strict=True))]
    return spark.createDataFrame(rows, "gene long, weight double, bias double").withColumns({"weight": F.round("weight", 6), "bias": F.round("bias", 6)})


def _shift_rows(spark: SparkSession, d: str) -> DataFrame:
    """States with the velocity that turns a vector by one component."""
    x = F.col("embedding").cast("array<double>")
    turned = F.concat(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, 1))
    return table(spark, d, "embeddings").select("vec_id", x.alias("state"), F.zip_with(turned, x, lambda a, b: a - b).alias("target"))


@query(
    """WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v, embedding[(i + 1) % 64 + 1]::DOUBLE - embedding[i + 1]::DOUBLE AS y FROM embeddings, range(64) t(i) WHERE embedding IS NOT NULL),
h AS (SELECT vec_id, j, sum(v * cos(1 + 3 * i + 7 * j) / 8) AS z FROM e, range(32) t(j) GROUP BY vec_id, j),
p AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t, exp(-z * z / 2) AS x FROM h),
g AS (SELECT *, x * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) AS tail,
             x * (0.254829592 + t * (-0.568993472 + t * (4.264241223 + t * (-5.812608108 + t * 5.307027145)))) * t * t * 0.3275911 / sqrt(2) AS falls FROM p),
a AS (SELECT vec_id, j, z * (1 + sign(z) * (1 - tail)) / 2 AS a, (1 + sign(z) * (1 - tail)) / 2 + z * (abs(z) * tail + falls) / 2 AS slope FROM g),
f AS (SELECT vec_id, k, sum(a * cos(2 + 3 * j + 7 * k) / sqrt(32)) AS f FROM a, range(64) u(k) GROUP BY vec_id, k),
o AS (SELECT f.vec_id, k, 2 * (f - y) / (SELECT count(*) FROM e) AS d FROM f JOIN e ON e.vec_id = f.vec_id AND e.i = f.k),
b AS (SELECT o.vec_id, j, sum(d * cos(2 + 3 * j + 7 * k) / sqrt(32)) AS d FROM o, range(32) t(j) GROUP BY o.vec_id, j),
c AS (SELECT b.vec_id, b.j, b.d * slope AS d FROM b JOIN a ON a.vec_id = b.vec_id AND a.j = b.j)
SELECT '0' AS name, (i * 32 + j)::BIGINT AS at, round(sum(v * d), 8) AS gradient FROM e JOIN c ON c.vec_id = e.vec_id GROUP BY i, j
UNION ALL SELECT '0.bias', j::BIGINT, round(sum(d), 8) FROM c GROUP BY j
UNION ALL SELECT '1', (j * 64 + k)::BIGINT, round(sum(a * d), 8) FROM a JOIN o ON o.vec_id = a.vec_id GROUP BY j, k
UNION ALL SELECT '1.bias', k::BIGINT, round(sum(d), 8) FROM o GROUP BY k"""
)
def q_train_gradient(spark, d):
    """The gradient of a field with a hidden layer over all vectors; the driver makes rows of the model's weights alone."""
    model = fields.MLP([(_waves(64, 32, 1), np.zeros(32)), (_waves(32, 64, 2), np.zeros(64))])
    _, grads = training.loss_and_gradient(model, _shift_rows(spark, d))
    rows = [(n, k, float(v)) for n, x in grads.items() for k, v in enumerate(x.ravel())]
    return spark.createDataFrame(rows, "name string, at long, gradient double").withColumn("gradient", F.round("gradient", 8))


@query(None)
def q_train_mlp(spark, d):
    """Eight steps over minibatches that hold all vectors twice; the losses of the run, whose checkpoints another run would go on from."""
    model, rows = fields.MLP.seeded([64, 32, 64], 0), _shift_rows(spark, d)
    _, losses = training.train(spark, model, lambda k: rows.where(F.pmod("vec_id", F.lit(4)) == k % 4), 8, workspace(spark, "train"), {"query": "train_mlp"}, optimiser=training.AdamW(rate=0.02))
    return spark.createDataFrame([(k, x) for k, x in enumerate(losses)], "step long, loss double")


PANEL_TOKENS = 4


def _panel_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each brand as a gene, brands in order: its first parts by key, the first as the promoter, with a vector each."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("vector"))
    p = table(spark, d, "part")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = p.select("p_brand", "p_partkey", "p_size", F.row_number().over(w).alias("k")).where(F.col("k") <= PANEL_TOKENS)
    p = p.withColumn("vec", F.col("p_partkey") % vectors.count()).join(vectors, "vec")
    packed = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("k", "vector", (F.col("p_size") * 100 * (2 * (F.col("k") % 2) - 1)).cast("double").alias("distance")))).alias("t"))
    brands = tokens.category_codes(packed, "p_brand")
    gone = F.lit(PANEL_TOKENS) - F.size("t")
    filled = lambda name, zero: F.concat(F.transform("t", lambda x: x[name]), F.array_repeat(zero, gone))
    flag = lambda f: F.concat(F.transform("t", f), F.array_repeat(F.lit(0.0), gone))
    return packed.join(brands, "p_brand").select(
        F.col("code").alias("gene"), filled("vector", F.array_repeat(F.lit(0.0), 64)).alias("vectors"), filled("distance", F.lit(0.0)).alias("distance"),
        flag(lambda x: F.when(x["k"] == 1, 1.0).otherwise(0.0)).alias("promoter"), flag(lambda x: F.lit(1.0)).alias("mask"),
    )


def _small_field() -> fields.Conditioned:
    """One layer, one head, two columns: weights are waves, biases nothing."""
    m = fields.Conditioned(64, 64, width=2, heads=1, layers=1, kind="film")
    plain = {n: _waves(*v.shape, k) if v.ndim == 2 else v for k, (n, v) in enumerate(sorted(m.weights.items()))}
    return fields.Conditioned(64, 64, width=2, heads=1, layers=1, kind="film", weights=plain)


def _field_sql(m: fields.Conditioned) -> str:
    """The small field in SQL: tokens of brands, one attention to the promoter, its state scaled and shifted by the vector's."""
    w = m.weights
    num = lambda v: f"({float(v)!r})"
    dot = lambda xs, column: "(" + " + ".join(f"{x} * {num(v)}" for x, v in zip(xs, column, strict=True)) + ")"
    listed = lambda x, column: f"list_dot_product({x}, [{', '.join(num(v) for v in column)}]::DOUBLE[])"
    tail = "exp(-{z} * {z} / 2) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * 1.061405429))))"
    gelu = lambda z: f"({z} * (1 + sign({z}) * (1 - {tail.format(z=z)})) / 2)"
    norm = lambda a, b: [f"(({x} - ({a} + {b}) / 2) / sqrt(({a} - {b}) * ({a} - {b}) / 4 + 1e-5))" for x in (a, b)]
    far = [f"tanh(dist / 100000.0 * {num(w['distance'][0, h])})" for h in (0, 1)]
    start = [f"{listed('v', w['token'][:, c])} + {dot(far, w['far'][:, c])} + CASE WHEN k = 1 THEN {num(w['promoter'][1, c])} ELSE {num(w['promoter'][0, c])} END" for c in (0, 1)]
    cols = lambda n, xs: ", ".join(f"{dot(xs, w[f'0.{n}'][:, c])} AS {n}{c}" for c in (0, 1))
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part QUALIFY k <= {PANEL_TOKENS}),
t AS (SELECT p_brand, k, (p_size * 100 * (2 * (k % 2) - 1))::DOUBLE AS dist, x AS v FROM p JOIN e ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
a AS (SELECT p_brand, k, dist, {start[0]} AS a0, {start[1]} AS a1 FROM t),
r AS (SELECT p_brand, k, a0 * cos(dist / 1000) - a1 * sin(dist / 1000) AS x0, a0 * sin(dist / 1000) + a1 * cos(dist / 1000) AS x1 FROM a),
z AS (SELECT *, {norm('x0', 'x1')[0]} AS z0, {norm('x0', 'x1')[1]} AS z1 FROM r),
h AS (SELECT *, {cols('q', ['z0', 'z1'])}, {cols('k', ['z0', 'z1'])}, {cols('v', ['z0', 'z1'])} FROM z),
s AS (SELECT h.p_brand, exp((f.q0 * h.k0 + f.q1 * h.k1) / sqrt(2)) AS s, h.v0, h.v1, f.x0, f.x1 FROM h JOIN h f ON f.p_brand = h.p_brand AND f.k = 1),
o AS (SELECT p_brand, any_value(x0) AS x0, any_value(x1) AS x1, sum(s * v0) / sum(s) AS b0, sum(s * v1) / sum(s) AS b1 FROM s GROUP BY p_brand),
y AS (SELECT p_brand, x0 + {dot(['b0', 'b1'], w['0.o'][:, 0])} AS y0, x1 + {dot(['b0', 'b1'], w['0.o'][:, 1])} AS y1 FROM o),
n AS (SELECT *, {norm('y0', 'y1')[0]} AS n0, {norm('y0', 'y1')[1]} AS n1 FROM y),
u AS (SELECT p_brand, y0, y1, {', '.join(f"{dot(['n0', 'n1'], w['0.up'][:, c])} AS u{c}" for c in range(8))} FROM n),
g AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS gene, {', '.join(f"y{c} + {dot([gelu(f'u{j}') for j in range(8)], w['0.down'][:, c])} AS g{c}" for c in (0, 1))} FROM u),
i AS (SELECT vec_id, {', '.join(f"{listed('x', w['0.state'][:, c])} AS i{c}" for c in (0, 1))} FROM e WHERE x IS NOT NULL),
j AS (SELECT vec_id, {gelu('i0')} AS j0, {gelu('i1')} AS j1 FROM i),
c AS (SELECT vec_id, {', '.join(f"{dot(['j0', 'j1'], w['0.context'][:, k])} AS c{k}" for k in range(4))} FROM j),
f AS (SELECT vec_id, gene, g0 * (1 + c0) + c2 AS f0, g1 * (1 + c1) + c3 AS f1 FROM g, c)
SELECT vec_id, gene::BIGINT AS gene, round({dot(norm('f0', 'f1'), w['head'][:, 0])}, 6) AS velocity FROM f"""


@query(_field_sql(_small_field()))
def q_conditioned_field(spark, d):
    """Velocities of genes with packed tokens for each vector's state, in chunks of genes; the second call reads what the first kept."""
    path, rows, genes = workspace(spark, "velocities"), _shift_rows(spark, d), _panel_tokens(spark, d)
    for _ in range(2):
        found = training.variants({"film": _small_field()}, rows, genes, "vec_id", path, {"tables": d}, chunk=8, blocks=4)
    return found.select("vec_id", "gene", F.round("velocity", 6).alias("velocity"))


@query(None)
def q_train_conditioned(spark, d):
    """Four steps of a field conditioned on packed tokens, by chunks of genes and blocks of cells; the losses."""
    model, genes = fields.Conditioned(64, 64, width=8, heads=2, layers=2, kind="cross_attention", seed=1), _panel_tokens(spark, d)
    n = genes.count()
    rows = _shift_rows(spark, d).withColumn("target", F.slice("target", 1, n))
    _, losses = training.train(spark, model, lambda k: rows.where(F.pmod("vec_id", F.lit(4)) == k), 4, workspace(spark, "train"), {"query": "train_conditioned"}, tokens=genes, optimiser=training.AdamW(rate=0.01), chunk=8, blocks=4)
    return spark.createDataFrame([(k, x) for k, x in enumerate(losses)], "step long, loss double")


# --- time --------------------------------------------------------------------------------------

LABELS = """l AS (SELECT DISTINCT regexp_replace(x, '^([0-9]+)[.]0$', '\\1') AS label FROM (
  SELECT CASE WHEN day(o_orderdate) = 1 THEN 'P' || month(o_orderdate) WHEN month(o_orderdate) <= 6 THEN 'E' || month(o_orderdate) || '.5' ELSE (year(o_orderdate) - 1980) || '.0' END AS x FROM orders)),
v AS (SELECT label, regexp_extract(label, '([0-9]+(?:[.][0-9]+)?)', 1)::DOUBLE + CASE WHEN upper(label[1]) = 'P' THEN 19.0 ELSE 0.0 END AS value FROM l),
a AS (SELECT *, (row_number() OVER (ORDER BY value, label) - 1)::BIGINT AS nth FROM v),
p AS (SELECT label AS day0, lead(label) OVER (ORDER BY value, label) AS day1, value / 24 AS t0, lead(value / 24) OVER (ORDER BY value, label) AS t1, nth FROM a)"""
HELD = ["E3.5", "15"]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    x = F.when(F.dayofmonth(at) == 1, F.concat(F.lit("P"), F.month(at).cast("string"))).when(F.month(at) <= 6, F.concat(F.lit("E"), F.month(at).cast("string"), F.lit(".5")))
    return table(spark, d, "orders").select(x.otherwise(F.concat((F.year(at) - 1980).cast("string"), F.lit(".0"))).alias("stage"))


@query(f"WITH {LABELS} SELECT label, value, round(value * (1.0 / 24), 6) AS t, nth FROM a")
def q_time_axis(spark, d):
    return timeaxis.axis(_labels(spark, d), "stage", scale=1 / 24).select("label", "value", F.round("t", 6).alias("t"), "nth")


@query(f"WITH {LABELS} SELECT label, round((value - min(value) OVER ()) / nullif(max(value) OVER () - min(value) OVER (), 0), 6) AS t FROM a")
def q_time_relative(spark, d):
    return timeaxis.axis(_labels(spark, d), "stage", coordinate="relative").select("label", F.round("t", 6).alias("t"))


@query(f"WITH {LABELS} SELECT label, nth FROM a")
def q_stage_order(spark, d):
    return timeaxis.axis(_labels(spark, d), "stage").select("label", "nth")


def _adjacent(spark: SparkSession, d: str) -> DataFrame:
    return timeaxis.intervals(timeaxis.axis(_labels(spark, d), "stage", scale=1 / 24), HELD)


@query(f"WITH {LABELS} SELECT day0, day1, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM p WHERE day1 IS NOT NULL AND day0 NOT IN ('E3.5', '15') AND day1 NOT IN ('E3.5', '15')")
def q_intervals_train(spark, d):
    return _adjacent(spark, d).where("not touches_heldout").select("day0", "day1", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query(f"WITH {LABELS} SELECT day0, day1 FROM p WHERE day1 IS NOT NULL AND (day0 IN ('E3.5', '15') OR day1 IN ('E3.5', '15'))")
def q_intervals_heldout(spark, d):
    return _adjacent(spark, d).where("touches_heldout").select("day0", "day1")


@query(f"WITH {LABELS}, w(label) AS (VALUES ('15'), ('E3.5'), ('unseen')) SELECT w.label, coalesce(nth, 2147483648)::BIGINT AS place FROM w LEFT JOIN a ON w.label = a.label")
def q_heldout_order(spark, d):
    wanted = spark.createDataFrame([("15",), ("E3.5",), ("unseen",)], "label string")
    return timeaxis.by_position(wanted, timeaxis.axis(_labels(spark, d), "stage")).select("label", long("place").alias("place"))


# --- profiles ----------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT event_type, CAST(user_id % 5 AS VARCHAR) AS grp FROM events)
SELECT event_type, NULL AS grp, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT NULL, grp, count(*) FROM x GROUP BY 2 UNION ALL SELECT event_type, grp, count(*) FROM x GROUP BY 1, 2"""
)
def q_label_counts(spark, d):
    x = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("grp"))
    return profile.label_counts(x, [["event_type"], ["grp"], ["event_type", "grp"]])


@query("SELECT coalesce(nullif(c_mktsegment, ''), 'NA') AS c_mktsegment, count(DISTINCT c_nationkey) AS n_c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def q_presence(spark, d):
    return profile.presence(table(spark, d, "customer"), "c_mktsegment", ["c_nationkey"])


def _column_sql(t: str, c: str, kind: str) -> str:
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS dtype, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction, count(DISTINCT CAST({c} AS VARCHAR)) AS n_unique,
(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS examples FROM {t}"""


#: Columns whose values both engines write alike.
PROFILED = {"customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"}, "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"}}
PROFILE = " UNION ALL ".join(_column_sql(t, c, kind) for t, columns in PROFILED.items() for c, kind in columns.items())


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    a, b = (profile.profile(table(spark, d, t).select(*columns), t) for t, columns in PROFILED.items())
    return a.unionByName(b, allowMissingColumns=True)


@query(PROFILE)
def q_profile_columns(spark, d):
    return _profiles(spark, d)


@query(f"SELECT table_name, column_name, round(1 - null_fraction, 6) AS present, n_unique FROM ({PROFILE}) ORDER BY null_fraction, n_unique DESC, column_name LIMIT 3")
def q_profile_sort(spark, d):
    return _profiles(spark, d).orderBy("null_fraction", F.desc("n_unique"), "column_name").limit(3).select("table_name", "column_name", F.round(1 - F.col("null_fraction"), 6).alias("present"), "n_unique")


@query("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer")
def q_column_selection(spark, d):
    c = table(spark, d, "customer")
    return c.select(c.colRegex("`^c_.*key$`")).withColumn("c_nationkey", long("c_nationkey"))


@query(
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), b AS (SELECT event_type FROM c ORDER BY n DESC, event_type LIMIT 2)
SELECT CASE WHEN event_type IN (SELECT event_type FROM b) THEN event_type ELSE 'Other' END AS event_type, sum(n)::BIGINT AS n FROM c GROUP BY 1"""
)
def q_topn_other(spark, d):
    return profile.top_or_other(table(spark, d, "events"), "event_type", 2)


@query("SELECT l_returnflag, count(*) AS n, round(median(l_quantity), 4) AS x, round(median(l_extendedprice), 4) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 HAVING count(*) >= 10")
def q_group_centroid(spark, d):
    c = profile.centroids(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", least=10, skip=["N"])
    return c.select("l_returnflag", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.9), 4) AS value FROM lineitem GROUP BY 1")
def q_group_quantiles(spark, d):
    """The upper tenth of prices by a label that half of all rows have."""
    return quantiles.quantile(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice", 0.9).withColumn("value", F.round("value", 4))


@query(
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT least(greatest(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 50)) AS BIGINT), 0), 49) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1"""
)
def q_hist50(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50).select(long("bin").alias("bin"), "n")


@query(
    """WITH p AS (SELECT l_quantity / 5.0 AS a, (l_extendedprice / 2000.0) / (5.0 * 1.7320508075688772) AS b FROM lineitem),
q AS (SELECT a, b, floor(a + 0.5) AS ax, floor(b + 0.5) AS ay, floor(a) AS bx, floor(b) AS fy FROM p),
h AS (SELECT CASE WHEN near THEN 2 * ax ELSE 2 * bx + 1 END::BIGINT AS hx, CASE WHEN near THEN 2 * ay ELSE 2 * fy + 1 END::BIGINT AS hy
      FROM (SELECT *, (a - ax) * (a - ax) + 3 * (b - ay) * (b - ay) <= (a - bx - 0.5) * (a - bx - 0.5) + 3 * (b - fy - 0.5) * (b - fy - 0.5) AS near FROM q))
SELECT hx, hy, count(*) AS n, round(log10(count(*)), 6) AS log10_n FROM h GROUP BY hx, hy"""
)
def q_hex_density(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000.0).alias("y"))
    return profile.hex_density(x, "x", "y", 5.0).withColumn("log10_n", F.round("log10_n", 6))


@query("SELECT props, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, props LIMIT 10")
def q_value_counts(spark, d):
    return profile.value_counts(table(spark, d, "events"), "props", 10)


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::BIGINT AS nth FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 2")
def q_head_per_group(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").withColumn("nth", long(F.row_number().over(w))).where("nth <= 2").select("conv_id", "turn", "role", "nth")


@query("SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1")
def q_argmin(spark, d):
    x = table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("m"))
    return x.select("user_id", "m.event_id", F.round("m.value", 6).alias("value"))


@query("SELECT source, count(*) AS n_obs, count(text) AS n_text, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def q_shard_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_obs"), F.count("text").alias("n_text"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("langs"))


@query("SELECT count(*) AS n, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)::BIGINT AS large, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_orderkey) AS cells FROM lineitem")
def q_totals(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 40).alias("large"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.countDistinct("l_orderkey").alias("cells"))


@query("SELECT kind, count(*) AS n, count(user_id) AS users, count(o_custkey) AS customers FROM (SELECT 'event' AS kind, user_id, NULL AS o_custkey FROM events UNION ALL SELECT 'order', NULL, o_custkey FROM orders) GROUP BY 1")
def q_union_all(spark, d):
    a = table(spark, d, "events").select(F.lit("event").alias("kind"), "user_id")
    b = table(spark, d, "orders").select(F.lit("order").alias("kind"), "o_custkey")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("user_id").alias("users"), F.count("o_custkey").alias("customers"))


@query(
    """WITH z AS (SELECT source, ceil(count(*) / 4096.0)::BIGINT AS runs FROM documents GROUP BY source),
r AS (SELECT d.source, doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % runs AS run FROM documents d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
s AS (SELECT source, run, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS h FROM r GROUP BY source, run)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY run)) AS digest FROM s GROUP BY source"""
)
def q_id_digest(spark, d):
    return profile.ordered_digest(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


# --- text and names ----------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT p_partkey, 'gene_id "g' || p_partkey || '.' || p_size || '"; gene_name "' || p_name || '"; gene_type "' || p_brand || '"; note; gene_name "' || p_type || '"' AS raw FROM part)
SELECT p_partkey, split_part(regexp_extract(raw, 'gene_id "([^"]*)"', 1), '.', 1) AS gene_id, regexp_extract_all(raw, 'gene_name "([^"]*)"', 1)[-1] AS gene_name, regexp_extract(raw, 'gene_type "([^"]*)"', 1) AS gene_type FROM x"""
)
def q_attr_parse(spark, d):
    raw = F.concat(F.lit('gene_id "g'), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit('"; gene_name "'), "p_name", F.lit('"; gene_type "'), "p_brand", F.lit('"; note; gene_name "'), "p_type", F.lit('"'))
    x = table(spark, d, "part").select("p_partkey", X.attributes(raw).alias("a"))
    return x.select("p_partkey", X.unversioned(F.col("a")["gene_id"]).alias("gene_id"), F.col("a")["gene_name"].alias("gene_name"), X.first_filled(F.col("a")["gene_type"], F.try_element_at("a", F.lit("gene_biotype"))).alias("gene_type"))


@query("SELECT doc_id, greatest(0, n_chars // 2 - 50) AS span_start, substr(text, CAST(greatest(0, n_chars // 2 - 50) + 1 AS BIGINT), 100) AS seq FROM documents")
def q_seq_window(spark, d):
    start = X.window_start(F.expr("n_chars div 2"), 100)
    return table(spark, d, "documents").select("doc_id", start.alias("span_start"), F.substr("text", start.cast("int") + 1, F.lit(100)).alias("seq"))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) >= 12 THEN substr(upper(p_name), (length(p_name) - 12) // 2 + 1, 12)
ELSE rpad(repeat('N', (12 - length(p_name)) // 2) || upper(p_name), 12, 'N') END AS seq FROM part"""
)
def q_pad_trim(spark, d):
    return table(spark, d, "part").select("p_partkey", X.pad_or_trim("p_name", 12).alias("seq"))


def _at(k: int):
    return lambda row: F.get(row, k)


@query("SELECT p_partkey, " + ", ".join(f"(length(p_type) - length(replace(upper(p_type), '{b}', '')))::BIGINT AS n_{b.lower()}" for b in "ACGT") + " FROM part")
def q_onehot_counts(spark, d):
    hot = X.one_hot("p_type")
    return table(spark, d, "part").select("p_partkey", *[long(F.aggregate(F.transform(hot, _at(k)), F.lit(0.0), lambda s, v: s + v)).alias(f"n_{b.lower()}") for k, b in enumerate("ACGT")])


@query("SELECT n_nationkey::BIGINT AS key, 'chr' || n_name AS chrom, n_name || ',chr' || n_name AS aliases FROM nation UNION ALL SELECT -1, 'chrMT', 'chrMT,MT,chrM,M'")
def q_chrom_alias(spark, d):
    x = table(spark, d, "nation").select(long("n_nationkey").alias("key"), "n_name").unionByName(spark.createDataFrame([(-1, "chrMT")], "key long, n_name string"))
    return x.select("key", X.chrom("n_name").alias("chrom"), F.array_join(X.chrom_aliases("n_name"), ",").alias("aliases"))


@query("SELECT p_partkey, substr(trim(regexp_replace(p_type || ' / ' || p_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 80) AS name FROM part")
def q_safe_name(spark, d):
    return table(spark, d, "part").select("p_partkey", X.safe_name(F.concat("p_type", F.lit(" / "), "p_name")).alias("name"))


@query("SELECT event_id, concat_ws('_', event_type, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'aux' END, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'run' || (event_id % 3) END) AS name FROM events")
def q_artifact_name(spark, d):
    state = F.when(F.col("event_id") % 2 == 0, "expression").otherwise("aux")
    label = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")))
    return table(spark, d, "events").select("event_id", X.artifact_name("event_type", state, label).alias("name"))


@query(
    """SELECT 'g' || p_partkey AS gene_id, upper(p_name) AS gene_short_name, 'protein_coding' AS gene_type, p_brand AS chr, TRY_CAST(substr(p_type, 1, 1) AS INTEGER)::BIGINT AS lead_digit FROM part"""
)
def q_schema_normalise(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("ID"), F.col("p_name").alias("Gene Name"), F.col("p_brand").alias("chromosome"), F.substring("p_type", 1, 1).alias("lead"))
    x = readers.aliased(p, readers.GENE_ALIASES | {"lead": []}, {"gene_type": "protein_coding"})
    return x.select("gene_id", F.upper("gene_short_name").alias("gene_short_name"), "gene_type", "chr", F.col("lead").try_cast("int").cast("long").alias("lead_digit"))


@query(
    """SELECT o_orderkey, (o_orderkey + o_custkey) // 2 AS midpoint, CASE WHEN o_orderstatus = 'F' THEN o_orderkey - 1 ELSE o_custkey - 1 END AS tss0 FROM orders
WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O') AND o_custkey IS NOT NULL AND o_totalprice > 1000"""
)
def q_filters(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1") & F.col("o_orderstatus").isin("F", "O") & F.col("o_custkey").isNotNull() & (F.col("o_totalprice") > 1000))
    strand = F.when(F.col("o_orderstatus") == "F", "+").otherwise("-")
    return o.select("o_orderkey", X.midpoint("o_orderkey", "o_custkey").alias("midpoint"), X.tss0("o_orderkey", "o_custkey", strand).alias("tss0"))


# --- sampling ----------------------------------------------------------------------------------


@query(f"SELECT event_id FROM events ORDER BY {u("event_id || ':7'")}, event_id LIMIT 100")
def q_sample_bottomk(spark, d):
    return sampling.bottom_k(table(spark, d, "events").select("event_id"), "event_id", 100, 7)


BIJECTION = """('0x' || substr(md5(key || ':' || k % 6 || ':' || {x}), 1, 13))::BIGINT"""


@query(
    f"""WITH RECURSIVE n AS (SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
s AS (SELECT label, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM n WHERE i = 0), t AS (SELECT unnest(range(4)) AS batch), w AS (SELECT unnest(range(48)) AS draw),
f AS (SELECT label, n, a, b, batch, draw, label || ':' || batch || ':5' AS key, 0 AS k, draw // b AS l, draw % b AS r, false AS done FROM s, t, w WHERE n >= 48
      UNION ALL
      SELECT label, n, a, b, batch, draw, key, k + 1, l, r, k % 6 = 5 AND l * b + r < n FROM (
        SELECT label, n, a, b, batch, draw, key, k, CASE WHEN k % 2 = 0 THEN (l + {BIJECTION.format(x="r")}) % a ELSE l END AS l, CASE WHEN k % 2 = 1 THEN (r + {BIJECTION.format(x="l")}) % b ELSE r END AS r FROM f WHERE NOT done)),
x AS (SELECT label, batch, draw, l * b + r AS i FROM f WHERE done
      UNION ALL SELECT label, batch, draw, CAST(floor({u("label || ':' || batch || ':' || draw || ':5:own'")} * n) AS BIGINT) FROM s, t, w WHERE n < 48)
SELECT batch, label::BIGINT AS label, draw, vec_id FROM x JOIN n USING (label, i)"""
)
def q_sample_batches(spark, d):
    x = sampling.batches(table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 48, 4, 5)
    return x.select("batch", long("label").alias("label"), "draw", "vec_id")


@query(
    f"""WITH {LABELS}, o AS (SELECT day0, day1, row_number() OVER (ORDER BY t0, day0) - 1 AS i, count(*) OVER () AS n FROM p WHERE day1 IS NOT NULL AND day0 NOT IN ('E3.5', '15') AND day1 NOT IN ('E3.5', '15')),
b AS (SELECT o_orderkey AS batch FROM orders)
SELECT batch, day0, day1 FROM b JOIN o ON i = CAST(floor({u("batch || ':11'")} * n) AS BIGINT)"""
)
def q_interval_choice(spark, d):
    """Each order draws one of the training intervals."""
    options = _adjacent(spark, d).where("not touches_heldout").select("day0", "day1", "t0")
    n = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    picks = sampling.choose(n, options, ["t0", "day0"], 11)
    return picks.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("batch")), "batch").select("batch", "day0", "day1")


@query(
    f"""WITH {COO}, c AS (SELECT o_orderkey AS cell, o_orderpriority AS stage, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders),
e AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings),
s AS (SELECT * FROM c ORDER BY {u("cell || ':17'")}, cell LIMIT 300)
SELECT s.cell, stage, s.k::BIGINT AS ordinal, round(x, 5) AS x, round(y, 5) AS y, count(gene) AS n_genes, round(coalesce(sum(value), 0), 4) AS total
FROM s LEFT JOIN e ON e.k = s.k LEFT JOIN m ON m.cell = s.cell GROUP BY ALL"""
)
def q_plot_sample(spark, d):
    """A drawn sample of cells with their entries and places; a second call reads what the first kept."""
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("stage"))
    places = table(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    path = workspace(spark, "plot")
    for _ in range(2):
        drawn, entries = sampling.plot_sample(cells, _matrix(spark, d), places, "vec_id", 300, 17, path, {"tables": d})
    x = drawn.join(entries.groupBy("cell").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total")), "cell", "left")
    return x.select("cell", "stage", "ordinal", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


PAIRS = "p AS (SELECT label AS batch, i, j, 1 + (i * 3 + j * 5) % 7 AS w FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))"


@query(
    f"""WITH {PAIRS}, r AS (SELECT batch, i, j, sum(w) OVER (PARTITION BY batch ORDER BY i, j) AS hi, w FROM p), t AS (SELECT batch, sum(w) AS t FROM p GROUP BY 1),
x AS (SELECT batch, draw, {u("batch || ':' || draw || ':3'")} * t AS q FROM t, (SELECT unnest(range(16)) AS draw))
SELECT x.batch::BIGINT AS batch, draw, i, j, round({u("x.batch || ':' || draw || ':3:tau'")}, 9) AS tau FROM x JOIN r ON x.batch = r.batch AND q >= hi - w AND q < hi"""
)
def q_pair_draw(spark, d):
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias(n)
    p = table(spark, d, "embeddings").select(F.col("label").alias("batch")).distinct().select("batch", side("i")).select("batch", "i", side("j"))
    p = p.withColumn("p", (1 + (F.col("i") * 3 + F.col("j") * 5) % 7).cast("double"))
    return transport.draw_pairs(p, 16, 3).select(long("batch").alias("batch"), "draw", "i", "j", F.round(X.uniform("batch", "draw", F.lit("3:tau")), 9).alias("tau"))


# --- transport and evaluation ------------------------------------------------------------------

SIDES = """n AS (SELECT vec_id, label % 4 AS side, vec_id // 128 AS batch, embedding, row_number() OVER (PARTITION BY label % 4, vec_id // 128 ORDER BY vec_id) - 1 AS i FROM embeddings),
s AS (SELECT side AS label, batch, i, embedding AS x FROM n)"""


def _side(spark: SparkSession, d: str, side: int, name: str) -> DataFrame:
    """A quarter of all vectors, in minibatches of neighbouring ids."""
    x = table(spark, d, "embeddings").where(F.col("label") % 4 == side).withColumn("batch", F.floor(F.col("vec_id") / 128))
    i = F.row_number().over(Window.partitionBy("batch").orderBy("vec_id")) - 1
    return x.select("batch", long(i).alias(name), F.col("embedding").cast("array<double>").alias("x"))


@query(
    f"""WITH {SIDES}, z AS (SELECT label, batch, i, list_transform(x, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(x, lambda w: w::DOUBLE * w::DOUBLE)))) AS x FROM s)
SELECT a.batch, a.i, b.i AS j, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 5) AS cost
FROM z a JOIN z b ON a.batch = b.batch AND a.label = 0 AND b.label = 1"""
)
def q_pairwise_cost(spark, d):
    return transport.costs(_side(spark, d, 0, "i"), _side(spark, d, 1, "j")).withColumn("cost", F.round("cost", 5))


SINKHORN = f"""{SIDES}, z AS (SELECT label, batch, i, list_transform(x, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(x, lambda w: w::DOUBLE * w::DOUBLE)))) AS x FROM s),
c AS (SELECT a.batch, a.i, b.i AS j, -list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) / 0.05 AS k FROM z a JOIN z b ON a.batch = b.batch AND a.label = 0 AND b.label = 1),
m AS (SELECT *, -ln(count(*) OVER (PARTITION BY batch, j)) AS a, -ln(count(*) OVER (PARTITION BY batch, i)) AS b FROM c),
r AS (SELECT batch, i, j, k, a, b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0 AS it FROM m
      UNION ALL
      SELECT batch, i, j, k, a, b, u, b - (hj + ln(sum(exp(k + u - hj)) OVER (PARTITION BY batch, j))), it FROM (
        SELECT *, max(k + u) OVER (PARTITION BY batch, j) AS hj FROM (
          SELECT batch, i, j, k, a, b, a - (hi + ln(sum(exp(k + v - hi)) OVER (PARTITION BY batch, i))) AS u, it + 1 AS it FROM (
            SELECT *, max(k + v) OVER (PARTITION BY batch, i) AS hi FROM r WHERE it < 80))))"""


@query(f"WITH RECURSIVE {SINKHORN} SELECT batch, i, j, round(exp(k + u + v), 6) AS p FROM r WHERE it = 80")
def q_sinkhorn(spark, d):
    return transport.couple(transport.costs(_side(spark, d, 0, "i"), _side(spark, d, 1, "j"))).withColumn("p", F.round("p", 6))


@query(
    f"""WITH RECURSIVE {SINKHORN}, p AS (SELECT batch, i, j, exp(k + u + v) AS p FROM r WHERE it = 80), h AS (SELECT batch, i, j, p, sum(p) OVER (PARTITION BY batch ORDER BY i, j) AS hi FROM p),
t AS (SELECT batch, sum(p) AS t FROM p GROUP BY 1), q AS (SELECT batch, draw, {u("batch || ':' || draw || ':21'")} * t AS q FROM t, (SELECT unnest(range(32)) AS draw)),
y AS (SELECT q.batch, draw, i, j, {u("q.batch || ':' || draw || ':21:tau'")} AS tau FROM q JOIN h ON q.batch = h.batch AND q >= hi - p AND q < hi)
SELECT y.batch, draw, round(tau, 9) AS tau, round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (1 - tau) * t[1]::DOUBLE + tau * t[2]::DOUBLE)), 5) AS xt_sum,
       round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[2]::DOUBLE - t[1]::DOUBLE) / 0.5)), 4) AS target_sum,
       round(list_sum(list_transform(list_zip(c.x, e.x), lambda t: (1 - tau) * t[1]::DOUBLE + tau * t[2]::DOUBLE)), 5) AS state_sum
FROM y JOIN s a ON a.label = 0 AND a.batch = y.batch AND a.i = y.i JOIN s b ON b.label = 1 AND b.batch = y.batch AND b.i = y.j
       JOIN s c ON c.label = 2 AND c.batch = y.batch AND c.i = y.i JOIN s e ON e.label = 3 AND e.batch = y.batch AND e.i = y.j"""
)
def q_cfm_coupled(spark, d):
    """Pairs drawn by the coupling, then the points between them."""
    a, b = _side(spark, d, 0, "i"), _side(spark, d, 1, "j")
    pairs = transport.draw_pairs(transport.couple(transport.costs(a, b)), 32, 21)
    way = transport.interpolate(pairs, a, b, 8.5, 9.0, 21, states=(_side(spark, d, 2, "i"), _side(spark, d, 3, "j")))
    return way.select("batch", "draw", F.round("tau", 9).alias("tau"), F.round(_total("xt"), 5).alias("xt_sum"), F.round(_total("target"), 4).alias("target_sum"), F.round(_total("state_t"), 5).alias("state_sum"))


CFM = f"""{SIDES}, q AS (SELECT a.batch, a.i, a.x AS x0, b.x AS x1, c.x AS s0, e.x AS s1, {u("a.batch || ':' || a.i || ':9:tau'")} AS tau
FROM s a JOIN s b ON a.label = 0 AND b.label = 1 AND a.batch = b.batch AND a.i = b.i JOIN s c ON c.label = 2 AND c.batch = a.batch AND c.i = a.i JOIN s e ON e.label = 3 AND e.batch = a.batch AND e.i = a.i)"""


def _way(spark: SparkSession, d: str) -> DataFrame:
    a, b = _side(spark, d, 0, "i"), _side(spark, d, 1, "j")
    c, e = _side(spark, d, 2, "i"), _side(spark, d, 3, "j")
    ids = a.select("batch", "i").join(b.select("batch", F.col("j").alias("i")), ["batch", "i"]).join(c.select("batch", "i"), ["batch", "i"]).join(e.select("batch", F.col("j").alias("i")), ["batch", "i"])
    pairs = ids.select("batch", F.col("i").alias("draw"), "i", F.col("i").alias("j"))
    return transport.interpolate(pairs, a, b, 8.5, 9.0, 9, states=(c, e))


def _total(x: str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


@query(
    f"""WITH {CFM} SELECT batch, i AS draw, round(tau, 9) AS tau, round(list_sum(list_transform(list_zip(x0, x1), lambda t: (1 - tau) * t[1]::DOUBLE + tau * t[2]::DOUBLE)), 5) AS xt_sum,
round(list_sum(list_transform(list_zip(x0, x1), lambda t: (t[2]::DOUBLE - t[1]::DOUBLE) / 0.5)), 4) AS target_sum FROM q"""
)
def q_cfm_interpolate(spark, d):
    return _way(spark, d).select("batch", "draw", F.round("tau", 9).alias("tau"), F.round(_total("xt"), 5).alias("xt_sum"), F.round(_total("target"), 4).alias("target_sum"))


@query(f"WITH {CFM} SELECT batch, i AS draw, round(list_sum(list_transform(list_zip(s0, s1), lambda t: (1 - tau) * t[1]::DOUBLE + tau * t[2]::DOUBLE)), 5) AS state_sum FROM q")
def q_cfm_state(spark, d):
    return _way(spark, d).select("batch", "draw", F.round(_total("state_t"), 5).alias("state_sum"))


ERRORS = f"""WITH {CFM}, x AS (SELECT batch, unnest(range(len(x0))) AS g, unnest(list_transform(list_zip(x0, x1), lambda t: -(t[2]::DOUBLE - t[1]::DOUBLE) / 0.5)) AS err FROM q)"""
SCORES = "count(DISTINCT g) AS n_eval_genes, round(avg(err * err), 5) AS loss, round(avg(abs(err)), 5) AS velocity_mae, round(avg(err * err * 0.25), 5) AS displacement_mse, round(avg(abs(err) * 0.5), 5) AS displacement_mae"


def _persistence(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.errors(_way(spark, d).withColumn("pred", F.transform("target", lambda _: F.lit(0.0))), "pred", "target")


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("batch", "eval_gene_set", "n_eval_genes", *[F.round(c, 5).alias(c) for c in ("loss", "velocity_mae", "displacement_mse", "displacement_mae")])


@query(f"{ERRORS} SELECT batch, 'full' AS eval_gene_set, {SCORES} FROM x GROUP BY batch")
def q_eval_persistence(spark, d):
    return _rounded(evaluate.scores(_persistence(spark, d), F.lit(0.5)))


@query(f"{ERRORS} SELECT batch, 'full' AS eval_gene_set, {SCORES} FROM x GROUP BY batch UNION ALL SELECT batch, 'legacy', {SCORES} FROM x WHERE g % 2 = 0 GROUP BY batch")
def q_eval_gene_sets(spark, d):
    sets = spark.range(64).where("id % 2 = 0").select(F.lit("legacy").alias("eval_gene_set"), F.col("id").cast("int").alias("g"))
    return _rounded(evaluate.scores(_persistence(spark, d), F.lit(0.5), sets))


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'days' ELSE 'relative' END AS time_scale, (5000 * (1 + event_id % 2))::BIGINT AS panel, CASE event_id % 4 WHEN 0 THEN 'mlp' WHEN 1 THEN 'film' ELSE 'cross_attention' END AS variant,
CASE WHEN event_id % 5 = 0 THEN 'transfer' ELSE 'scratch' END AS training, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3, 4"""
)
def q_metric_rollup(spark, d):
    e = F.col("event_id")
    path = F.concat(F.lit("runs/panel"), (5000 * (1 + e % 2)).cast("string"), F.when(e % 3 == 0, "_days/").otherwise("_relative/"), F.when(e % 4 == 0, "mlp").when(e % 4 == 1, "film").otherwise("cross_attention"), F.when(e % 5 == 0, "_transfer").otherwise(""))
    x = evaluate.metric_fields(table(spark, d, "events").select(path.alias("path"), "value"), "path")
    return evaluate.roll_up(x, ["time_scale", "panel", "variant", "training"], ["value"]).withColumns({"value": F.round("value", 6), "panel": long("panel")})


KNN = """z AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)))) AS x FROM embeddings),
k AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, greatest(2 - 2 * list_dot_product(a.x, b.x), 0) AS distance FROM z a JOIN z b ON a.vec_id <> b.vec_id)"""


@query(f"WITH {KNN} SELECT id, neighbour, round(distance, 5) AS distance, (row_number() OVER (PARTITION BY id ORDER BY distance, neighbour))::BIGINT AS rank FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) <= 5")
def q_knn(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("id", "neighbour", F.round("distance", 5).alias("distance"), "rank")


PROJECT = f"""{KNN}, w AS (SELECT id, neighbour FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) <= 10),
e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
g AS (SELECT vec_id, x, list_transform(range(1, len(x) + 1), lambda k: x[k % len(x) + 1] - x[k]) AS v, list_sum(list_slice(x, 1, len(x) // 2)) AS px, list_sum(list_slice(x, len(x) // 2 + 1, len(x))) AS py FROM e),
n AS (SELECT w.id, list_transform(list_zip(a.x, b.x), lambda t: t[2] - t[1]) AS dx, a.v, b.px - a.px AS ox, b.py - a.py AS oy FROM w JOIN g a ON w.id = a.vec_id JOIN g b ON w.neighbour = b.vec_id),
c AS (SELECT id, ox, oy, exp(list_dot_product(dx, v) / (greatest(sqrt(list_dot_product(dx, dx)), 1e-12) * greatest(sqrt(list_dot_product(v, v)), 1e-12))) AS wt FROM n),
f AS (SELECT id, sum(wt * ox) / sum(wt) - avg(ox) AS vx, sum(wt * oy) / sum(wt) - avg(oy) AS vy FROM c GROUP BY id)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ten neighbours of each vector, and the vectors with a velocity and a place on a map."""
    e = table(spark, d, "embeddings")
    near = neighbours.nearest(e, "vec_id", "embedding", 10).select("id", "neighbour")
    x = F.col("embedding").cast("array<double>")
    # The state stays as it is stored: it moves once an edge.
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("_e"), x.alias("x"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, a: s + a)
    n, half = F.size("x"), F.floor(F.size("x") / 2).cast("int")
    turned = F.concat(F.slice("x", 2, n - 1), F.slice("x", 1, 1))
    rows = rows.select("id", F.col("_e").alias("x"), F.zip_with(turned, "x", lambda a, b: a - b).alias("v"), total(F.slice("x", F.lit(1), half)).alias("px"), total(F.slice("x", half + 1, n)).alias("py"))
    return near, rows


def _velocities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    near, rows = _graph(spark, d)
    return evaluate.project_velocity(near, rows), rows


@query(f"WITH {PROJECT} SELECT id, round(vx, 6) AS vx, round(vy, 6) AS vy FROM f")
def q_velocity_project(spark, d):
    return _velocities(spark, d)[0].select("id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@query(f"WITH {PROJECT} SELECT CAST(floor(px / 0.5) AS BIGINT) AS gx, CAST(floor(py / 0.5) AS BIGINT) AS gy, round(avg(vx), 5) AS vx, round(avg(vy), 5) AS vy, count(*) AS n FROM f JOIN g ON id = vec_id GROUP BY 1, 2 HAVING count(*) >= 2")
def q_velocity_grid(spark, d):
    moved, rows = _velocities(spark, d)
    return evaluate.velocity_grid(moved.join(rows.select("id", "px", "py"), "id"), 0.5, 2).withColumns({"vx": F.round("vx", 5), "vy": F.round("vy", 5)})


@query(
    f"""WITH {PROJECT}, o AS (SELECT w.id, w.neighbour, list_transform(list_zip(a.x, b.x), lambda t: t[2] - t[1]) AS dx, a.v FROM w JOIN g a ON w.id = a.vec_id JOIN g b ON w.neighbour = b.vec_id),
m AS (SELECT id, neighbour, list_dot_product(dx, v) / (greatest(sqrt(list_dot_product(dx, dx)), 1e-12) * greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS c FROM o),
b AS (SELECT id, max(c) AS best FROM m GROUP BY id), q AS (SELECT quantile_cont(best, 0.98) AS mark FROM b),
a AS (SELECT id, neighbour, c FROM m UNION ALL SELECT vec_id, vec_id, coalesce(least(greatest(mark - best, 0), 1), 1) FROM e LEFT JOIN b ON id = vec_id, q)
SELECT id, neighbour, round(exp(10 * c) / sum(exp(10 * c)) OVER (PARTITION BY id), 6) AS p FROM a"""
)
def q_transitions(spark, d):
    near, rows = _graph(spark, d)
    return neighbours.transitions(near, rows).withColumn("p", F.round("p", 6))


@query(None)
def q_manifold(spark, d):
    """A map fitted to three quarters of the vectors; the others are placed in it."""
    e = table(spark, d, "embeddings")
    known = e.where("vec_id % 4 <> 0")
    at = manifold.fit(known, "vec_id", "embedding", k=10, epochs=10, seed=3)
    new = manifold.place(e.where("vec_id % 4 = 0"), known, at, "vec_id", "embedding", k=10)
    return at.withColumn("fitted", F.lit(True)).unionByName(new.withColumn("fitted", F.lit(False)))


# --- tokens ------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT upper(p_name) AS s, max(p_partkey) AS token_id FROM part WHERE p_size > 10 GROUP BY 1),
b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS species, p_brand, upper(p_name) AS s, p_size * 100 AS start FROM part),
c AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS code FROM (SELECT DISTINCT species || '_' || p_brand AS place FROM b)),
p AS (SELECT s, min({'a': start, 'b': code}) AS m FROM b JOIN c ON place = species || '_' || p_brand WHERE species = 'A' GROUP BY s)
SELECT p_partkey AS gene, CASE WHEN t.s IS NULL OR p.s IS NULL THEN -1 ELSE token_id END::BIGINT AS token_id, CASE WHEN t.s IS NULL OR p.s IS NULL THEN -1 ELSE m.b END::BIGINT AS chrom_id,
CASE WHEN t.s IS NULL OR p.s IS NULL THEN -1 ELSE m.a END::BIGINT AS start_pos, NOT (t.s IS NULL OR p.s IS NULL) AS valid FROM part LEFT JOIN t ON t.s = upper(p_name) LEFT JOIN p ON p.s = upper(p_name)"""
)
def q_gene_metadata(spark, d):
    return _genes(spark, d).withColumnRenamed("start", "start_pos")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    names = p.where("p_size > 10").select(F.col("p_name").alias("symbol"), F.col("p_partkey").alias("token_id"))
    places = p.select(F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("species"), F.col("p_brand").alias("chromosome"), F.col("p_name").alias("symbol"), (F.col("p_size") * 100).alias("start"))
    return tokens.gene_metadata(p.select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol")), names, places, "A")


@query(
    """WITH c AS (SELECT n_nationkey, r_name, r_name || '_' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, dense_rank() OVER (ORDER BY place) - 1 AS code FROM c) SELECT n_nationkey::BIGINT AS n_nationkey, code::BIGINT AS code FROM k WHERE r_name = 'ASIA'"""
)
def q_cat_codes(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).withColumn("place", F.concat_ws("_", "r_name", "n_name"))
    return x.join(tokens.category_codes(x, "place"), "place").where("r_name = 'ASIA'").select(long("n_nationkey").alias("n_nationkey"), "code")


SENTENCES = f"""WITH {COO}, g AS (SELECT p_partkey AS gene, p_partkey + 7 AS token_id, p_size::BIGINT % 5 AS chrom_id, p_size::BIGINT * 100 AS start FROM part),
w AS (SELECT cell, m.gene, ln(1 + value) AS w FROM m JOIN g ON m.gene = g.gene WHERE value > 0),
r AS (SELECT cell, gene, sum(w) OVER (PARTITION BY cell ORDER BY gene) AS hi, w, sum(w) OVER (PARTITION BY cell) AS t FROM w),
x AS (SELECT cell, draw, {u("cell || ':' || draw || ':11'")} * t AS q FROM (SELECT DISTINCT cell, t FROM r), (SELECT unnest(range(8)) AS draw)),
y AS (SELECT x.cell, draw, g.* FROM x JOIN r ON x.cell = r.cell AND q >= hi - w AND q < hi JOIN g ON r.gene = g.gene),
c AS (SELECT cell, chrom_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY start, draw, token_id) AS body, count(*) AS n FROM y GROUP BY 1, 2),
s AS (SELECT cell, '3,' || string_agg((143574 + chrom_id) || ',' || body || ',2', ',' ORDER BY {u("cell || ':' || chrom_id || ':11:order'")}, chrom_id) AS sentence, (1 + sum(n + 2))::BIGINT AS length FROM c GROUP BY cell)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") + 7).alias("token_id"), (size % 5).alias("chrom_id"), (size * 100).alias("start"), F.lit(True).alias("valid"))
    return tokens.sentences(_matrix(spark, d), genes, 8, 11)


@query(f"{SENTENCES} SELECT cell, sentence FROM s")
def q_cell_sentence(spark, d):
    return _sentences(spark, d).select("cell", F.array_join("sentence", ",").alias("sentence"))


@query(f"{SENTENCES}, b AS (SELECT length, (row_number() OVER (PARTITION BY length ORDER BY cell) - 1) // 100 AS bucket FROM s) SELECT length, bucket, count(*) AS n FROM b GROUP BY 1, 2")
def q_length_buckets(spark, d):
    return tokens.length_buckets(_sentences(spark, d)).groupBy("length", "bucket").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, len(embedding) // 2 AS h FROM embeddings),
a AS (SELECT vec_id, x, h, list_transform(range(1, h + 1), lambda j: (vec_id % 50 * 100)::DOUBLE * pow(10000.0, -(j - 1) / greatest(h - 1, 1)::DOUBLE) / 1000.0) AS t FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, h + 1), lambda j: j * (x[j] * cos(t[j]) - x[j + h] * sin(t[j])) + (j + h) * (x[j] * sin(t[j]) + x[j + h] * cos(t[j])))), 4) AS weighted FROM a"""
)
def q_rope(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", X.rope(F.col("embedding"), F.col("vec_id") % 50 * 100).alias("r"))
    weighted = F.aggregate(F.transform("r", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v)
    return x.select("vec_id", F.round(weighted, 4).alias("weighted"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(greatest(round_even((l_partkey - l_suppkey * 25) / 100.0, 0) + 1024, 0), 2048)::BIGINT AS bin FROM lineitem")
def q_pos_bin(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), long(X.position_bin(F.col("l_partkey") - F.col("l_suppkey") * 25)).alias("bin"))


@query(f"WITH {EVENTS} SELECT point_id, interval_id, round(signed_distance / 100000.0, 8) AS scaled FROM j")
def q_distance_scale(spark, d):
    points, spans = _points(spark, d)
    return intervals.range_join(points, spans, "user_id", WINDOW).select("point_id", "interval_id", F.round(F.col("signed_distance") / 100_000.0, 8).alias("scaled"))


@query("WITH x AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label::BIGINT AS label, pos, round(avg(v), 6) AS mean FROM x GROUP BY 1, 2")
def q_mean_pool(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean")).select(long("label").alias("label"), long("pos").alias("pos"), "mean")


# --- digests, order, states --------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS n, sha256(string_agg('g' || p_partkey, chr(10) ORDER BY p_size, 'g' || p_partkey)) AS digest FROM part GROUP BY p_brand")
def q_ordered_ids(spark, d):
    x = table(spark, d, "part").select("p_brand", "p_size", F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"))
    return profile.id_digest(x, "p_brand", "gene_id", "p_size")


@query(
    f"""WITH {LABELS}, x AS (SELECT o_orderpriority, o_orderkey, CASE WHEN day(o_orderdate) = 1 THEN 'P' || month(o_orderdate) WHEN month(o_orderdate) <= 6 THEN 'E' || month(o_orderdate) || '.5' WHEN month(o_orderdate) = 7 THEN 'none' ELSE (year(o_orderdate) - 1980) || '.0' END AS stage FROM orders),
n AS (SELECT *, (row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1)::BIGINT AS ordinal, regexp_replace(stage, '^([0-9]+)[.]0$', '\\1') AS label FROM x)
SELECT o_orderkey, ordinal, label, regexp_extract(label, '([0-9]+(?:[.][0-9]+)?)', 1)::DOUBLE + CASE WHEN label[1] = 'P' THEN 19.0 ELSE 0.0 END AS value FROM n WHERE label <> 'none'"""
)
def q_usable_cells(spark, d):
    at = F.col("o_orderdate")
    stage = F.when(F.dayofmonth(at) == 1, F.concat(F.lit("P"), F.month(at).cast("string"))).when(F.month(at) <= 6, F.concat(F.lit("E"), F.month(at).cast("string"), F.lit(".5")))
    stage = stage.when(F.month(at) == 7, "none").otherwise(F.concat((F.year(at) - 1980).cast("string"), F.lit(".0")))
    x = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", stage.alias("stage"))
    return profile.usable_cells(x, "o_orderpriority", "o_orderkey", "stage").select("o_orderkey", "ordinal", "label", "value")


@query(
    """WITH n AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT a.source, a.i::BIGINT AS i, a.doc_id, b.n_chars::BIGINT AS state FROM n a JOIN n b ON a.source = b.source AND a.i = b.i"""
)
def q_aligned_state(spark, d):
    x = profile.numbered(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "i")
    return intervals.aligned(x.select("source", "i", "doc_id"), x.select("source", "i", long("n_chars").alias("state")), "source", "i")


@query(f"{SENTENCES}, o AS (SELECT o_orderkey AS cell FROM orders UNION SELECT -o_orderkey FROM orders WHERE o_custkey % 10 = 0) SELECT coalesce(length, 0) AS length, count(*) AS n FROM o LEFT JOIN s USING (cell) GROUP BY 1")
def q_empty_cells(spark, d):
    o = table(spark, d, "orders")
    cells = o.select(F.col("o_orderkey").alias("cell")).union(o.where("o_custkey % 10 = 0").select(-F.col("o_orderkey"))).distinct()
    x = tokens.length_buckets(tokens.with_empty(_sentences(spark, d), cells))
    return x.groupBy("length").agg(F.count("*").alias("n"))


@query(f"{SENTENCES} SELECT cell, round(list_avg(list_transform(string_split(sentence, ','), lambda t: (t::BIGINT % 101) / 100.0)), 6) AS x, length::DOUBLE AS y FROM s")
def q_sentence_embedding(spark, d):
    import numpy as np

    def encoder(rows: np.ndarray) -> np.ndarray:
        return np.stack([(rows % 101 / 100).mean(1), np.full(len(rows), float(rows.shape[1]))], axis=1)

    x = tokens.embed(_sentences(spark, d), encoder, 2)
    return x.select("cell", F.round(F.get("vector", 0), 6).alias("x"), F.get("vector", 1).alias("y"))


# --- files: written, then read back ------------------------------------------------------------


@query("SELECT 'g' || p_partkey AS gene_id, p_name AS gene_name, 'protein_coding' AS gene_type, 'chr' || (p_size % 5) AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 - 1 ELSE p_partkey * 10 + p_size - 1 END AS tss0 FROM part WHERE p_size % 3 <> 0")
def q_gtf_file(spark, d):
    p = table(spark, d, "part")
    key, tab = F.col("p_partkey").cast("string"), F.lit("\t")
    kind = F.when(F.col("p_size") % 3 == 0, "lncRNA").otherwise("protein_coding")
    about = F.concat(F.lit('gene_id "g'), key, F.lit('.7"; gene_name "'), F.col("p_name"), F.lit('"; gene_type "'), kind, F.lit('";'))
    line = F.concat_ws("\t", (F.col("p_size") % 5).cast("string"), F.lit("src"), F.lit("gene"), (F.col("p_partkey") * 10).cast("string"), (F.col("p_partkey") * 10 + F.col("p_size")).cast("string"), F.lit("."), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-"), F.lit("."), about)
    path = workspace(spark, "gtf")
    p.select(line.alias("value")).union(p.select(F.concat(F.lit("#"), key, tab))).write.text(path)
    return readers.gtf(spark, path)


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type FROM events)
SELECT 'chr' || user_id AS chrom, pos AS start_pos, pos + 512 AS end_pos, 'e' || event_id AS ccre_id, 'e' || event_id AS element_id, event_type AS state, (2 * pos + 512) // 2 AS midpoint FROM e"""
)
def q_bed_file(spark, d):
    e = table(spark, d, "events").select((F.concat(F.lit("chr"), F.col("user_id").cast("string"))).alias("chrom"), X.seconds("ts").alias("start"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("ccre_id"), F.col("event_type").alias("state"))
    path = workspace(spark, "bed")
    writers.bed(e.withColumn("end", F.col("start") + 512).withColumn("element_id", F.lit("")), path)
    return readers.bed(spark, path).select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "ccre_id", "element_id", "state", "midpoint")


WINDOWS = """WITH s AS (SELECT p_partkey, upper(translate(repeat(md5(CAST(p_partkey AS VARCHAR)), 3), '0123456789abcdef', 'acgtacgtacgtacgt')) AS seq FROM part),
w AS (SELECT p_partkey, seq, p_size::BIGINT * 2 AS mid FROM s JOIN part USING (p_partkey)),
c AS (SELECT p_partkey, substr(seq, greatest(mid - 16, 0) + 1, mid + 16 - greatest(mid - 16, 0)) AS x FROM w),
f AS (SELECT p_partkey AS region_id, rpad(repeat('N', (32 - length(x)) // 2) || x, 32, 'N') AS seq FROM c)"""


def _sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A sequence a part, written as a file and read in pieces, and a region in each."""
    p = table(spark, d, "part")
    name = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    seq = F.translate(F.repeat(F.md5(F.col("p_partkey").cast("string").cast("binary")), 3), "0123456789abcdef", "acgtacgtacgtacgt")
    lines = F.regexp_replace(seq, "(.{40})", "$1\n")
    path = workspace(spark, "fasta")
    p.select(F.concat(F.lit(">"), name, F.lit(" part\n"), lines).alias("value")).write.text(path)
    regions = p.select(F.col("p_partkey").alias("region_id"), name.alias("chrom"), (long("p_size") * 2).alias("midpoint"))
    return readers.fasta(spark, path, 16), regions


@query(f"{WINDOWS} SELECT region_id, seq FROM f")
def q_fasta_windows(spark, d):
    sequences, regions = _sequences(spark, d)
    return readers.fetch(sequences, regions, 32, 16)


@query(
    f"""{WINDOWS}, h AS (SELECT region_id, unnest([substr(seq, 1, 16), substr(seq, 17, 16)]) AS s FROM f), b AS (SELECT region_id, s, unnest(['A', 'C', 'G', 'T']) AS base FROM h)
SELECT region_id, base, round(avg(16 - length(replace(s, base, ''))), 4) AS mean FROM b GROUP BY region_id, base"""
)
def q_region_embedding(spark, d):
    """Counts of bases as an encoder of two halves, pooled; parts that are written are not encoded again."""
    sequences, regions = _sequences(spark, d)

    def encoder(seqs: list[str]) -> np.ndarray:
        return np.array([[[s[a : a + 16].count(c) for c in "ACGT"] for a in (0, 16)] for s in seqs], float)

    path = workspace(spark, "regions")
    for _ in range(2):
        x = tokens.embed_regions(regions, sequences, 32, encoder, 4, path, signature={"tables": d}, parts=4, pool=2, width=16)
    return x.select("region_id", F.posexplode("vector").alias("k", "mean")).select("region_id", F.element_at(F.array(*map(F.lit, "ACGT")), F.col("k") + 1).alias("base"), F.round("mean", 4).alias("mean"))


@query(f"WITH {COO} SELECT cell - 1 AS cell, gene - 1 AS gene, value FROM (SELECT cell + 1 AS cell, gene + 1 AS gene, value FROM m)")
def q_matrix_market_file(spark, d):
    m = _matrix(spark, d)
    size = m.agg(F.max("cell").alias("c"), F.max("gene").alias("g"), F.count("*").alias("n"))
    top = size.select(F.concat(F.lit("%%MatrixMarket matrix coordinate real general\n"), F.concat_ws(" ", F.col("c") + 1, F.col("g") + 1, "n")).alias("value"))
    path = workspace(spark, "matrix")
    top.coalesce(1).write.text(path)
    m.select(F.concat_ws(" ", (F.col("cell") + 1).cast("string"), (F.col("gene") + 1).cast("string"), F.col("value").cast("string")).alias("value")).write.mode("append").text(path)
    return readers.matrix_market(spark, path, size.first()["c"] + 1)


@query("SELECT c_custkey::VARCHAR AS gene_id, c_name AS gene_short_name, 'protein_coding' AS gene_type, c_mktsegment AS chr FROM customer")
def q_csv_aliases(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Gene Name"), F.col("c_mktsegment").alias("Chromosome"))
    path = workspace(spark, "csv")
    writers.csv(c, path, gzip=True)
    return readers.aliased(readers.with_provenance(spark, path), readers.GENE_ALIASES, {"gene_type": "protein_coding"})


@query("SELECT o_orderkey // 1000 AS shard, count(*) AS n, sum(o_custkey)::BIGINT AS custs, min(o_orderkey) AS first FROM orders GROUP BY 1")
def q_sharded_table(spark, d):
    path = workspace(spark, "shards")
    writers.shards(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, "o_orderkey", 1000)
    return spark.read.parquet(path).groupBy(long("shard").alias("shard")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custs"), F.min("o_orderkey").alias("first"))


@query(
    """WITH n AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS k, embedding FROM embeddings)
SELECT k // 16 AS chunk, count(*) AS n, round(sum(embedding[3]::DOUBLE), 4) AS a, round(sum(embedding[1]::DOUBLE), 4) AS b FROM n GROUP BY 1"""
)
def q_row_chunks(spark, d):
    path = workspace(spark, "rows")
    x = table(spark, d, "embeddings")
    # As doubles, whose digits give the very number back. A writer by label sorts by label unless rows are sorted so, and then no other order holds.
    values = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",")
    x.select("label", "vec_id", values.alias("value")).repartition("label").sortWithinPartitions("label", "vec_id").select("label", "value").write.partitionBy("label").text(path)
    rows = readers.row_chunks(spark, f"{path}/*", 16, [2, 0])
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum(F.get("values", 0)), 4).alias("a"), F.round(F.sum(F.get("values", 1)), 4).alias("b"))


@query("SELECT (vec_id // 100)::BIGINT AS block, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS a, round(sum(embedding[64]::DOUBLE), 4) AS b FROM embeddings GROUP BY 1")
def q_array_ranges(spark, d):
    """All vectors written as array files by ranges of rows, and read again a range a task."""
    path = workspace(spark, "arrays")
    arrays.write(table(spark, d, "embeddings"), path, "vec_id", "embedding", parts=4)
    x = arrays.ranges(spark, path)
    return x.groupBy(F.floor(F.col("row") / 100).alias("block")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("values", 0)), 4).alias("a"), F.round(F.sum(F.get("values", 63)), 4).alias("b"))


@query("SELECT p_name AS key, max(p_partkey) AS value FROM part GROUP BY 1")
def q_dictionary_file(spark, d):
    path = workspace(spark, "dictionary")
    p = table(spark, d, "part").groupBy("p_name").agg(F.max("p_partkey").alias("v"))
    p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_name", "v")))).alias("value")).coalesce(1).write.text(path)
    return readers.dictionary(spark, path)


@query(f"WITH {COO}, v AS (SELECT gene, sum(value) / max(n) AS mean, greatest(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n)), 0) AS variance FROM m, n GROUP BY gene) SELECT gene, round(mean, 6) AS mean, round(variance, 5) AS variance FROM v")
def q_incremental_variance(spark, d):
    """Shards arrive in two loads; each is summed once, whatever was summed before."""
    m, folder, state, mark = _matrix(spark, d), *(workspace(spark, x) for x in ("arrived", "state", "mark"))
    for part in (0, 1):
        m.where(F.col("cell") % 2 == part).write.mode("append").parquet(folder)
        passes.accumulate(spark, folder, m.schema.simpleString()[7:-1].replace(":", " "), state, mark)
    return passes.variances(spark, state, _cells(spark, d)).select("gene", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")
def q_resumed(spark, d):
    """What is done stays; a second call with the same signature reads what the first wrote."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    path = workspace(spark, "done")
    done = writers.materialise(c.where("c_custkey % 3 = 0"), path, {"step": 1})
    again = writers.materialise(c.where("c_custkey < 0"), path, {"step": 1})
    left = passes.resume(c, done.unionByName(again), "c_custkey")
    return left.groupBy(long("c_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Link, rank, cut and pack: the slice that exercises the interval operators together."""
    return q_link_rank_topk(spark, d)
