"""The thin queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import audit, decontam, hosttext, itq, langid, license, lmscore, minhash, mixing, quality, search, secrets, warc
from helixframe.llm.common import workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(mod: int) -> Column:
    """The remainder that deals documents to folds; -1, which is none, for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(-1))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_host_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosttext.extract(table(spark, sf_dir, "pages"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license.notices(docs, license.fit(docs))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(3) != 1))
    rows = docs.select("doc_id", "text", (fold(3) == 1).alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(fold(5) != 0), table(spark, sf_dir, "labels").where(fold(5) != 0))
    rows = docs.select("doc_id", (fold(5) == 0).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents").withColumn("held_out", fold(7) == 2))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"))
    return mixing.mix(mixing.written(rows, "mix-sizes"), size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.orders(rows, list("ABCDE"), ["good", "toxic"])


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.terms_of(table(spark, sf_dir, "benchmark"))
    found = search.search(search.postings(table(spark, sf_dir, "documents"), wanted), wanted)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_itq": op3_itq,
    "op4_host_text": op4_host_text,
    "op5_license": op5_license,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_lm_score": op8_lm_score,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_search": op12_search,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to, d.url
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
""",
    "op3_itq": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.d = b.d AND list_dot_product(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
""",
    "op10_mixing": mixing.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op12_search": search.ORACLE,
    "op13_secrets": secrets.ORACLE,
}
