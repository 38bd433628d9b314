"""The pipeline on small tables: what each stage keeps, and that its decisions take effect."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import decontam, minhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", None, "src1", 0), (10**6 + 1, "123 456", "en", None, 7)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1][1], DATA).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return dict(out)


def test_stages_return_rows_of_documents(stages):
    names, frames = list(stages), list(stages.values())
    columns = frames[0].columns
    for a, b, name in zip(frames[:-2], frames[1:-1], names[1:-1], strict=True):
        assert b.columns == columns, name
        assert b.exceptAll(a).count() == 0, name
    assert frames[-1].columns[: len(columns)] == columns


def test_clean_documents_stay(stages):
    counts = {k: v.count() for k, v in stages.items()}
    assert counts["language_id"] >= 0.97 * (counts["input"] - 3)
    assert counts["quality_filter"] >= 0.7 * counts["language_id"]
    assert stages["language_id"].where("text is null or text rlike '^[^a-zA-Z]*$'").count() == 0


def test_decisions_take_effect(spark, stages):
    kept = stages["near_dedup"]
    assert kept.count() == kept.select("doc_id").distinct().count()
    again = minhash.near_duplicates(kept)
    assert again.where("doc_id <> class_id").count() == 0
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    dropped = kept.join(stages["decontaminate"], "doc_id", "left_anti")
    found = decontam.contaminated(kept, bench).select("doc_id").distinct()
    assert sorted(r[0] for r in dropped.select("doc_id").collect()) == sorted(r[0] for r in found.collect())
    mixed = stages["mix_sources"]
    assert mixed.where("taken <= 0 or taken > 3 * size").count() == 0
    off = mixed.groupBy("source").agg(F.sum("taken").alias("s"), F.first("target").alias("t")).where("abs(s - t) > 3").count()
    assert off == 0


def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) >= {"doc_id", "text", "taken"}


CLASHING = ["id", "class_id", "part", "score", "margin", "h", "a", "b", "n", "row", "t", "i", "rows", "least"]


@pytest.mark.parametrize("some", [False, True])
def test_stages_stand_empty_tables_and_clashing_names(spark, some):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60" if some else "false")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DATA)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        kept = got.select(*docs.columns)
        assert kept.count() > 0 if some else kept.count() == 0, name
        assert kept.exceptAll(docs).count() == 0, name
