"""What small tables in order do not show: orders, memory and disk of queries on larger ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import decompose, evaluate, fields, manifold, neighbours, training
from helixframe.plans.catalogue import ORACLE_SQL, QUERIES
from helixframe.sources import scratch


def test_rows_of_a_file_are_in_the_order_of_their_ids(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(int(k), draw.normal(size=64).astype(np.float32).tolist(), int(k) % 3) for k in draw.permutation(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["q_row_chunks"](spark, str(tmp_path)).select("chunk", "n", "a", "b").collect()
    want = duckdb.sql(ORACLE_SQL["q_row_chunks"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def shuffled(spark):
    """Shuffle files on disk now."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_what_is_kept_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    x, _ = scratch.kept(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "swept")
    assert x.count() == 10 and spark.conf.get(scratch.SWEEP, None) in (None, "false")
    left = {n for n in shuffled(spark) - before if n.endswith(".data")}
    assert len(left) <= 1  # the count's


@pytest.mark.parametrize("least", [1 << 28, 0])
def test_vectors_of_cells_are_not_written(spark, monkeypatch, least):
    """A pass writes matrices of genes and factors, in slices or at once with the same values."""
    monkeypatch.setattr(decompose, "ENTRIES", 150)
    monkeypatch.setattr(decompose, "LEAST", least, raising=False)
    draw, written, keep = np.random.default_rng(2), [], scratch.kept

    def noted(df, name):
        out = keep(df, name)
        written.append((name, out[0].columns, out[0].count()))
        return out

    monkeypatch.setattr(decompose, "kept", noted)
    a = draw.random((200, 12)) * (draw.random((200, 12)) < 0.4)
    m = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "cell long, gene long, value double")
    _, table = decompose.svd(m, 3, cells=200, power=1)
    assert np.allclose([r["singular"] for r in table.orderBy("pc").collect()], np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-9)
    assert all(n < 200 for name, columns, n in written if name != "decompose" and "value" not in columns)


def test_a_task_of_training_goes_through_its_rows_in_slices(spark, monkeypatch):
    draw = np.random.default_rng(4)
    model, (n, genes, slots) = fields.Conditioned(6, 5, width=4, heads=2, layers=1, kind="cross_attention", seed=1), (300, 3, 2)
    state, target = draw.normal(size=(n, 6)), draw.normal(size=(n, genes))
    vectors, distance = draw.normal(size=(genes, slots, 5)), draw.normal(size=(genes, slots)) * 1000
    promoter, mask = np.array([[1.0, 0.0]] * genes), np.ones((genes, slots))
    loss, grads = training.conditioned_gradient(model, state, target, vectors, distance, promoter, mask)
    monkeypatch.setattr(training, "ACTIVE", 20 * genes * slots * 4 * 4, raising=False)
    monkeypatch.setattr(training, "BLOCK_BYTES", 100 * 8 * (6 + genes), raising=False)
    whole = training.conditioned_gradient

    def few(m, x, *more):
        assert len(x) <= 20
        return whole(m, x, *more)

    monkeypatch.setattr(training, "conditioned_gradient", few)
    rows = spark.createDataFrame([(s.tolist(), t.tolist()) for s, t in zip(state, target, strict=True)], "state array<double>, target array<double>")
    tokens = spark.createDataFrame([(g, vectors[g].tolist(), distance[g].tolist(), promoter[g].tolist(), mask[g].tolist()) for g in range(genes)], "gene long, vectors array<array<double>>, distance array<double>, promoter array<double>, mask array<double>")
    found, sums = training.chunked_loss_and_gradient(model, rows, tokens, chunk=genes, blocks=1)
    assert np.isclose(found, loss / (n * genes), rtol=1e-12) and all(np.allclose(sums[k], v / (n * genes), rtol=1e-9, atol=1e-12) for k, v in grads.items())


def test_no_table_of_the_search_has_more_rows_than_vectors(spark, monkeypatch):
    """Where nothing can be left out every vector meets every tile, in rounds that hold it once."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "TILE", 2 * 16 * 12, raising=False)
    x, written, keep = np.random.default_rng(3).normal(size=(150, 12)), [], scratch.kept

    def noted(df, name):
        out = keep(df, name)
        written.append((name, out[0].count()))
        return out

    monkeypatch.setattr(neighbours, "kept", noted)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(3)
    got = neighbours.nearest(frame, "id", "x", 4).collect()
    z = x / np.linalg.norm(x, axis=1)[:, None]
    d = 2 - 2 * z @ z.T + 9 * np.eye(len(x))
    assert {(r["id"], r["rank"]): r["neighbour"] for r in got} == {(i, k + 1): int(j) for i in range(len(x)) for k, j in enumerate(d[i].argsort()[:4])}
    assert max(n for _, n in written) == len(x) and sum(name == "near-visits" for name, _ in written) > 4


def test_only_the_far_ends_state_moves_once_an_edge(spark, monkeypatch):
    states = spark.createDataFrame([(k, [1.0 * k, 2.0], [1.0, 0.5], 0.0, 1.0) for k in range(4)], "id long, x array<float>, v array<double>, px double, py double")
    edges, plans, keep = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id long, neighbour long"), [], scratch.kept

    def noted(df, name):
        plans.append(df)
        return keep(df, name)

    monkeypatch.setattr(neighbours, "kept", noted)
    assert neighbours.transitions(edges, states).count() == 7
    for x in (evaluate.project_velocity(edges, states), plans[0]):
        joins = [line for line in x._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert len(joins) == 2 and "(neighbour" in joins[1] and "(id" in joins[0]


def test_a_map_keeps_no_table_of_neighbours(spark):
    frame = spark.createDataFrame([(k, [float(k + 1), float(k % 3), 1.0]) for k in range(12)], "id long, x array<double>")
    before = len(scratch._made)
    assert manifold.fit(frame, "id", "x", k=2, epochs=1).count() == 12
    assert not [path for _, path in scratch._made[before:] if "map-neighbours" in path]
