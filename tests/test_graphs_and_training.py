"""Training, neighbours, decomposition, quantiles, draws, and array and sequence files, against plain versions."""

import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import decompose, fields, manifold, neighbours, profile, quantiles, sampling, training, transport
from helixframe.sources import arrays, readers

# --- training ----------------------------------------------------------------------------------


def field(kind="film", position="rope"):
    return fields.Conditioned(5, 3, width=8, heads=2, layers=2, kind=kind, position=position, slots=3, seed=2)


def panel(seed=0, genes=7, n=3):
    r = np.random.default_rng(seed)
    mask = np.ones((genes, n))
    mask[1, 2], mask[2, 1:] = 0, 0
    promoter = np.zeros((genes, n))
    promoter[:, 0] = 1
    return r.standard_normal((genes, n, 3)), r.integers(-3000, 3000, (genes, n)).astype(float), promoter, mask


def token_rows(spark, own):
    rows = [(g, *(x[g].tolist() for x in own)) for g in range(len(own[0]))]
    return spark.createDataFrame(rows, "gene long, vectors array<array<double>>, distance array<double>, promoter array<double>, mask array<double>")


def pairs(spark, n, state, target, seed=1):
    r = np.random.default_rng(seed)
    x, y = r.standard_normal((n, state)), r.standard_normal((n, target))
    return x, y, spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, state array<double>, target array<double>").repartition(3)


def slopes_agree(loss, weights, grads):
    r = np.random.default_rng(0)
    for name, w in weights.items():
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in w.shape)
            old, step = w[at], 1e-5
            w[at] = old + step
            up = loss()
            w[at] = old - step
            slope = (up - loss()) / (2 * step)
            w[at] = old
            assert abs(slope - grads[name][at]) < 1e-5 * (1 + abs(slope)), (name, at)


@pytest.mark.parametrize("kind", ["film", "cross_attention"])
@pytest.mark.parametrize("position", ["none", "learned", "rope"])
def test_gradient_of_a_conditioned_field_is_its_slope(kind, position):
    m, own, r = field(kind, position), panel(), np.random.default_rng(3)
    x, y = r.standard_normal((4, 5)), r.standard_normal((4, 7))
    loss, grads = training.conditioned_gradient(m, x, y, *own)
    assert np.isclose(loss, ((m.chunk(x, *own) - y) ** 2).sum())
    slopes_agree(lambda: training.conditioned_gradient(m, x, y, *own)[0], m.weights, grads)


def test_gradient_of_an_mlp_is_its_slope():
    m, r = fields.MLP.seeded([5, 7, 6, 4], 1), np.random.default_rng(3)
    x, y = r.standard_normal((6, 5)), r.standard_normal((6, 4))
    slopes_agree(lambda: training.gradient(m, x, y)[0], training.weights(m), training.gradient(m, x, y)[1])


@pytest.mark.parametrize("chunk", [2, 3, 100])
@pytest.mark.parametrize("blocks", [1, 3])
def test_chunked_gradient_is_the_whole_gradient(spark, chunk, blocks):
    m, own = field("cross_attention"), panel()
    x, y, rows = pairs(spark, 9, 5, 7)
    rows = rows.unionByName(spark.createDataFrame([(100, None, [0.0] * 7), (101, [0.0] * 5, None), (102, [None] * 5, [0.0] * 7)], rows.schema))
    loss, grads = training.chunked_loss_and_gradient(m, rows, token_rows(spark, own), chunk=chunk, blocks=blocks)
    whole, sums = training.conditioned_gradient(m, x, y, *own)
    assert abs(loss - whole / y.size) < 1e-10
    assert all(np.abs(grads[k] - v / y.size).max() < 1e-8 for k, v in sums.items())


def test_predictions_equal_one_pass(spark):
    m, own = field(), panel()
    x, _, rows = pairs(spark, 6, 5, 7)
    rows = rows.unionByName(spark.createDataFrame([(9, None, None)], rows.schema))
    got = {(r["k"], r["gene"]): r["velocity"] for r in training.predict(m, rows, token_rows(spark, own), "k", chunk=3, blocks=2).collect()}
    want = m.chunk(x, *own)
    assert len(got) == 42 and all(abs(got[k, g] - want[k, g]) < 1e-10 for k, g in got)


def plain_training(m, batches, rule):
    w = training.weights(m)
    one, two, losses = {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, []
    for t, (x, y) in enumerate(batches, 1):
        loss, sums = training.gradient(training.rebuilt(m, w), x, y)
        losses.append(loss / y.size)
        for k in w:
            g = sums[k] / y.size
            one[k] = rule.first * one[k] + (1 - rule.first) * g
            two[k] = rule.second * two[k] + (1 - rule.second) * g * g
            w[k] = w[k] - rule.rate * (one[k] / (1 - rule.first**t) / (np.sqrt(two[k] / (1 - rule.second**t)) + rule.tiny) + rule.decay * w[k])
    return w, losses


def test_training_resumes_where_it_was_cut_and_lowers_the_loss(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.standard_normal((60, 4))
    y = np.tanh(x @ r.standard_normal((4, 3)))
    rows = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k long, state array<double>, target array<double>")
    m, rule, asked = fields.MLP.seeded([4, 8, 3], 1), training.AdamW(rate=0.05), []

    def batch(step):
        asked.append(step)
        return rows.where(F.col("k") % 2 == step % 2)

    want, losses = plain_training(m, [(x[s % 2 :: 2], y[s % 2 :: 2]) for s in range(8)], rule)
    path = f"file://{tmp_path}/run"
    training.train(spark, m, batch, 3, path, "a", optimiser=rule)
    got, seen = training.train(spark, m, batch, 8, path, "a", optimiser=rule)
    assert asked == list(range(8)) and np.allclose(seen, losses) and losses[-1] < losses[0] / 2
    assert all(np.allclose(training.weights(got)[k], v) for k, v in want.items())
    training.train(spark, m, batch, 1, path, "b", optimiser=rule)
    assert asked[-1] == 0
    with pytest.raises(ValueError, match="no rows"):
        training.loss_and_gradient(m, rows.where("k < 0"))


def test_a_checkpoint_that_is_not_whole_is_not_read(spark, tmp_path):
    _, _, rows = pairs(spark, 10, 4, 3)
    m, path = fields.MLP.seeded([4, 3], 1), f"file://{tmp_path}/run"
    _, first = training.train(spark, m, lambda k: rows, 2, path, "a")
    (folder,) = (tmp_path / "run").iterdir()
    (folder / "step-1" / "_SUCCESS").unlink()
    _, again = training.train(spark, m, lambda k: rows, 3, path, "a")
    assert np.allclose(first, again[:2])


def test_a_conditioned_field_learns(spark, tmp_path):
    own = panel()
    truth = field(position="none")
    x = np.random.default_rng(1).standard_normal((12, 5))
    y = truth.chunk(x, *own)
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "state array<double>, target array<double>")
    start = fields.Conditioned(5, 3, width=8, heads=2, layers=2, position="none", slots=3, seed=9)
    _, losses = training.train(spark, start, lambda k: rows, 5, f"file://{tmp_path}/run", 1, tokens=token_rows(spark, own), optimiser=training.AdamW(rate=0.02), chunk=4, blocks=2)
    assert losses[-1] < 0.8 * losses[0]


# --- neighbours --------------------------------------------------------------------------------


def plain_neighbours(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        d = [(round(max(2 - 2 * float(u[a] @ u[b]), 0), 9), j) for b, j in enumerate(ids) if j != i]
        out[i] = sorted(d)[:k]
    return out


def near(frame, k, **more):
    out = {}
    for r in neighbours.nearest(frame, "id", "x", k, **more).orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"]))
        assert r["rank"] == len(out[r["id"]])
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in zip(ids, x, strict=True)], "id long, x array<double>").repartition(3)


@pytest.mark.parametrize("block", [4, 16, 8192])
def test_neighbours_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ASKS", 5)
    r = np.random.default_rng(0)
    centres = r.standard_normal((6, 5)) * 4
    x = np.concatenate([centres[k % 6] + r.standard_normal((1, 5)) * 0.3 for k in range(90)])
    x = np.concatenate([x, np.repeat(x[:1], 25, 0), x[1:2] * 3])
    ids = [7 * k % 1009 for k in range(len(x))]
    frame = vectors(spark, ids, x).unionByName(spark.createDataFrame([(2000, None), (2001, [0.0] * 5), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5), (2004, []), (None, [1.0] * 5)], "id long, x array<double>"))
    got, want = near(frame, 4), plain_neighbours(ids, x, 4)
    assert got.keys() == want.keys()
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]] or np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-8)
    same = sorted(ids[:1] + ids[90:115])
    assert [n for _, n in got[same[0]]] == same[1:5] and [n for _, n in got[same[9]]] == same[:4]


def test_few_rows_move_where_vectors_lie_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    r = np.random.default_rng(1)
    centres = np.linalg.qr(r.standard_normal((16, 16)))[0]
    n = 1600
    x = np.concatenate([centres[k % 16] + r.standard_normal((1, 16)) * 0.01 for k in range(n)])
    moved = []
    kept = neighbours.kept

    def watched(df, name):
        out = kept(df, name)
        if name == "near-visits":
            moved.append(out[0].count())
        return out

    monkeypatch.setattr(neighbours, "kept", watched)
    frame = vectors(spark, range(n), x)
    got = near(frame, 5)
    want = plain_neighbours(list(range(n)), x, 5)
    assert all(np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-8) for i in want)
    assert moved[0] < n * (n / 50) / 3


def test_neighbours_of_few_vectors_of_other_queries_and_lengths(spark):
    x = np.eye(4)
    got = near(vectors(spark, range(4), x), 2)
    assert [n for _, n in got[0]] == [1, 2] and [n for _, n in got[3]] == [0, 1]  # all as far: ties by id
    asks = spark.createDataFrame([(10, [1.0, 0.1, 0.0, 0.0]), (2, [0.0, 0.0, 5.0, 0.0]), (11, [1.0, 0.0])], "id long, x array<double>")
    base = vectors(spark, range(4), x).unionByName(spark.createDataFrame([(20, [2.0, 0.0]), (21, [0.0, 1.0])], "id long, x array<double>"))
    got = near(base, 1, queries=asks)
    assert got == {10: [(round(2 - 2 / 1.01**0.5, 9), 0)], 2: [(2.0, 0)], 11: [(0.0, 20)]}
    assert near(vectors(spark, [], np.zeros((0, 4))), 2) == {} and near(vectors(spark, [1], x[:1]), 2) == {}


def test_transitions_sum_to_one_and_stay_where_nothing_fits(spark):
    r = np.random.default_rng(2)
    x, v = r.standard_normal((40, 3)), r.standard_normal((40, 3))
    states = spark.createDataFrame([(k, x[k].tolist(), v[k].tolist()) for k in range(40)], "id long, x array<double>, v array<double>")
    edges = [(a, (a + s) % 40) for a in range(39) for s in (1, 2, 5)]
    got = neighbours.transitions(spark.createDataFrame(edges + [(3, 99)], "id long, neighbour long"), states).collect()
    cos = {(a, b): (x[b] - x[a]) @ v[a] / np.linalg.norm(x[b] - x[a]) / np.linalg.norm(v[a]) for a, b in edges}
    best = {a: max(c for (i, _), c in cos.items() if i == a) for a in range(39)}
    mark = np.quantile(list(best.values()), 0.98)
    weight = {k: np.exp(10 * c) for k, c in cos.items()} | {(a, a): np.exp(10 * np.clip(mark - b, 0, 1)) for a, b in best.items()} | {(39, 39): 1.0}
    total = {a: sum(w for (i, _), w in weight.items() if i == a) for a in range(40)}
    assert {(r["id"], r["neighbour"]): pytest.approx(r["p"]) for r in got} == {k: w / total[k[0]] for k, w in weight.items()}


def test_a_map_keeps_planted_clusters_and_places_new_rows(spark):
    r = np.random.default_rng(4)
    centres = np.linalg.qr(r.standard_normal((8, 8)))[0][:3]
    x = np.concatenate([centres[k % 3] + r.standard_normal((1, 8)) * 0.1 for k in range(96)])
    known, new = vectors(spark, range(90), x[:90]), vectors(spark, range(90, 96), x[90:])
    at = manifold.fit(known, "id", "x", k=8, epochs=8)
    got = {r_["id"]: (r_["x"], r_["y"]) for r_ in at.collect()}
    assert len(got) == 90 and np.isfinite(list(got.values())).all()
    p = np.array([got[k] for k in range(90)])
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = d.argsort(1)[:, :5]
    assert (near % 3 == np.arange(90)[:, None] % 3).mean() > 0.95
    again = {r_["id"]: (r_["x"], r_["y"]) for r_ in manifold.fit(known.repartition(5), "id", "x", k=8, epochs=8).collect()}
    assert all(np.allclose(got[k], again[k], atol=1e-4) for k in got)
    for r_ in manifold.place(new, known, at, "id", "x", k=8).collect():
        assert ((p - [r_["x"], r_["y"]]) ** 2).sum(1).argmin() % 3 == r_["id"] % 3


def test_fuzzy_weights_of_a_row_add_up(spark):
    rows = [(0, k + 1, float((k + 1) ** 2), k + 1) for k in range(8)] + [(1, k + 20, 0.0, k + 1) for k in range(8)]
    got = manifold.fuzzy(spark.createDataFrame(rows, "id long, neighbour long, distance double, rank long"), 8).collect()
    w = [r["w"] for r in got if r["id"] == 0]
    assert w[0] == 1 and np.isclose(sum(w), 3, atol=1e-6) and w == sorted(w, reverse=True) and {r["w"] for r in got if r["id"] == 1} == {1.0}
    both = {(r["id"], r["neighbour"]): r["w"] for r in manifold.union(spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.2)], "id long, neighbour long, w double")).collect()}
    assert both == {(1, 2): 0.75, (2, 1): 0.75, (2, 3): pytest.approx(0.2), (3, 2): pytest.approx(0.2)}


# --- decomposition -----------------------------------------------------------------------------


@pytest.mark.parametrize("entries", [50, 1_000_000])
def test_sparse_decomposition_equals_numpy(spark, monkeypatch, entries):
    monkeypatch.setattr(decompose, "ENTRIES", entries)
    monkeypatch.setattr(decompose, "GENES", 7 if entries == 50 else 65_536)
    r = np.random.default_rng(0)
    a = (r.standard_normal((60, 5)) * [9, 7, 5, 3, 2]) @ r.standard_normal((5, 30)) * (r.random((60, 30)) < 0.5)
    a[[3, 10]] = 0
    rows = [(int(i) * 10, int(j) + 100, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    m = spark.createDataFrame(rows + [(30, 101, 0.0)], "cell long, gene int, value double").repartition(3)
    loadings, table = decompose.svd(m, 4, cells=60, power=12)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    got = {r["pc"]: (r["singular"], r["share"]) for r in table.collect()}
    assert np.allclose([got[k][0] for k in range(4)], s[:4], rtol=1e-6)
    scores = u * s
    assert np.allclose([got[k][1] for k in range(4)], scores.var(0)[:4] / a.var(0).sum(), rtol=1e-4)
    w = np.zeros((30, 4))
    for r_ in loadings.collect():
        w[r_["gene"] - 100, r_["pc"]] = r_["weight"]
    assert np.allclose(np.abs((w * vt.T[:, :4]).sum(0)), 1, atol=1e-5) and (w[np.abs(w).argmax(0), range(4)] > 0).all()
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-8)


def test_decomposition_of_low_rank_and_of_nothing(spark):
    m = spark.createDataFrame([(c, g, float((c + 1) * (g + 1))) for c in range(5) for g in range(3)], "cell long, gene long, value double")
    loadings, table = decompose.svd(m, 3, cells=5)
    assert [r["pc"] for r in table.collect()] == [0] and loadings.count() == 3
    none, nothing = decompose.svd(m.where("cell < 0"), 3, cells=5)
    assert none.count() == nothing.count() == 0


def test_signs_are_the_same_in_spark_and_numpy(spark):
    genes = np.array([0, 5, -3, 123456789012])
    got = spark.createDataFrame([(int(g),) for g in genes], "gene long").select(decompose.signs(F.col("gene"), 4, 128).alias("s")).collect()
    assert (np.array([r["s"] for r in got]) == decompose._signs(genes, 4, 128)).all()
    assert abs(decompose._signs(np.arange(2000), 1, 128).mean()) < 0.01


# --- quantiles and draws -----------------------------------------------------------------------


@pytest.mark.parametrize("few", [3, 50, 4096])
def test_quantiles_equal_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    r = np.random.default_rng(0)
    groups = {"a": r.standard_normal(3000), "b": np.exp(20 * r.standard_normal(1001)), "c": np.repeat([1.0, 2.0], 400), "d": np.array([5.0]), "e": np.array([1.0, 4.0]), "f": np.full(500, -7.0), None: r.integers(0, 9, 301).astype(float), "g": np.concatenate([np.zeros(900), r.random(77)])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("only nulls", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for share in (0.5, 0.98, 0.0, 1.0):
        got = {r_["g"]: (r_["n"], r_["value"]) for r_ in quantiles.quantile(frame, "g", "v", share).collect()}
        assert got.keys() == groups.keys()
        for g, x in groups.items():
            assert got[g][0] == len(x) and np.isclose(got[g][1], np.quantile(x, share), rtol=1e-12), (g, share)
    whole = quantiles.quantile(frame, None, "v").first()
    assert np.isclose(whole["value"], np.median(np.concatenate(list(groups.values()))))
    assert quantiles.quantile(frame.where("g = 'none'"), None, "v").collect() == []


def test_no_task_holds_a_group_of_medians(spark):
    rows = spark.range(20000).selectExpr("'hot' AS g", "cast(id % 7919 AS double) AS v", "cast(-id AS double) AS w")
    got = profile.centroids(rows, "g", "v", "w").first()
    x = np.arange(20000)
    assert (got["n"], got["x"], got["y"]) == (20000, np.median(x % 7919), -np.median(x))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 17, 50, 225, 226, 1000])
def test_the_bijection_reaches_each_place_once(spark, n):
    x = spark.range(n).select(*[sampling.permuted(F.col("id"), F.lit(n), F.lit(k)).alias(k) for k in ("k1", "k2")]).collect()
    assert sorted(r["k1"] for r in x) == sorted(r["k2"] for r in x) == list(range(n))
    assert n < 17 or [r["k1"] for r in x] != [r["k2"] for r in x]


def test_batches_are_independent_draws(spark):
    rows = spark.range(2000).selectExpr("'g' AS g", "id")
    got = sampling.batches(rows, "g", "id", 200, 6, 3).collect()
    sets = [{r["id"] for r in got if r["batch"] == b} for b in range(6)]
    assert all(len(s) == 200 for s in sets)
    shared = [len(a & b) for k, a in enumerate(sets) for b in sets[:k]]
    assert max(shared) < 45 and 12 < np.mean(shared) < 28  # 20 by chance
    small = sampling.batches(rows.where("id < 5"), "g", "id", 8, 2, 3).collect()
    assert len(small) == 16 and {r["id"] for r in small} <= set(range(5))


def test_numbers_do_not_depend_on_how_files_are_cut(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS g", "id")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "300")
    try:
        got = profile.numbered(rows, "g", ["id"], "n").collect()
        every = profile.ordinals(rows, "g", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert all(r["n"] == r["id"] // 3 for r in got)
    assert sorted(r["ordinal"] for r in every) == list(range(5000))


# --- files -------------------------------------------------------------------------------------


def test_sequences_over_many_splits(spark, tmp_path):
    r = np.random.default_rng(0)
    seqs = {f"chr{k}": "".join(r.choice(list("acgtN"), n)) for k, n in enumerate((1, 59, 60, 61, 2000, 0, 333))}
    text = "lost\n" + "".join(f">{k} about\n" + "".join(f"{s[a : a + 60]}\n" for a in range(0, len(s), 60)) for k, s in seqs.items())
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">other\r\nAC GT\r\n\r\nTT\r\n")
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(">packed\nAAAA\nCC")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = readers.fasta(spark, f"{tmp_path}/*", 50).orderBy("chrom", "start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for x in got:
        assert x["start"] == len(found.get(x["chrom"], "")) and len(x["seq"]) <= 50
        found[x["chrom"]] = found.get(x["chrom"], "") + x["seq"]
    assert found == {k: s.upper() for k, s in seqs.items() if s} | {"other": "ACGTTT", "packed": "AAAACC"}


def test_array_files_by_row_ranges(spark, tmp_path):
    r = np.random.default_rng(0)
    a, b = r.standard_normal((1000, 4)).astype(np.float32), r.integers(0, 99, (7, 2, 3))
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", x=b, y=np.arange(5.0))
    np.savez_compressed(tmp_path / "c.npz", z=a[:50])
    got = arrays.read(spark, str(tmp_path), rows=64)
    assert got.rdd.getNumPartitions() == 16 + 1 + 1 + 1
    found = {}
    for x in got.orderBy("row").collect():
        found.setdefault((x["source_file"].rsplit("/", 1)[1], x["name"]), []).append(x["values"])
    assert np.array_equal(found["a.npy", ""], a.astype(float)) and np.array_equal(found["b.npz", "x"], b.reshape(7, 6)) and np.array_equal(found["b.npz", "y"], np.arange(5.0)[:, None]) and np.allclose(found["c.npz", "z"], a[:50])
    np.save(tmp_path / "bad.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="pickled"):
        arrays.read(spark, str(tmp_path / "bad.npy")).collect()


def test_arrays_are_written_in_row_ranges(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS k", "array(cast(id AS double), cast(id * 2 AS double)) AS v").repartition(7)
    arrays.write(rows, str(tmp_path / "out"), "k", "v", parts=4)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    listed = json.loads((tmp_path / "out" / "rows.json").read_text())
    assert names == [x["file"] for x in listed] + ["rows.json"] and sum(x["rows"] for x in listed) == 500
    whole = np.concatenate([np.load(tmp_path / "out" / x["file"], mmap_mode="r") for x in listed])
    assert whole.dtype == np.float32 and np.array_equal(whole, np.stack([np.arange(500), 2 * np.arange(500)], 1))
    back = {r["row"]: r["values"] for r in arrays.ranges(spark, str(tmp_path / "out")).collect()}
    assert back == {k: [float(k), 2.0 * k] for k in range(500)}
    with pytest.raises(Exception, match="missing|gaps"):
        arrays.write(rows.where("k <> 250"), str(tmp_path / "gap"), "k", "v", parts=4)


BOOK = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/><sheet name="Other" sheetId="3" r:id="rId3"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/><Relationship Id="rId3" Target="worksheets/c.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Chrom</t></si><si><r><t>chr</t></r><r><t>1</t></r><rPh sb="0" eb="1"><t>said</t></rPh></si></sst>',
    "xl/worksheets/a.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>START</t></is></c><c r="D1" t="str"><v>Region_End</v></c></row>'
    '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>10</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><f>B3*2</f><v>20</v></c></row><row r="4"><c r="AA4"><v>7</v></c></row></sheetData></worksheet>',
    "xl/worksheets/b.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>end</t></is></c><c t="inlineStr"><is><t>start</t></is></c><c t="inlineStr"><is><t>chromosome</t></is></c></row><row><c><v>5</v></c><c><v>1</v></c><c t="inlineStr"><is><t> chr2 </t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/c.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
}


def test_workbooks_are_read_without_a_package(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        for name, text in BOOK.items():
            z.writestr(name, text)
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    with zipfile.ZipFile(tmp_path / "broken.xlsx", "w") as z:
        for name, text in BOOK.items():
            z.writestr(name, text[:-20] if name.endswith("b.xml") else text)
    got = {(r["sheet"], r["row"]): r["cells"] for r in readers.workbook(spark, str(tmp_path)).collect()}
    assert got == {("One", 0): ["Chrom", "START", None, "Region_End"], ("One", 2): ["chr1", "10", "TRUE", "20"], ("One", 3): [None] * 26 + ["7"], ("Two", 0): ["end", "start", "chromosome"], ("Two", 1): ["5", "1", " chr2 "], ("Other", 0): ["1"]}
    x = readers.interval_sheets(spark, str(tmp_path), {"chrom": ["chromosome"], "start": [], "end": ["region end"]}).orderBy("sheet", "row").collect()
    assert [(r["sheet"], r["chrom"], r["start"], r["end"]) for r in x] == [("One", "chr1", "10", "20"), ("One", None, None, None), ("Two", "chr2", "1", "5")]


def test_variants_are_predicted_once_for_a_signature(spark, tmp_path, monkeypatch):
    own = panel()
    _, _, rows = pairs(spark, 4, 5, 7)
    models, genes = {"film": field(), "cross": field("cross_attention")}, token_rows(spark, own)
    first = training.variants(models, rows, genes, "k", f"file://{tmp_path}/kept", 1, chunk=3)
    assert {r["variant"]: r["n"] for r in first.groupBy("variant").agg(F.count("*").alias("n")).collect()} == {"film": 28, "cross": 28}
    again = training.variants(models, rows.where("k < 2"), genes, "k", f"file://{tmp_path}/kept", 1, chunk=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    assert training.variants(models, rows.where("k < 2"), genes, "k", f"file://{tmp_path}/kept", 2, chunk=3).count() == 28


def test_matrix_headers_are_heeded(spark, tmp_path):
    def read(head, lines, **more):
        (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate {head}\n% about\n3 3 {len(lines)}\n" + "\n".join(lines))
        return sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "m.mtx"), **more).collect()))

    assert read("pattern general", ["1 2", "3 3"]) == [(0, 1, 1.0), (2, 2, 1.0)]
    assert read("real symmetric", ["2 1 5", "3 3 1"]) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 1.0)]
    assert read("integer skew-symmetric", ["2 1 5"]) == [(0, 1, -5.0), (1, 0, 5.0)]
    assert read("real general", ["3 3 1", "3 3 2"]) == [(2, 2, 1.0), (2, 2, 2.0)]
    with pytest.raises(ValueError, match="complex"):
        read("complex general", ["1 1 2 3"])


def test_minibatches_of_all_sizes_are_coupled_together(spark, monkeypatch):
    monkeypatch.setattr(transport, "TOGETHER", 40)
    r = np.random.default_rng(0)
    costs = {b: r.random((n, m)) for b, (n, m) in enumerate([(3, 3), (1, 4), (5, 2), (1, 1), (4, 4)])}
    rows = [(b, 10 * i, 7 * j, float(c[i, j])) for b, c in costs.items() for i in range(c.shape[0]) for j in range(c.shape[1])]
    got = transport.couple(spark.createDataFrame(rows, "batch long, i long, j long, cost double"), epsilon=0.1, iterations=500).collect()
    assert len(got) == len(rows)
    for b, c in costs.items():
        p = np.zeros(c.shape)
        for x in got:
            if x["batch"] == b:
                p[x["i"] // 10, x["j"] // 7] = x["p"]
        assert np.allclose(p.sum(0), 1 / c.shape[1], atol=1e-9) and np.allclose(p.sum(1), 1 / c.shape[0], atol=1e-6)
        one, f, g = transport.sinkhorn(c[None], 0.1, 500)
        assert np.allclose(p, one[0]) and np.allclose(np.exp(f[0][:, None] + g[0][None] - c / 0.1), p)
    assert transport.sinkhorn(np.zeros((0, 2, 2)))[0].shape == (0, 2, 2) and not transport.sinkhorn(np.full((1, 2, 2), np.inf))[0].any()
