"""Small cases with results worked out by hand, and properties."""

import gzip
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import exprs as X
from helixframe.operators import evaluate, fields, intervals, matrix, profile, sampling, timeaxis, tokens, transport
from helixframe.sources import readers, writers
from helixframe.streaming import passes

GTF = 'chr1\tsrc\tgene\t11\t20\t.\t+\t.\tgene_id "g1.3"; gene_name "A"; gene_type "protein_coding";\nchr1\tsrc\tgene\t31\t40\t.\t-\t.\tgene_id "g2"; gene_name "B"; gene_type "protein_coding";\nchr1\tsrc\texon\t1\t2\t.\t-\t.\tgene_id "g3";\n'


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("v")).first()["v"]


def test_gtf_strands(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("#!comment\n" + GTF)
    got = {r["gene_id"]: r["tss0"] for r in readers.gtf(spark, str(tmp_path / "a.gtf")).collect()}
    assert got == {"g1": 10, "g2": 39}


def _link(spark, spans):
    points = spark.createDataFrame([("g1", "chr1", 1000)], "point string, chrom string, pos long")
    spans = spark.createDataFrame(spans, "span string, chrom string, start long, end long").withColumn("midpoint", X.midpoint("start", "end"))
    return intervals.link(points, spans, key="chrom", point_id="point", interval_id="span", window=5000, near=1000).orderBy("token_rank").collect()


def test_nearest_is_promoter(spark):
    got = _link(spark, [("far", "chr1", 2500, 2600), ("near", "chr1", 900, 950)])
    assert [(r["ref_id"], r["is_promoter"], r["token_rank"]) for r in got] == [("near", True, 0), ("far", False, 1)]


def test_synthetic_promoter_if_none_is_near(spark):
    got = _link(spark, [("far", "chr1", 2500, 2600)])
    assert [(r["ref_id"], r["is_synthetic"], r["token_rank"]) for r in got] == [("synthetic_promoter:g1", True, 0), ("far", False, 1)]
    assert [r["ref_id"] for r in _link(spark, [("other", "chr2", 900, 950)])] == ["synthetic_promoter:g1"]


def test_pack_pads_by_rank_and_refuses_unknown(spark):
    links = spark.createDataFrame([("g1", "c2", 1, 80, False, False), ("g1", "c1", 0, 0, True, False), ("g2", "c3", 0, 0, True, False)], "g string, ref string, token_rank long, signed_distance long, is_promoter boolean, is_synthetic boolean")
    vectors = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [3.0, 4.0]), ("c3", [5.0, 6.0])], "ref string, vector array<double>")
    got = {r["g"]: [(t["rank"], t["distance"], t["vector"]) for t in r["tokens"]] for r in intervals.pack(links, vectors, group="g", ref="ref", k=2).collect()}
    assert got == {"g1": [(0, 0.0, [1.0, 2.0]), (1, 80.0, [3.0, 4.0])], "g2": [(0, 0.0, [5.0, 6.0])]}
    with pytest.raises(Exception, match="no vector for c3"):
        intervals.pack(links, vectors.where("ref <> 'c3'"), group="g", ref="ref", k=2).collect()
    with pytest.raises(KeyError):
        intervals.require(links.select("ref"), vectors.where("ref <> 'c3'"), "ref")


def test_held_out_neighbours_are_not_joined(spark):
    days = spark.createDataFrame([(d,) for d in ("E9.5", "E8.5", "E10.0", "E9.0")], "d string")
    got = timeaxis.intervals(timeaxis.axis(days, "d"), ["E9.5"])
    assert [tuple(r) for r in got.where("not touches_heldout").select("day0", "day1").collect()] == [("E8.5", "E9.0")]
    assert got.where("touches_heldout").count() == 2


def test_time_coordinates(spark):
    days = spark.createDataFrame([("18.0",), ("36.0",), ("72",)], "d string")
    assert [r["t"] for r in timeaxis.axis(days, "d", scale=1 / 24).orderBy("nth").collect()] == [0.75, 1.5, 3.0]
    assert [r["t"] for r in timeaxis.axis(days, "d", coordinate="relative").orderBy("nth").collect()] == pytest.approx([0, 1 / 3, 1])
    assert one(spark, X.day_label("d"), d="36.0") == "36" and one(spark, X.day_label("d"), d="E9.0") == "E9.0"
    assert one(spark, X.day_value("d"), d="P2") == 21.0 and one(spark, X.day_value("d"), d="none") is None


def test_coupling_keeps_marginals():
    r = np.random.default_rng(0)
    a, b = r.standard_normal((5, 3)), r.standard_normal((7, 3))
    a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    p = transport.sinkhorn(((a[:, None] - b[None]) ** 2).sum(-1)[None], 0.2, 200)[0][0]
    assert p.sum(1) == pytest.approx(np.full(5, 1 / 5), abs=2e-3) and p.sum(0) == pytest.approx(np.full(7, 1 / 7), abs=1e-9)


def test_batch_coupling_and_states(spark):
    x0 = spark.createDataFrame([(0, 0, [0.0, 1.0])], "batch long, i long, x array<double>")
    x1 = spark.createDataFrame([(0, 0, [2.0, 3.0])], "batch long, j long, x array<double>")
    s0 = spark.createDataFrame([(0, 0, [10.0, 20.0, 30.0])], "batch long, i long, x array<double>")
    s1 = spark.createDataFrame([(0, 0, [30.0, 40.0, 50.0])], "batch long, j long, x array<double>")
    coupling = transport.couple(transport.costs(x0, x1))
    got = transport.interpolate(transport.draw_pairs(coupling, 4, 1), x0, x1, 8.5, 9.0, 1, states=(s0, s1)).collect()
    assert len(got) == 4
    for r in got:
        assert 0 <= r["tau"] < 1 and r["target"] == [4.0, 4.0]
        assert r["xt"] == pytest.approx([2 * r["tau"], 1 + 2 * r["tau"]]) and r["state_t"] == pytest.approx([v + 20 * r["tau"] for v in (10, 20, 30)])
    with pytest.raises(ValueError):
        transport.interpolate(coupling, x0, x1, 9.0, 9.0, 1)


def test_zero_field_scores(spark):
    rows = spark.createDataFrame([(b, [0.0] * 3, [2.0] * 3) for b in (0, 1)], "batch long, p array<double>, t array<double>")
    sets = spark.createDataFrame([("legacy", 0), ("legacy", 2)], "eval_gene_set string, g int")
    got = evaluate.scores(evaluate.errors(rows, "p", "t"), F.lit(0.5), sets).orderBy("batch", "eval_gene_set").collect()
    assert [(r["batch"], r["eval_gene_set"], r["n_eval_genes"]) for r in got] == [(0, "full", 3), (0, "legacy", 2), (1, "full", 3), (1, "legacy", 2)]
    assert all(r["loss"] == 4.0 and r["velocity_mae"] == 2.0 and r["displacement_mae"] == 1.0 for r in got)


def tokens_of(r, genes):
    return r.standard_normal((genes, 3, 8)), np.array([[0.0, 1000.0, -2000.0]] * genes), np.eye(3)[[0] * genes], np.ones((genes, 3))


@pytest.mark.parametrize("kind", ["film", "cross_attention"])
@pytest.mark.parametrize("position", ["none", "learned", "rope"])
def test_conditioned_chunks_equal_whole(kind, position):
    r = np.random.default_rng(1)
    m = fields.Conditioned(8, 8, width=16, layers=3, kind=kind, position=position, slots=2)
    state, args = r.standard_normal((2, 8)), tokens_of(r, 7)
    out = m(state, *args)
    assert out.shape == (2, 7) and m(state, *args, chunk=3) == pytest.approx(out, abs=1e-9)
    assert len([n for n in m.weights if n.endswith(".context")]) == 3
    again = fields.Conditioned(8, 8, width=16, layers=3, kind=kind, position=position, slots=2, weights=m.weights)
    assert np.array_equal(again(state, *args), out) and m(state, *(a[:0] for a in args)).shape == (2, 0)
    with pytest.raises(ValueError):
        fields.Conditioned(9, 8, width=16, layers=3, kind=kind, position=position, slots=2, weights=m.weights)


@pytest.mark.parametrize("kind", ["film", "cross_attention"])
def test_conditioned_layers_see_the_cell_and_not_the_padding(kind):
    r = np.random.default_rng(2)
    m = fields.Conditioned(5, 8, width=16, layers=2, kind=kind, slots=2)
    state, (vectors, distance, promoter, mask) = r.standard_normal((2, 5)), tokens_of(r, 4)
    mask[:, 2] = 0
    out = m(state, vectors, distance, promoter, mask)
    assert not np.allclose(out[0], out[1])  # another cell, the same tokens
    other = vectors.copy()
    other[:, 2] += 9
    assert m(state, other, distance, promoter, mask) == pytest.approx(out)
    other[:, 1] += 9
    assert not np.allclose(m(state, other, distance, promoter, mask), out)
    assert np.isfinite(m(state, vectors, distance, promoter, mask * 0)).all()


def test_rope_of_the_field_is_the_expression(spark):
    m = fields.Conditioned(2, 3, width=5, heads=1, layers=1, position="rope")
    plain = fields.Conditioned(2, 3, width=5, heads=1, layers=1, position="none", weights=m.weights)
    args = (np.ones((1, 1, 3)), np.array([[1234.0]]), np.ones((1, 1)), np.ones((1, 1)))
    x = [float(v) for v in plain.embed(*args)[0, 0]]
    assert one(spark, X.rope(F.col("x"), F.lit(1234.0)), x=x) == pytest.approx(list(m.embed(*args)[0, 0]))


def test_ridge_over_tasks_equals_one_solution(spark):
    r = np.random.default_rng(3)
    x, y = r.standard_normal((300, 4)), r.standard_normal((300, 2))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)] + [(None, [1.0, 2.0]), ([1.0, None, 1.0, 1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    got, want = fields.ridge(rows.repartition(7), "x", "y", 0.1), fields.Linear.ridge(x, y, 0.1)
    assert got.weight == pytest.approx(want.weight) and got.bias == pytest.approx(want.bias)
    first = fields.ridge(rows.withColumn("y", F.slice("y", 1, 1)), "x", "y", 0.1)
    assert first.weight == pytest.approx(want.weight[:, :1])  # targets by chunks give what all at once give
    with pytest.raises(ValueError):
        fields.ridge(rows.limit(0), "x", "y")


def test_gelu():
    import math

    x = np.linspace(-6, 6, 101)
    assert fields.gelu(x) == pytest.approx([v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in x], abs=1e-6)


def test_evaluation_batches_are_drawn_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(0, [1.0]), (1, [2.0])], "batch int, x array<double>")

    for _ in range(2):
        assert evaluate.batches(spark, make, str(tmp_path / "b"), 2).count() == 2
    assert len(made) == 1
    with pytest.raises(ValueError):
        evaluate.batches(spark, make, str(tmp_path / "b"), 3)


def test_regions_are_embedded_once_and_resume(spark, tmp_path):
    seq = spark.createDataFrame([("chr1", 0, "ACGTACGTAC"), ("chr2", 0, "TTTTTTTTTT")], "chrom string, start long, seq string")
    regions = spark.createDataFrame([("a", "chr1", 4), ("a", "chr1", 4), ("b", "chr2", 5), ("c", "chr9", 5), (None, "chr1", 1)], "region_id string, chrom string, midpoint long")
    count = lambda xs: np.array([[[float(x.count("T"))], [float(x.count("A"))]] for x in xs])

    def fails(_):
        raise RuntimeError("the encoder must not run again")

    for encoder in (count, fails):
        got = tokens.embed_regions(regions, seq, 4, encoder, 1, str(tmp_path / "e"), signature="v1", parts=2, pool=2)
        assert sorted((r["region_id"], r["vector"]) for r in got.collect()) == [("a", [1.0]), ("b", [2.0])]


def test_fields_apply_and_fit(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>")
    assert [r["v"] for r in df.select(fields.apply(fields.Zero(3), F.col("x")).alias("v")).collect()] == [[0.0] * 3, None]
    x = np.random.default_rng(0).standard_normal((200, 3))
    w = np.array([[1.0, 0], [0, 2], [3, 0]])
    assert fields.Linear.ridge(x, x @ w + 1, 1e-9).weight == pytest.approx(w, abs=1e-6)


def test_sentence_delimiters(spark):
    row = spark.createDataFrame([(1, g, v) for g, v in enumerate([1.0, 8.0, 2.0, 4.0])], "cell long, gene long, value double")
    meta = spark.createDataFrame([(0, 10, 1, 30, True), (1, 11, 0, 20, True), (2, 12, 1, 10, True), (3, -1, -1, -1, False)], "gene long, token_id long, chrom_id long, start long, valid boolean")
    s = tokens.sentences(row, meta, 12, 2).first()["sentence"]
    assert s[0] == tokens.CLS and s.count(tokens.CLOSE) == 2 and len(s) == 1 + 12 + 4
    assert {tokens.CHROM_OFFSET, tokens.CHROM_OFFSET + 1, 10, 11, 12} <= set(s)
    assert s.index(12) < s.index(10)  # by start


def test_variance_counts_zeros(spark):
    m = spark.createDataFrame([(0, 7, 2.0), (1, 7, 4.0)], "cell long, gene long, value double")
    assert matrix.variance(m, 4).first()["variance"] == pytest.approx(np.var([2, 4, 0, 0]))
    assert matrix.looks_like_counts(m).first()["whole"] and not matrix.looks_like_counts(m).first()["count_like"]


def test_decomposition_is_uncentred(spark):
    x = np.random.default_rng(2).standard_normal((50, 6)) + 1
    v, s, share = matrix.svd(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), "x", 3)
    assert s == pytest.approx(np.linalg.svd(x)[1][:3], rel=1e-6) and v.shape == (6, 3)
    assert share == pytest.approx((x @ v).var(0) / x.var(0).sum(), rel=1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-60, 60)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(-60, 60)), max_size=12), st.integers(0, 30))
def test_range_join_equals_all_pairs(spark, a, b, window):
    p = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(a)], "p long, k long, pos long")
    q = spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(b)], "q long, k long, midpoint long")
    got = sorted((r["p"], r["q"]) for r in intervals.range_join(p, q, "k", window).collect())
    assert got == sorted((i, j) for i, (k, v) in enumerate(a) for j, (l, w) in enumerate(b) if k == l and abs(v - w) <= window)


def test_numbers_without_a_window_over_a_group(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 3000).alias("o")).repartition(9)
    held: dict = {}
    for r in hot.collect():
        held.setdefault(r["g"], []).append(r["o"])
    want = {(g, o): i for g, x in held.items() for i, o in enumerate(sorted(x))}
    assert {(r["g"], r["o"]): r["i"] for r in profile.numbered(hot, "g", ["o"], "i").collect()} == want and len(held["hot"]) == 2100 and None in held
    every = sorted((r["g"], r["o"], r["ordinal"]) for r in profile.ordinals(hot, "g", "o").collect())
    assert [x[2] for x in every] == list(range(len(every))) and len(every) == 2400
    assert profile.numbered(hot.limit(0), "g", ["o"], "i").count() == profile.ordinals(hot.limit(0), "g", "o").count() == 0


def test_draws(spark):
    rows = spark.range(10).select(F.lit("a").alias("g"), "id").unionByName(spark.range(2).select(F.lit("b").alias("g"), "id"))
    got = sampling.batches(rows, "g", "id", 4, 3, 0).collect()
    for b in range(3):
        ids = [r["id"] for r in got if r["batch"] == b and r["g"] == "a"]
        assert len(ids) == 4 == len(set(ids)) and sum(r["batch"] == b and r["g"] == "b" for r in got) == 4
    assert sampling.bottom_k(rows, "id", 5, 1).count() == 5
    per = sampling.bottom_k_per(rows, "g", "id", 3, 1)
    assert "WindowGroupLimit" in per._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["g"], r["draw"]) for r in per.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert sampling.choose(6, spark.range(3).withColumnRenamed("id", "o"), ["o"], 1).count() == 6
    w = spark.createDataFrame([("x", "rare", 1.0), ("x", "often", 99.0)], "g string, item string, w double")
    picks = [r["item"] for r in sampling.weighted(w, "g", "item", "w", 400, 3).collect()]
    assert len(picks) == 400 and 0 <= picks.count("rare") < 20


def test_profiles(spark):
    x = spark.createDataFrame([("a", 1), ("", 2), (None, 2)], "s string, n int")
    got = {r["column_name"]: r for r in profile.profile(x, "t").collect()}
    assert got["s"]["null_fraction"] == pytest.approx(1 / 3) and got["n"]["n_unique"] == 2 and got["n"]["dtype"] == "int" and got["n"]["examples"] == "1, 2"
    assert {r["s"]: r["n"] for r in profile.label_counts(x, [["s"]]).collect()} == {"a": 1, "NA": 2}


def test_interval_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("1\t10\t20\nchr2\t5\t9\tid1\nchrX\t9\t3\tbad\nchr3\t1\t4\tid2\tel\topen\n")
    got = {r["chrom"]: r for r in readers.bed(spark, str(tmp_path / "a.bed")).collect()}
    assert set(got) == {"chr1", "chr2", "chr3"} and got["chr1"]["ccre_id"] == "chr1:10-20" and got["chr2"]["state"] == "unknown" and got["chr3"]["element_id"] == "el"
    writers.bed(readers.bed(spark, str(tmp_path / "a.bed")), str(tmp_path / "out"))
    assert sorted(r["state"] for r in readers.bed(spark, str(tmp_path / "out")).collect()) == ["open", "unknown", "unknown"]
    both = readers.merged_intervals([spark.createDataFrame([("1", "1", "5", "a", "s"), ("1", "x", "5", "b", "s")], "chrom string, start string, end string, ccre_id string, state string")] * 2)
    assert [tuple(r) for r in both.collect()] == [("chr1", 1, 5, "a", "s")]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nacgt\nACGT\n>chr2\nTTTT\n")
    seq = readers.fasta(spark, str(tmp_path / "a.fa"), width=3)
    regions = spark.createDataFrame([(1, "chr1", 4), (2, "chr1", 0), (3, "chr2", 2)], "region_id long, chrom string, midpoint long")
    got = {r["region_id"]: r["seq"] for r in readers.fetch(seq, regions, 6, width=3).collect()}
    assert got == {1: "CGTACG", 2: "NACGNN", 3: "NTTTTN"}
    assert one(spark, X.pad_or_trim("s", 4), s="abcdefg") == "BCDE" and one(spark, X.pad_or_trim("s", 4), s="a") == "NANN"
    assert one(spark, X.one_hot("s"), s="Ax") == [[1.0, 0, 0, 0], [0.0] * 4]


def test_sparse_matrix_file(spark, tmp_path):
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n%\n3 2 2\n1 2 5.5\n3 1 1\n")
    path = str(tmp_path / "m.mtx.gz")
    assert sorted(map(tuple, readers.matrix_market(spark, path, 3).collect())) == [(0, 1, 5.5), (2, 0, 1.0)]
    assert sorted(map(tuple, readers.matrix_market(spark, path, 2).collect())) == [(0, 2, 1.0), (1, 0, 5.5)]
    with pytest.raises(ValueError):
        readers.matrix_market(spark, path, 7)
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 3\n1  1 4\n3 3 3\n2 2 5\n")
    assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "s.mtx")).collect())) == [(0, 0, 4.0), (1, 1, 5.0), (2, 2, 3.0)]


def test_tables_settings_and_ranges(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gene ID,Symbol\nx,y\n")
    got = readers.aliased(readers.table(spark, str(tmp_path / "a.csv")), {"gene_id": ["id"], "gene_short_name": ["symbol"], "kind": []}, {"kind": "k"}).first()
    assert tuple(got) == ("x", "y", "k")
    with pytest.raises(KeyError):
        readers.aliased(readers.table(spark, str(tmp_path / "a.csv")), {"absent": []})
    (tmp_path / "c.json").write_text(json.dumps({"window": 5, "held_out": ["a"]}))
    c = readers.Config.load(str(tmp_path / "c.json"), {"seed": 3})
    assert (c.window, c.held_out, c.seed) == (5, ("a",), 3) and readers.Config.from_env({"HELIXFRAME_WINDOW": "9"}).window == 9
    with pytest.raises(KeyError):
        readers.Config.of({"no": 1})
    (tmp_path / "m.txt").write_text("1,2\n3,4\n5,6\n")
    rows = readers.row_chunks(spark, str(tmp_path / "m*.txt"), 2)
    assert sorted((r["row"], r["chunk"], r["values"]) for r in rows.collect()) == [(0, 0, [1, 2]), (1, 0, [3, 4]), (2, 1, [5, 6])]
    (tmp_path / "m2.txt").write_text("7,8\n")
    got = readers.row_chunks(spark, str(tmp_path / "m*.txt"), 2, [1]).collect()
    assert sorted((r["global_row"], r["values"]) for r in got) == [(0, [2]), (1, [4]), (2, [6]), (3, [8])]
    with pytest.raises(FileNotFoundError):
        readers.inventory(spark, str(tmp_path / "*.csv"), ["a.csv", "b.csv"])
    assert readers.inventory(spark, str(tmp_path / "*.csv")).first()["bytes"] == 19


def test_writers(spark, tmp_path):
    calls = []
    df = spark.range(10)
    a = writers.materialise(df, str(tmp_path / "m"), {"v": 1})
    before = a.inputFiles()
    assert writers.materialise(df.where("id < 3"), str(tmp_path / "m"), {"v": 1}).inputFiles() == before and not calls
    assert writers.materialise(df.where("id < 3"), str(tmp_path / "m"), {"v": 2}).count() == 3
    writers.shards(df, str(tmp_path / "s"), "id", 4)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()} == {0: 4, 1: 4, 2: 2}
    writers.csv(df, str(tmp_path / "c"), gzip=True)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.csv(df, str(tmp_path / "c"))


def test_streaming_equals_batch(spark, tmp_path):
    schema = "cell long, gene long, value double"
    m = spark.createDataFrame([(c, g, float((c * 3 + g) % 5)) for c in range(20) for g in range(4)], schema)
    src, state, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    m.where("cell < 10").write.parquet(src)
    passes.accumulate(spark, src, schema, state, mark)
    m.where("cell >= 10").write.mode("append").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        passes.accumulate(spark, src, schema, state, mark)
    got = {r["gene"]: round(r["variance"], 9) for r in passes.variances(spark, state, 20).collect()}
    assert got == {r["gene"]: round(r["variance"], 9) for r in matrix.variance(m, 20).collect()}
    assert passes.resume(m, m.where("cell < 15"), "cell").select("cell").distinct().count() == 5


def test_array_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[1, 2], [3, 4]], np.float16))
    np.savez(tmp_path / "b.npz", x=np.array([5.0, 6.0]))
    got = sorted((r["name"], r["row"], r["values"]) for r in readers.arrays(spark, str(tmp_path / "*.np*")).collect())
    assert got == [("", 0, [1, 2]), ("", 1, [3, 4]), ("x", 0, [5]), ("x", 1, [6])]


def test_first_gene_row_of_the_file_counts(spark, tmp_path):
    line = 'chr{}\tsrc\tgene\t{}\t{}\t.\t+\t.\tgene_id "g1"; gene_type "protein_coding";\n'
    (tmp_path / "a.gtf").write_text(line.format(9, 50, 60) + line.format(1, 5, 6))
    assert [tuple(r) for r in readers.gtf(spark, str(tmp_path / "a.gtf")).collect()] == [("g1", "g1", "protein_coding", "chr9", "+", 49)]


def test_histogram_of_equal_values(spark):
    x = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in profile.histogram(x, "v", 5).collect()] == [(0, 2)]


def test_panels_orders_and_states(spark):
    v = spark.createDataFrame([(g, float(10 - g)) for g in range(6)], "gene long, variance double")
    names = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (4, "c"), (5, "d")], "gene long, gene_id string")
    assert [(r["gene_id"], r["gene"]) for r in matrix.select_panel(v, names, 3).orderBy(F.desc("variance")).collect()] == [("a", 0), ("b", 2), ("c", 4)]
    assert matrix.select_panel(v, names, 3, overfetch=0).count() == 2
    rows = spark.createDataFrame([("x", 0, "g1"), ("x", 1, "g2"), ("y", 0, "g1"), ("y", 1, "g2")], "shard string, k int, gene string")
    profile.require_same_order(rows, "shard", "gene", "k")
    with pytest.raises(ValueError, match="y"):
        profile.require_same_order(rows.withColumn("k", F.when(F.col("shard") == "y", 1 - F.col("k")).otherwise(F.col("k"))), "shard", "gene", "k")
    cells = spark.createDataFrame([("x", 0, 5), ("x", 1, 6), ("y", 0, 7)], "shard string, k long, cell long")
    state = cells.select("shard", "k", (F.col("cell") * 2).alias("s"))
    assert sorted(r["s"] for r in intervals.aligned(cells, state, "shard", "k").collect()) == [10, 12, 14]
    with pytest.raises(Exception, match="differ in number in x"):
        intervals.aligned(cells, state.where("s <> 12"), "shard", "k").collect()
    with pytest.raises(Exception, match="no number"):
        spark.createDataFrame([("none",)], "d string").select(X.strict_day_value("d")).collect()


def test_weighted_draws_take_the_last_item_before_the_point(spark):
    w = spark.createDataFrame([("x", k, 0.1) for k in range(10)] + [("y", 3, 2.0), ("z", 1, 0.0), ("z", 2, None)], "g string, item long, w double")
    got = sampling.weighted(w, "g", "item", "w", 500, 1).collect()
    assert sorted({r["g"] for r in got}) == ["x", "y"] and len(got) == 1000 and {r["item"] for r in got if r["g"] == "x"} == set(range(10))


def test_sentences_of_empty_cells_and_embedding(spark):
    rows = spark.createDataFrame([(1, [3, 5]), (2, [4]), (5, [8, 9])], "cell long, sentence array<long>")
    every = tokens.with_empty(rows, spark.createDataFrame([(1,), (2,), (5,), (9,)], "cell long"))
    got = {r["cell"]: r["vector"] for r in tokens.embed(every, lambda x: x.sum(1, keepdims=True).astype(float), 1).collect()}
    assert got == {1: [8.0], 2: [4.0], 5: [17.0], 9: [0.0]}
    assert {r["cell"]: r["length"] for r in tokens.length_buckets(every).collect()}[9] == 0


def test_weights_grids_and_side_files(spark, tmp_path):
    writers.weights(spark, str(tmp_path / "w"), {"a": np.eye(2), "b": np.zeros(3)}, {"width": 2})
    got = readers.weights(spark, str(tmp_path / "w"), {"a": (2, 2), "b": (3,)})
    assert np.array_equal(got["a"], np.eye(2)) and readers.document(spark, str(tmp_path / "w-settings")).first()["width"] == 2
    with pytest.raises(ValueError):
        readers.weights(spark, str(tmp_path / "w"), {"a": (2, 2)})
    grid = evaluate.velocity_grid(spark.createDataFrame([(0.1, 0.1, 1.0, 2.0), (0.2, 0.3, 3.0, 4.0), (1.5, 0.0, 9.0, 9.0), (None, 0.0, 1.0, 1.0)], "px double, py double, vx double, vy double"), 1.0, 2)
    assert [tuple(r) for r in grid.collect()] == [(0, 0, 2.0, 3.0, 2)]
    writers.ids(spark.createDataFrame([(2, "b"), (1, "a")], "k int, gene string"), str(tmp_path / "ids"), "gene", "k")
    assert [r["gene"] for r in readers.table(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    for _ in range(2):
        writers.metrics(spark.createDataFrame([(1, 0.5)], "step int, loss double"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
