"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank by the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import components, width, written
from helixframe.llm.minhash import forest

#: Vectors compared in one task at once: a block against a block.
BLOCK = 192


def rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """An orthogonal matrix that brings ``x @ r`` (``x`` centred) near its signs: balanced binary codes of small quantisation error.

    Principal axes first, then alternate between codes for a rotation and the
    best rotation for the codes (a Procrustes problem).
    """
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    v = x @ axes
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return axes @ r


def layout(n: int, dim: int, threshold: float, miss: float) -> tuple[int, int]:
    """``(bits a table, tables)``: some dozens of vectors a bucket, and a pair at ``threshold`` missed with probability ``miss``.

    A pair at an angle a keeps a bit with probability 1 - a / pi.
    """
    bits = max(1, min(max(round(math.log2(max(n, 2))) - 5, 4), 24, dim))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


@dataclass
class Model:
    """Codes of vectors of one length: the mean that is taken off, rotations, and the tables' layout."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int
    radius: int  # bits of all tables that a pair at the threshold may differ in


def learn(x: np.ndarray, n: int, threshold: float, miss: float) -> Model:
    """From a sample of unit vectors of a table of ``n``.

    Taking the mean off balances the codes, but widens the angle of a pair if
    the vectors lie to one side; where that takes more tables than the
    unbalanced buckets of plain vectors cost, the mean stays.
    """
    d, best = x.shape[1], None
    for mean in (x.mean(0), np.zeros(d)):
        c = x - mean
        norm = max(float(np.quantile(np.linalg.norm(c, axis=1), 0.01)), 1e-6)
        near = min(max(1 - (1 - threshold) / norm**2, -0.5), threshold) if mean.any() else threshold
        bits, tables = layout(n, d, near, miss)
        r = rotation(c, 0)
        code = (c @ r[:, :bits] >= 0) @ (1 << np.arange(bits))
        share = np.bincount(code, minlength=2) / len(x)
        cost = tables * (1 + n * float(share @ share) / BLOCK)
        if best is None or cost < best[0]:
            best = cost, mean, near, bits, tables, r
    _, mean, near, bits, tables, r = best
    need = math.ceil(tables / (d // bits))
    rotations = [r, *(rotation(x - mean, seed) for seed in range(1, need))]
    apart = math.acos(near) / math.pi
    total = bits * tables
    return Model(mean, rotations, bits, tables, math.ceil(total * apart + 5 * math.sqrt(total * apart * (1 - apart))))


def _tables(rotations: list[np.ndarray], bits: int, tables: int):
    """Numbers of the code columns of each table, none of which crosses a rotation."""
    d = rotations[0].shape[1]
    per = d // bits
    return [slice((t // per) * d + (t % per) * bits, (t // per) * d + (t % per + 1) * bits) for t in range(tables)]


def codes(x: np.ndarray, m: Model) -> np.ndarray:
    """``(vectors, tables)`` bucket numbers of unit vectors."""
    b = np.hstack([(x - m.mean) @ r for r in m.rotations]) >= 0
    place = 1 << np.arange(m.bits, dtype=np.int64)
    return np.stack([b[:, s] @ place for s in _tables(m.rotations, m.bits, m.tables)], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _packed(x: np.ndarray) -> list[bytes]:
    """Components as float32 where that holds all of them exactly, else as float64."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    exact = (small == x).all(axis=1)
    return [a.tobytes() if e else b.tobytes() for a, b, e in zip(small, x, exact, strict=True)]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in rows]))


def _encode(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(2)])
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x, m = _vectors(part.column(2), int(dim)), models[int(dim)]
                c = codes(unit(x), m).astype("<i4")
                keys = (np.arange(m.tables) << 32) + c + (int(dim) << 48)
                # The bits of all tables, those of a table in as many bytes as they need.
                wide = -(-m.bits // 8)
                rows = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), m.tables, 4)[:, :, :wide].reshape(len(c), -1)
                out = [part.column(0), part.column(1), pa.array(list(keys), pa.list_(pa.int64())), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(_packed(x), pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["g", "m", "keys", "codes", "v"])

    return run


_ENCODED = "g long, m long, keys array<long>, codes binary, v binary"


def _near(models: dict[int, Model]):
    """Of a pair of blocks of a bucket: the vectors that have a partner there within the Hamming radius, over all tables' bits.

    A pair that an earlier table's bucket holds too counts there.
    """

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        one, two, key = t.column("pa")[0].as_py(), t.column("pb")[0].as_py(), t.column("key")[0].as_py()
        m, table = models[key >> 48], (key >> 32) & 0xFFFF
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        active = np.zeros(len(block), bool)
        if len(left) and len(right):
            wide = -(-m.bits // 8)
            c = np.stack([np.frombuffer(v, np.uint8) for v in t.column("codes").to_pylist()])
            for a in range(0, len(left), 32):
                rows = left[a : a + 32]
                apart = np.bitwise_count(c[rows][:, None] ^ c[right][None]).reshape(len(rows), len(right), m.tables, wide).sum(-1, dtype=np.uint8)
                p, q = np.nonzero((apart.sum(-1, dtype=np.int32) <= m.radius) & (apart[:, :, :table] != 0).all(-1) & (rows[:, None] != right[None]))
                active[rows[p]] = active[right[q]] = True
        return t.filter(pa.array(active)).select(["g", "key", "block", "pa", "pb"])

    return run


def _compare(models: dict[int, Model], threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """Link counts and a spanning forest of one pair of blocks of one bucket.

        A pair that an earlier table's bucket holds too is counted there.
        """
        ids, m, block = (t.column(c).to_numpy() for c in ("g", "m", "block"))
        one, two, key = t.column("pa")[0].as_py(), t.column("pb")[0].as_py(), t.column("key")[0].as_py()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        a = b = n = np.zeros(0, np.int64)
        if len(left) and len(right):
            model, table = models[key >> 48], (key >> 32) & 0xFFFF
            x = _unpacked(t.column("v").to_pylist(), key >> 48)
            c = np.stack([np.frombuffer(v, np.uint8) for v in t.column("codes").to_pylist()]).reshape(len(ids), model.tables, -1)
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
            p, q = left[p], right[q]
            if one == two:
                p, q = p[p < q], q[p < q]
            new = (c[p, :table] != c[q, :table]).any(-1).all(-1)
            p, q = p[new], q[new]
            edges = forest(ids[p], ids[q])
            links = np.bincount(np.r_[p, q], np.r_[m[q], m[p]], minlength=len(ids)).astype(np.int64)
            at = np.flatnonzero(links)
            a = np.r_[ids[at], np.array([e[0] for e in edges], np.int64)]
            b = np.r_[np.full(len(at), -1), np.array([e[1] for e in edges], np.int64)]
            n = np.r_[links[at], np.zeros(len(edges), np.int64)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 0.004, sample: int = 4096) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per row of ``vectors``: links at cosine ``threshold`` or more, in double precision.

    Rotations are learned from the ``sample`` vectors (a bound, for all lengths
    together, 64 a length at least) with the smallest hash; every vector is
    coded and stored in every table. Equal vectors fall together first and
    count by their number. Codes meet first, without vectors: a bucket is cut in
    blocks of ``BLOCK``, each held against each, and only vectors with a
    partner within the Hamming radius go on. Those meet again with the original
    vectors; a task sends a count a vector and a spanning forest, not its pairs,
    and no bucket is capped. A pair at the threshold is missed with probability
    ``miss``, nearer ones with less; none below it is linked.

    Null and zero vectors and those with a null or non-finite component link
    with nothing, nor do vectors of unequal length. Rows with equal id and
    vector count as vectors of their own. A null id links with nothing and has
    null component and kept. An empty table gives no rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("i").isNotNull() & v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.withColumn("ok", F.coalesce(sound & F.exists(v, lambda e: e != 0), F.lit(False)))
    rows = written(rows.select("i", F.when(F.col("ok"), v).alias("v"), F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(7), "v").alias("d2")), "itq-rows")
    sound = rows.where("v is not null")
    # g numbers a set of equal vectors: ids may repeat over unequal ones.
    sets = sound.groupBy("d1", "d2").agg(F.min("i").alias("i"), F.count("*").alias("m"), F.any_value("v").alias("v"))
    sets = written(sets.withColumn("g", F.xxhash64("d1", "d2")), "itq-sets")

    models = {}
    dims = sets.groupBy(F.size("v").alias("d")).count().collect()  # a row a length
    part = max(64, sample // max(len(dims), 1))
    for d in dims:
        # The hash below which twice the sample is expected; then the sample itself.
        rank, below = F.shiftrightunsigned(F.xxhash64(F.lit("itq"), "g"), 1), (1 << 63) - 1
        took = sets.where((F.size("v") == d["d"]) & (rank <= F.lit(min(below, below * 2 * part // d["count"])))).select(rank.alias("r"), "g", "v").collect()
        x = np.array([r["v"] for r in sorted(took, key=lambda r: (r["r"], r["g"]))[:part]])
        models[d["d"]] = learn(unit(x), d["count"], threshold, miss)

    coded = written(sets.select("g", "m", "v").mapInArrow(_encode(models), _ENCODED), "itq-codes")
    spread = coded.select("g", F.explode("keys").alias("key"), "codes")
    size = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    placed = spread.join(size, "key").withColumn("block", F.pmod(F.xxhash64("g"), F.col("nb")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = placed.select("g", "codes", "key", "block", F.least("block", "other").alias("pa"), F.greatest("block", "other").alias("pb"))
    tasks, group = width(vectors.sparkSession), ("key", "pa", "pb")
    active = placed.repartition(tasks, *group).groupBy(*group).applyInArrow(_near(models), "g long, key long, block int, pa int, pb int")
    active = written(active, "itq-active")
    met = active.join(coded.select("g", "m", "codes", "v").hint("merge"), "g")
    found = met.repartition(tasks, *group).groupBy(*group).applyInArrow(_compare(models, threshold), "a long, b long, n long")
    found = written(found, "itq-links")

    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "g")
    joined = components(found.where("n = 0").select("a", "b"))
    named = sets.select("g", "d1", "d2", "m", F.col("i").alias("first")).join(links, "g", "left").join(joined, F.col("g") == F.col("id"), "left")
    named = named.withColumn("part", F.coalesce("component", "g"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    named = named.join(least, "part").select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id", F.lit(True).alias("hit"))
    out = rows.select("i", F.when(F.col("v").isNotNull(), F.col("d1")).alias("d1"), "d2").join(named, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "i")
    return out.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("i") == component).alias("kept"))
