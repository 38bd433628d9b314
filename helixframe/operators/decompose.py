"""Truncated decomposition of a sparse matrix ``(cell, gene, value)``: a randomised range, orthogonal factors by trees, nothing squared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.sources.scratch import kept, superseded

#: Entries of a block of cells, and genes of a group of genes, on average.
ENTRIES, GENES = 500_000, 16_384
#: Entries in a row of a packed block; bytes that a pass may move at once: an entry, and at least.
PIECE, MOVED, LEAST = 1 << 17, 32, 1 << 28
#: Factors that the first step of a tree makes of all tasks.
WAYS = 64
#: Most columns of a range: the signs of a gene are the bits of one MD5.
MOST = 128


def signs(gene: Column, seed: int | str, columns: int) -> Column:
    """An array of ``columns`` signs of a gene: bit by bit from the digits of the MD5 of ``gene:seed``."""
    digest = F.md5(F.concat_ws(":", gene.cast("string"), F.lit(str(seed))).cast("binary"))
    bit = lambda j: F.shiftright(F.conv(F.substring(digest, j // 4 + 1, 1), 16, 10).cast("int"), j % 4).bitwiseAND(F.lit(1))
    return F.array(*[(1 - 2 * bit(j)).cast("double") for j in range(columns)])


def _signs(genes: np.ndarray, seed: int | str, columns: int) -> np.ndarray:
    """As :func:`signs`, of many genes at once."""
    raw = np.frombuffer(b"".join(hashlib.md5(f"{g}:{seed}".encode()).digest() for g in genes.tolist()), np.uint8).reshape(len(genes), 16)
    digit = np.stack([raw >> 4, raw & 15], 2).reshape(len(genes), 32)
    return 1.0 - 2.0 * ((digit[:, :, None] >> np.arange(4)) & 1).reshape(len(genes), 128)[:, :columns]


def sketch(entries: DataFrame, columns: int, seed: int | str) -> DataFrame:
    """``(cell, j, value)``: the matrix times the signs of its genes, whose span is near that of its leading columns."""
    x = entries.select("cell", "value", F.posexplode(signs(F.col("gene"), seed, columns)).alias("j", "s"))
    return x.groupBy("cell", "j").agg(F.sum(F.col("value") * F.col("s")).alias("value"))


def _again(t: pa.Table) -> pa.Table:
    r = np.linalg.qr(t.column("row").combine_chunks().flatten().to_numpy().reshape(len(t), -1), mode="r")
    return _factor(r, 0)


def _factor(r: np.ndarray, way: int) -> pa.Table:
    return pa.table({"way": pa.array([way] * len(r), pa.int32()), "row": pa.array(r.tolist(), pa.list_(pa.float64()))})


FACTOR = "way int, row array<double>"


def _joined(factors: list[DataFrame], columns: int) -> np.ndarray:
    """The triangular factor of stacked ones: those of a way are factored again, the driver gets :data:`WAYS` of them at most from each table."""
    got = [r["row"] for f in factors for r in f.groupBy("way").applyInArrow(_again, FACTOR).collect()]
    return np.linalg.qr(np.array(got), mode="r") if got else np.zeros((0, columns))


def triangle(rows: DataFrame, columns: int) -> np.ndarray:
    """The triangular factor of a tall matrix, in rows ``body`` of some of its rows each: factors of tasks are stacked and factored again, so nothing is squared.

    Each task holds a factor as large as the columns squared and a batch of rows.
    """

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for body in b.column(0):
                x = np.frombuffer(body.as_py()).reshape(-1, columns)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield from _factor(r, TaskContext.get().partitionId() % WAYS).to_batches()

    return _joined([rows.select("body").mapInArrow(reduce_, FACTOR)], columns)


def whitening(r: np.ndarray) -> np.ndarray:
    """What turns columns with this triangular factor into orthonormal ones; directions that are only rounding become zero."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    w = vt.T * np.where(s > s.max(initial=0) * 1e-11, 1 / np.where(s > 0, s, 1), 0)
    return np.pad(w, ((0, 0), (0, len(w) - w.shape[1])))  # of fewer rows than columns


def _groups(genes: np.ndarray, groups: int) -> np.ndarray:
    """A group of each gene, the same everywhere."""
    return ((genes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)


def _bodies(t: pa.Table, column: str = "body") -> list[memoryview]:
    return [x.as_buffer() for c in t.column(column).chunks for x in c]


PACKED = "cb int, gb int, body binary"


def _packed(cb: list[int], gb: list[int], body: list[bytes]) -> pa.Table:
    return pa.table({"cb": pa.array(cb, pa.int32()), "gb": pa.array(gb, pa.int32()), "body": pa.array(body, pa.binary())})


class _Blocks:
    """The entries in blocks of whole cells, packed once, and in each block the genes it needs, by groups of genes.

    A matrix of genes is rows ``(gb, genes, body)``, a row a group. In a pass a
    group sends each block the rows that it needs, once; the cells' products are
    made and used in the block's task, so they are written nowhere. A pass goes
    over slices of the blocks, so that what it moves at once follows the entries.
    """

    def __init__(self, entries: DataFrame, columns: int):
        x = entries.select(F.col("cell").cast("long").alias("cell"), F.col("gene").cast("long").alias("gene"), F.col("value").cast("double").alias("value")).where("value <> 0")
        x, path = kept(x, "decompose")
        n = x.count()
        self.genes, genes = kept(x.groupBy("gene").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("squares")), "decompose-sums")
        groups, blocks = max(1, -(-self.genes.count() // GENES)), max(1, -(-n // ENTRIES))

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            cb = key[0].as_py()
            _, i = np.unique(t.column("cell").to_numpy(), return_inverse=True)
            ids, j = np.unique(t.column("gene").to_numpy(), return_inverse=True)
            group = _groups(ids, groups)
            order = np.lexsort((ids, group))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids))
            i, j, v = i.astype(np.int32), place[j], t.column("value").to_numpy()
            gb, at = np.unique(group[order], return_index=True)
            needs = [p.tobytes() for p in np.split(ids[order], at[1:])]
            pieces = [i[a : a + PIECE].tobytes() + j[a : a + PIECE].tobytes() + v[a : a + PIECE].tobytes() for a in range(0, len(v), PIECE)]
            return _packed([cb] * (len(needs) + len(pieces)), [*gb.tolist(), *[-1] * len(pieces)], needs + pieces)

        x = x.withColumn("cb", F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int"))
        packed, whole = kept(x.groupBy("cb").applyInArrow(pack, PACKED), "decompose-blocks")
        superseded(x.sparkSession, path)
        self.entries, self.needs, self.paths = packed.where("gb < 0"), packed.where("gb >= 0"), [whole, genes]
        # A needed row comes in single and goes back in double precision.
        needed = (self.needs.agg(F.sum(F.length("body"))).first()[0] or 0) // 8
        self.filled, self.slices = n > 0, max(1, min(blocks, -(-needed * 12 * columns // max(MOVED * n, LEAST))))

    def _part(self, x: DataFrame, k: int) -> DataFrame:
        return x.where(F.pmod("cb", F.lit(self.slices)) == k)

    def _sides(self, z: DataFrame | None, m: np.ndarray | None, k: int) -> DataFrame:
        """``(cb, gb, body)``: the rows of genes that blocks need, turned by ``m``; without a matrix the genes themselves.

        They are rounded to single precision here, and all that follows is of the
        rounded ones in double: the range tilts by that, its factors do not.
        """
        needs = self._part(self.needs, k)
        if z is None:
            return needs

        def part(s: pa.Table, t: pa.Table) -> pa.Table:
            if not len(s) or not len(t):
                return _packed([], [], [])
            genes = np.frombuffer(_bodies(t, "genes")[0], np.int64)
            x = (np.frombuffer(_bodies(t)[0]).reshape(len(genes), -1) @ m).astype(np.float32)
            return _packed(s.column("cb").to_pylist(), s.column("gb").to_pylist(), [x[np.searchsorted(genes, np.frombuffer(b, np.int64))].tobytes() for b in _bodies(s)])

        return needs.groupBy("gb").cogroup(z.groupBy("gb")).applyInArrow(part, PACKED)

    def _met(self, z: DataFrame | None, m: np.ndarray | None, k: int, work, kind: str, columns: int, seed: int | str) -> DataFrame:
        """``work`` on each block: its entries, what it needs of the genes, and the products of its cells."""
        signed = z is None

        def part(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("gb")
            gb, body = t.column("gb").to_numpy(), _bodies(t)
            pieces = [np.frombuffer(b, np.uint8) for b, g in zip(body, gb, strict=True) if g < 0]
            i, j, v = (np.concatenate([p[a * len(p) // 16 : b * len(p) // 16].view(d) for p in pieces]) for a, b, d in ((0, 4, np.int32), (4, 8, np.int32), (8, 16, np.float64)))
            rows = [_signs(np.frombuffer(b, np.int64), seed, columns) if signed else np.frombuffer(b, np.float32).reshape(-1, columns) for b, g in zip(body, gb, strict=True) if g >= 0]
            y = _times(i, j, v, np.concatenate(rows), int(i.max()) + 1)
            return work(key[0].as_py(), i, j, v, y, gb[gb >= 0], [len(x) for x in rows])

        return self._part(self.entries, k).unionByName(self._sides(z, m, k)).groupBy("cb").applyInArrow(part, kind)

    def factor(self, z: DataFrame | None, m: np.ndarray | None, columns: int, seed: int | str) -> np.ndarray:
        """The triangular factor of the matrix times ``z`` (or signs) times ``m``."""
        work = lambda cb, i, j, v, y, gb, sizes: _factor(np.linalg.qr(y, mode="r"), cb % WAYS)
        found = [kept(self._met(z, m, k, work, FACTOR, columns, seed), "decompose-factors") for k in range(self.slices)]
        out = _joined([x for x, _ in found], columns)
        superseded(self.entries.sparkSession, *(path for _, path in found))
        return out

    def back(self, z: DataFrame | None, m: np.ndarray | None, turn: np.ndarray, columns: int, seed: int | str) -> tuple[DataFrame, str]:
        """``(gb, genes, body)``: the matrix turned over, times the products of the cells, times ``turn``."""

        def work(cb, i, j, v, y, gb, sizes):
            parts = np.split(_times(j, i, v, y @ turn, sum(sizes)), np.cumsum(sizes)[:-1])
            return _packed([cb] * len(gb), gb.tolist(), [p.tobytes() for p in parts])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            got = {"genes": {}, "body": {}}
            for cb, kind, b in zip(t.column("cb").to_pylist(), t.column("kind").to_pylist(), _bodies(t), strict=True):
                got[kind][cb] = np.frombuffer(b, np.int64) if kind == "genes" else np.frombuffer(b)
            genes = np.unique(np.concatenate(list(got["genes"].values())))
            total = np.zeros((len(genes), columns))
            for cb in sorted(got["genes"]):
                total[np.searchsorted(genes, got["genes"][cb])] += got["body"][cb].reshape(-1, columns)
            return pa.table({"gb": pa.array([key[0].as_py()], pa.int32()), "genes": pa.array([genes.tobytes()], pa.binary()), "body": pa.array([total.tobytes()], pa.binary())})

        spark, out, path = self.entries.sparkSession, None, None
        for k in range(self.slices):
            parts = self._met(z, m, k, work, PACKED, columns, seed).withColumn("kind", F.lit("body"))
            parts = parts.unionByName(self._part(self.needs, k).withColumn("kind", F.lit("genes")))
            if out is not None:
                for kind in ("genes", "body"):
                    parts = parts.unionByName(out.select(F.lit(-1).alias("cb"), "gb", F.col(kind).alias("body"), F.lit(kind).alias("kind")))
            old = path
            out, path = kept(parts.groupBy("gb").applyInArrow(add, "gb int, genes binary, body binary"), "decompose-genes")
            if old:
                superseded(spark, old)
        return out, path


def _times(i: np.ndarray, j: np.ndarray, value: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums by ``i`` of values times the rows ``j``, a column at a time: no copy of all entries in all columns."""
    return np.stack([np.bincount(i, value * rows[j, c], n) for c in range(rows.shape[1])], 1) if n else np.zeros((0, rows.shape[1]))


def svd(entries: DataFrame, k: int, *, cells: int, oversample: int = 10, power: int = 2, seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """``(gene, pc, weight)`` and ``(pc, singular, share)``: the leading right singular vectors, uncentred, and their shares of the variance.

    ``entries(cell, gene, value)`` hold a row an entry; what is not stored is
    zero, and ``cells`` counts all rows of the matrix, stored or not. The range
    of ``k + oversample`` columns is found from random signs and sharpened by
    ``power`` passes there and back; every factor is triangular, from a tree.
    Singular values are accurate to the gap's power of four a pass; the largest
    weight of a component is positive. Shares are variances of the scores of all
    cells over that of the matrix. The driver gets factors as large as the
    columns squared; genes and cells stay rows. An empty matrix gives no rows.
    """
    spark, columns = entries.sparkSession, min(k + oversample, MOST)
    blocks = _Blocks(entries, columns)
    used, b, turn, r = blocks.paths, None, None, np.zeros((0, columns))
    for _ in range(power + 1 if blocks.filled else 0):
        m = whitening(blocks.factor(b, turn, columns, seed))
        last = used[2:]
        b, path = blocks.back(b, turn, m, columns, seed)
        superseded(spark, *last)
        used[2:] = [path]
        r = triangle(b, columns)
        turn = whitening(r)
    if not len(r):
        superseded(spark, *used)
        none = spark.createDataFrame([], "gene long, pc long, weight double")
        return none, spark.createDataFrame([], "pc long, singular double, share double")
    # The rows of b are genes; its triangular factor has its singular values.
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    k = min(k, int((s > s.max() * 1e-11).sum()))
    v = vt.T[:, :k] / s[:k]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for genes, body in zip(batch.column(0), batch.column(1), strict=True):
                x = np.ascontiguousarray(np.frombuffer(body.as_py()).reshape(-1, columns) @ v)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(genes.as_py(), np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k, dtype=np.int32)), pa.array(x.ravel()))], names=["gene", "w"])

    weights, _ = kept(b.select("genes", "body").mapInArrow(weigh, "gene long, w array<double>"), "decompose-weights")
    w = [F.get("w", c) for c in range(k)]
    top = weights.agg(*[F.max_by(x, F.struct(F.abs(x), -F.col("gene"))).alias(f"_{c}") for c, x in enumerate(w)]).first()
    turn = [1.0 if (top[c] or 0) >= 0 else -1.0 for c in range(k)]
    by_gene = blocks.genes.join(weights, "gene")
    whole = by_gene.agg(F.sum("squares").alias("squares"), F.sum(F.col("sum") * F.col("sum")).alias("means"), *[F.sum(F.col("sum") * x).alias(f"_{c}") for c, x in enumerate(w)]).first()
    spread = whole["squares"] / cells - whole["means"] / cells**2
    rows = [(c, float(s[c]), float((s[c] ** 2 / cells - (whole[f"_{c}"] / cells) ** 2) / spread) if spread > 0 else None) for c in range(k)]
    superseded(spark, *used)
    loadings = weights.select("gene", F.posexplode(F.array(*[x * F.lit(t) for x, t in zip(w, turn, strict=True)])).alias("pc", "weight")).select("gene", F.col("pc").cast("long").alias("pc"), "weight")
    return loadings, spark.createDataFrame(rows, "pc long, singular double, share double")
