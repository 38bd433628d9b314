"""Training of vector fields on Spark: gradients summed over blocks of rows and chunks of genes, AdamW, a checkpoint a step.

A task turns its rows into one gradient; gradients meet in two steps of sums.
What the driver holds is the model and its moments, never rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import fields
from helixframe.sources import scratch, writers

#: Groups that the first step of sums makes of all tasks.
WAYS = 32
#: Bytes of a block's rows at most, on average, and numbers in the widest array of a forward pass at once.
BLOCK_BYTES, ACTIVE = 1 << 25, 1 << 18
Arrays = dict[str, np.ndarray]


def gelu_slope(x: np.ndarray) -> np.ndarray:
    """The derivative of :func:`fields.gelu` as it is computed there, its approximation included."""
    a = np.abs(x)
    t = 1 / (1 + fields.ERF_SCALE * a / np.sqrt(2))
    e = np.exp(-x * x / 2)
    p = sum(c * t ** (k + 1) for k, c in enumerate(fields.ERF))
    slope = sum((k + 1) * c * t**k for k, c in enumerate(fields.ERF))
    falls = -a * e * p - e * slope * t * t * fields.ERF_SCALE / np.sqrt(2)  # of the tail, by |x|
    return (1 + np.sign(x) * (1 - e * p)) / 2 - x * falls / 2


class Way:
    """A forward pass that remembers how to send a gradient back; ``sums`` gathers those of the weights."""

    def __init__(self, weights: Arrays):
        self.w, self.sums = weights, {n: np.zeros(v.shape) for n, v in weights.items()}

    def dense(self, name: str, x: np.ndarray):
        w = self.w[name]

        def back(g: np.ndarray) -> np.ndarray:
            flat = g.reshape(-1, g.shape[-1])
            self.sums[name] += x.reshape(-1, x.shape[-1]).T @ flat
            self.sums[f"{name}.bias"] += flat.sum(0)
            return g @ w.T

        return x @ w + self.w[f"{name}.bias"], back

    def gelu(self, x: np.ndarray):
        return fields.gelu(x), lambda g: g * gelu_slope(x)

    def norm(self, name: str, x: np.ndarray):
        y = x - x.mean(-1, keepdims=True)
        spread = np.sqrt((y * y).mean(-1, keepdims=True) + 1e-5)
        z, scale = y / spread, self.w[f"{name}.scale"]

        def back(g: np.ndarray) -> np.ndarray:
            self.sums[f"{name}.scale"] += (g * z).reshape(-1, z.shape[-1]).sum(0)
            self.sums[f"{name}.shift"] += g.reshape(-1, z.shape[-1]).sum(0)
            g = g * scale
            return (g - g.mean(-1, keepdims=True) - z * (g * z).mean(-1, keepdims=True)) / spread

        return z * scale + self.w[f"{name}.shift"], back

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, usable: np.ndarray | None = None):
        a, b, c = (fields._heads(x, heads) for x in (q, k, v))
        root = np.sqrt(a.shape[-1])
        s = a @ np.swapaxes(b, -1, -2) / root
        if usable is not None:
            s = np.where(usable[..., None, None, :], s, -np.inf)
        top = s.max(-1, keepdims=True)
        e = np.exp(s - np.where(np.isfinite(top), top, 0.0))
        p = e / np.maximum(e.sum(-1, keepdims=True), 1e-300)
        joined = lambda x, like: np.moveaxis(x, -3, -2).reshape(*x.shape[:-3], like.shape[-2], like.shape[-1])

        def fitted(x: np.ndarray, like: np.ndarray) -> np.ndarray:
            """Summed over the axes along which ``like`` was spread."""
            x = joined(x, like)
            for axis, n in enumerate(like.shape):
                if n == 1 and x.shape[axis] > 1:
                    x = x.sum(axis, keepdims=True)
            return x

        def back(g: np.ndarray):
            h = fields._heads(g, heads)
            d = h @ np.swapaxes(c, -1, -2)
            d = p * (d - (d * p).sum(-1, keepdims=True)) / root
            return fitted(d @ b, q), fitted(np.swapaxes(d, -1, -2) @ a, k), fitted(np.swapaxes(p, -1, -2) @ h, v)

        return np.moveaxis(p @ c, -3, -2).reshape(q.shape), back


def weights(model: fields.MLP | fields.Conditioned) -> Arrays:
    """The model's arrays by name."""
    if isinstance(model, fields.Conditioned):
        return model.weights
    return {f"{k}{n}": x for k, (w, b) in enumerate(model.layers) for n, x in (("", w), (".bias", b))}


def rebuilt(model: fields.MLP | fields.Conditioned, arrays: Arrays) -> fields.MLP | fields.Conditioned:
    """The same kind of model with other weights."""
    if isinstance(model, fields.Conditioned):
        size = model.weights["0.state"].shape[0] if model.layers else 0
        return fields.Conditioned(size, model.weights["token"].shape[0], width=model.width, heads=model.heads, layers=model.layers, kind=model.kind, position=model.position, slots=model.slots, weights=arrays)
    return fields.MLP([(arrays[f"{k}"], arrays[f"{k}.bias"]) for k in range(len(model.layers))])


def gradient(model: fields.MLP, state: np.ndarray, target: np.ndarray) -> tuple[float, Arrays]:
    """The sum of squared errors over rows and genes, and its gradient."""
    way, x, backs = Way(weights(model)), state, []
    for k in range(len(model.layers)):
        x, b = way.dense(f"{k}", x)
        backs.append(b)
        if k < len(model.layers) - 1:
            x, b = way.gelu(x)
            backs.append(b)
    g = 2 * (x - target)
    loss = float(((x - target) ** 2).sum())
    for b in reversed(backs):
        g = b(g)
    return loss, way.sums


def conditioned_gradient(m: fields.Conditioned, state: np.ndarray, target: np.ndarray, vectors: np.ndarray, distance: np.ndarray, promoter: np.ndarray, mask: np.ndarray) -> tuple[float, Arrays]:
    """As :func:`gradient`, of a chunk of genes: ``target (cells, genes)``, tokens as in :class:`fields.Conditioned`."""
    way, usable, wide = Way(m.weights), mask > 0, m.width
    near, back_near = way.dense("distance", distance[..., None] / 100_000.0)
    far, back_far = way.dense("far", np.tanh(near))
    _, back_token = way.dense("token", vectors)
    first = np.broadcast_to(m.embed(vectors, distance, promoter, mask), (len(state), *mask.shape, wide))
    x, steps = first, []
    for k in range(m.layers):
        y, b_before = way.norm(f"{k}.before", x)
        (q, bq), (key, bk), (v, bv) = (way.dense(f"{k}.{n}", y) for n in "qkv")
        a, b_attend = way.attend(q, key, v, m.heads, usable)
        o, bo = way.dense(f"{k}.o", a)
        x = x + o
        y, b_between = way.norm(f"{k}.between", x)
        up, b_up = way.dense(f"{k}.up", y)
        h, b_h = way.gelu(up)
        down, b_down = way.dense(f"{k}.down", h)
        x = x + down
        s, b_state = way.dense(f"{k}.state", state)
        s, b_s = way.gelu(s)
        context, b_context = way.dense(f"{k}.context", s)
        if m.kind == "film":
            scale, shift = np.split(context[:, None, None, :], 2, -1)
            inner = x
            x = x * (1 + scale) + shift

            def conditioned(g, inner=inner, scale=scale):
                return g * (1 + scale), np.concatenate([(g * inner).sum((1, 2)), g.sum((1, 2))], -1)
        else:
            c = context.reshape(len(state), 1, m.slots, wide)
            (cq, bcq), (ck, bck), (cv, bcv) = (way.dense(f"{k}.c{n}", z) for n, z in (("q", x), ("k", c), ("v", c)))
            ca, b_ca = way.attend(cq, ck, cv, m.heads)
            co, bco = way.dense(f"{k}.co", ca)
            x = x + co

            def conditioned(g, bcq=bcq, bck=bck, bcv=bcv, b_ca=b_ca, bco=bco):
                gq, gk, gv = b_ca(bco(g))
                return g + bcq(gq), (bck(gk) + bcv(gv)).reshape(len(state), -1)

        x = x * usable[..., None]
        steps.append((conditioned, b_context, b_s, b_state, b_down, b_h, b_up, b_between, bo, b_attend, bq, bk, bv, b_before))
    last, b_last = way.norm("last", x[:, :, 0])
    out, b_head = way.dense("head", last)
    error = out[..., 0] - target
    g = np.zeros(x.shape)
    g[:, :, 0] = b_last(b_head(2 * error[..., None]))
    for conditioned, b_context, b_s, b_state, b_down, b_h, b_up, b_between, bo, b_attend, bq, bk, bv, b_before in reversed(steps):
        g, c = conditioned(g * usable[..., None])
        b_state(b_s(b_context(c)))
        g = g + b_between(b_up(b_h(b_down(g))))
        gq, gk, gv = b_attend(bo(g))
        g = g + b_before(bq(gq) + bk(gk) + bv(gv))
    g = g.sum(0) * usable[..., None]
    if m.position == "learned":
        np.add.at(way.sums["place"], np.clip(np.rint(distance / 100) + 1024, 0, 2048).astype(int), g)
    elif m.position == "rope" and (half := wide // 2):
        angle = distance[..., None] / 1000.0 * 10_000.0 ** (-np.arange(half) / max(half - 1, 1))
        turned = (g[..., :half] + 1j * g[..., half : 2 * half]) * np.exp(-1j * angle)
        g = np.concatenate([turned.real, turned.imag, g[..., 2 * half :]], -1)
    np.add.at(way.sums["promoter"], promoter.astype(int), g)
    back_token(g)
    back_near(back_far(g) * (1 - np.tanh(near) ** 2))
    return float((error**2).sum()), way.sums


def _sent(loss: float, n: int, sums: Arrays, part: int) -> pa.Table:
    """A task's loss, number of errors and gradient, a row an array."""
    rows = {"": np.array([loss, n], np.float64)} | sums
    return pa.table({"name": pa.array(list(rows)), "part": pa.array([part % WAYS] * len(rows), pa.int32()), "values": pa.array([v.ravel().tolist() for v in rows.values()], pa.list_(pa.float64()))})


SENT = "name string, part int, values array<double>"


def _added(t: pa.Table) -> pa.Table:
    total = t.column("values").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)
    return t.slice(0, 1).set_column(t.schema.get_field_index("values"), "values", pa.array([total], pa.list_(pa.float64())))


def _met(parts: DataFrame, shapes: Arrays) -> tuple[float, Arrays]:
    """Mean loss and its gradient. The driver gets the model's size."""
    sums = parts.groupBy("name", "part").applyInArrow(_added, SENT).groupBy("name").applyInArrow(_added, SENT).collect()
    got = {r["name"]: np.array(r["values"]) for r in sums}
    if "" not in got or not got[""][1]:
        raise ValueError("there are no rows to learn from")
    loss, n = map(float, got.pop(""))
    return loss / n, {k: v.reshape(shapes[k].shape) / n for k, v in got.items()}


def _usable(rows: DataFrame, state: str, target: str) -> DataFrame:
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    return rows.where(whole(state) & whole(target)).select(F.col(state).cast("array<double>").alias("state"), F.col(target).cast("array<double>").alias("target"))


def _matrix(c: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def loss_and_gradient(model: fields.MLP, rows: DataFrame, state: str = "state", target: str = "target") -> tuple[float, Arrays]:
    """Mean squared error of an MLP over all rows and genes, and its gradient.

    Rows with a null state, target or component do not count; none at all is an
    error, as are arrays of unequal length.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, None
        for b in batches:
            if len(b):
                x, y = (_matrix(c, len(b)) for c in b.columns)
                one, sums = gradient(model, x, y)
                loss, n = loss + one, n + y.size
                total = sums if total is None else {k: total[k] + v for k, v in sums.items()}
        if total is not None:
            yield from _sent(loss, n, total, TaskContext.get().partitionId()).to_batches()

    return _met(_usable(rows, state, target).mapInArrow(part, SENT), weights(model))


def dealt(rows: DataFrame, tokens: DataFrame, chunk: int, blocks: int):
    """Blocks of rows beside chunks of genes, cogrouped by both: ``rows`` with a ``_block``, and the tokens of a chunk once a block.

    ``tokens(gene, vectors, distance, promoter, mask)`` has a row a gene,
    numbered from 0. Arrays of ``rows`` named ``target`` are cut to the chunk.
    """
    n = tokens.count()
    chunks = max(1, -(-n // chunk))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("_chunk", every(chunks))
    if "target" in rows.columns:
        left = left.withColumn("target", F.slice("target", F.col("_chunk") * chunk + 1, F.lit(chunk)))
    right = tokens.withColumn("_chunk", F.floor(F.col("gene") / chunk).cast("int")).withColumn("_block", every(blocks))
    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("_chunk", "_block"))


def packed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gene numbers, vectors, distances, promoter flags and mask of a chunk, in gene order."""
    t = t.sort_by("gene")
    n = len(t)
    distance, mask = _matrix(t.column("distance"), n), _matrix(t.column("mask"), n)
    flags = _matrix(t.column("promoter"), n)
    vectors = t.column("vectors").combine_chunks().flatten().flatten().to_numpy(zero_copy_only=False).reshape(*mask.shape, -1)
    return t.column("gene").to_numpy(), vectors, distance, flags, mask


def chunked_loss_and_gradient(model: fields.Conditioned, rows: DataFrame, tokens: DataFrame, *, state: str = "state", target: str = "target", chunk: int = 512, blocks: int = 8) -> tuple[float, Arrays]:
    """As :func:`loss_and_gradient`, of a field conditioned on tokens: chunks of genes and blocks of rows are separate tasks.

    Sums of squares add up over chunks and blocks, so any ``chunk`` and
    ``blocks`` give the gradient of one pass. Blocks become more where a block's
    rows would be over :data:`BLOCK_BYTES`; a task goes through its rows in
    slices, so what it holds beside them follows the model and the chunk. A
    target needs an element a gene.
    """
    x = _usable(rows, state, target)
    size = x.agg(F.count("*").alias("n"), F.max(F.size("state")).alias("wide")).first()
    blocks = max(blocks, -(-size["n"] * 8 * ((size["wide"] or 0) + chunk) // BLOCK_BYTES))
    x = x.withColumn("_block", F.pmod(F.xxhash64("state", "target"), F.lit(blocks)).cast("int"))

    def part(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _sent(0.0, 0, {}, 0).slice(0, 0)
        _, *own = packed(right)
        y, states = _matrix(left.column("target"), len(left)), _matrix(left.column("state"), len(left))
        step = max(1, ACTIVE // (own[-1].size * 4 * model.width))
        loss, sums = 0.0, {}
        for a in range(0, len(y), step):
            one, got = conditioned_gradient(model, states[a : a + step], y[a : a + step], *own)
            loss, sums = loss + one, {k: sums[k] + v for k, v in got.items()} if sums else got
        return _sent(loss, y.size, sums, key[0].as_py() * 31 + key[1].as_py())

    return _met(dealt(x, tokens, chunk, blocks).applyInArrow(part, SENT), model.weights)


def predict(model: fields.Conditioned, rows: DataFrame, tokens: DataFrame, key: str, state: str = "state", *, chunk: int = 512, blocks: int = 8) -> DataFrame:
    """``(key, gene, velocity)`` of every row with a state and every gene of ``tokens``; rows without a state give none."""
    kind = rows.schema[key].dataType
    x = rows.where(F.col(state).isNotNull()).select(F.col(key).alias("key"), F.col(state).cast("array<double>").alias("state")).withColumn("_block", F.pmod(F.xxhash64("key", "state"), F.lit(blocks)).cast("int"))

    def part(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"key": left.column("key").slice(0, 0), "gene": pa.array([], pa.int64()), "velocity": pa.array([], pa.float64())})
        gene, *own = packed(right)
        out = model.chunk(_matrix(left.column("state"), len(left)), *own)
        at = pa.array(np.repeat(np.arange(len(left)), len(gene)))
        return pa.table({"key": left.column("key").combine_chunks().take(at), "gene": pa.array(np.tile(gene, len(left)), pa.int64()), "velocity": pa.array(out.ravel(), pa.float64())})

    return dealt(x, tokens, chunk, blocks).applyInArrow(part, f"key {kind.simpleString()}, gene long, velocity double").withColumnRenamed("key", key)


def variants(models: dict[str, fields.Conditioned], rows: DataFrame, tokens: DataFrame, key: str, path: str, signature: object, **more) -> DataFrame:
    """``(variant, key, gene, velocity)`` of several models over the same rows; each is kept under ``path`` and read where it is there.

    What is kept goes by the variant's name, its weights and ``signature``,
    which names the rows and tokens: another of these is predicted anew.
    """
    out = None
    for name, model in sorted(models.items()):
        digest = hashlib.sha256(b"".join(k.encode() + np.ascontiguousarray(v).tobytes() for k, v in sorted(model.weights.items()))).hexdigest()
        made = writers.materialise(predict(model, rows, tokens, key, **more), path, [name, digest, model.kind, model.position, model.heads, signature])
        one = made.select(F.lit(name).alias("variant"), *made.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there is no variant to predict")
    return out


@dataclass(frozen=True)
class AdamW:
    """Moments of the gradient with a bias correction; decay acts on the weights themselves."""

    rate: float = 1e-3
    first: float = 0.9
    second: float = 0.999
    tiny: float = 1e-8
    decay: float = 0.01

    def step(self, at: int, arrays: Arrays, grads: Arrays, m: Arrays, v: Arrays) -> tuple[Arrays, Arrays, Arrays]:
        """Weights and moments after step ``at``, counted from 1."""
        m = {k: self.first * m[k] + (1 - self.first) * g for k, g in grads.items()}
        v = {k: self.second * v[k] + (1 - self.second) * g * g for k, g in grads.items()}
        move = lambda k: m[k] / (1 - self.first**at) / (np.sqrt(v[k] / (1 - self.second**at)) + self.tiny)
        return {k: w * (1 - self.rate * self.decay) - self.rate * move(k) for k, w in arrays.items()}, m, v


def _steps(spark: SparkSession, path: str) -> list[int]:
    """Steps whose checkpoint is whole, in order."""
    if not writers.exists(spark, path):
        return []
    p, fs = writers._path(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[5:]) for n in found if n.startswith("step-") and writers.exists(spark, f"{path}/{n}/_SUCCESS"))


def train(
    spark: SparkSession, model: fields.MLP | fields.Conditioned, batch: Callable[[int], DataFrame], steps: int, path: str, signature: object, *, tokens: DataFrame | None = None, optimiser: AdamW | None = None, chunk: int = 512, blocks: int = 8
) -> tuple[fields.MLP | fields.Conditioned, list[float]]:
    """The model after ``steps`` steps and the loss before each; ``batch(step)`` gives rows ``(state, target)``, steps count from 0.

    After each step weights, moments and losses are written under ``path``, in a
    folder named by the signature, the optimiser and the model's shapes. A run
    that ended goes on after its last whole step, and gives what one run would,
    if batches depend on their number only. The step before the last stays until
    the next is whole.
    """
    rule = optimiser or AdamW()
    arrays = weights(model)
    name = json.dumps([signature, vars(rule), sorted((k, v.shape) for k, v in arrays.items())], sort_keys=True, default=str)
    at = f"{path.rstrip('/')}/{hashlib.sha256(name.encode()).hexdigest()[:24]}"
    done = _steps(spark, at)
    m, v, losses = {k: np.zeros(x.shape) for k, x in arrays.items()}, {k: np.zeros(x.shape) for k, x in arrays.items()}, []
    if done:
        rows = spark.read.parquet(f"{at}/step-{done[-1]}").collect()  # the model and its moments
        got = {(r["kind"], r["name"]): np.array(r["values"]) for r in rows}
        losses = got.pop(("loss", "")).tolist()
        arrays, m, v = ({k: got[kind, k].reshape(x.shape) for k, x in arrays.items()} for kind in ("weight", "first", "second"))
    for k in range(done[-1] + 1 if done else 0, steps):
        now = rebuilt(model, arrays)
        loss, grads = loss_and_gradient(now, batch(k)) if tokens is None else chunked_loss_and_gradient(now, batch(k), tokens, chunk=chunk, blocks=blocks)
        arrays, m, v = rule.step(k + 1, arrays, grads, m, v)
        losses.append(loss)
        rows = [(kind, n, x.ravel().tolist()) for kind, part in (("weight", arrays), ("first", m), ("second", v)) for n, x in part.items()] + [("loss", "", losses)]
        spark.createDataFrame(rows, "kind string, name string, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/step-{k}")
        for old in _steps(spark, at)[:-2]:
            scratch.delete(spark, f"{at}/step-{old}")
    return rebuilt(model, arrays), losses[:steps]
