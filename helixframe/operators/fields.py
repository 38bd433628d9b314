"""Vector-field models behind one protocol; applied to rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A rational approximation of the error function, off by 1.5e-7 at most.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_SCALE = 0.3275911


class VectorField(Protocol):
    def __call__(self, state: np.ndarray) -> np.ndarray: ...


def gelu(x: np.ndarray) -> np.ndarray:
    """``x`` times the normal distribution function of ``x``."""
    t = 1 / (1 + ERF_SCALE * np.abs(x) / np.sqrt(2))
    tail = np.exp(-x * x / 2) * sum(c * t ** (k + 1) for k, c in enumerate(ERF))
    return x * (1 + np.sign(x) * (1 - tail)) / 2


class Zero:
    """Nothing moves: the persistence baseline."""

    def __init__(self, genes: int):
        self.genes = genes

    def __call__(self, state: np.ndarray) -> np.ndarray:
        return np.zeros((len(state), self.genes))


class Linear:
    def __init__(self, weight: np.ndarray, bias: np.ndarray):
        self.weight, self.bias = weight, bias

    def __call__(self, state: np.ndarray) -> np.ndarray:
        return state @ self.weight + self.bias

    @classmethod
    def ridge(cls, state: np.ndarray, target: np.ndarray, penalty: float = 1e-3) -> Linear:
        """Closed form of rows at hand; :func:`ridge` does it for a table."""
        x = np.c_[state, np.ones(len(state))]
        return cls.solved(x.T @ np.c_[x, target], penalty)

    @classmethod
    def solved(cls, products: np.ndarray, penalty: float) -> Linear:
        """From products of (state, 1) with (state, 1, target), summed over the rows; the penalty is a row's."""
        d = len(products)
        w = np.linalg.solve(products[:, :d] + penalty * products[d - 1, d - 1] * np.eye(d), products[:, d:])
        return cls(w[:-1], w[-1])


class MLP:
    """Layers of weights with GELU between them."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    def __call__(self, state: np.ndarray) -> np.ndarray:
        x = state
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k < len(self.layers) - 1:
                x = gelu(x)
        return x

    @classmethod
    def seeded(cls, sizes: list[int], seed: int) -> MLP:
        r = np.random.default_rng(seed)
        return cls([(r.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])


def _heads(x: np.ndarray, heads: int) -> np.ndarray:
    """``(.., n, width)`` as ``(.., heads, n, width / heads)``."""
    return np.moveaxis(x.reshape(*x.shape[:-1], heads, -1), -2, -3)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, usable: np.ndarray | None = None) -> np.ndarray:
    """Attention of ``q`` over ``k`` by heads; keys that are not ``usable`` count nowhere, and if none is, the result is zero."""
    a, b = _heads(q, heads), _heads(k, heads)
    s = a @ np.swapaxes(b, -1, -2) / np.sqrt(a.shape[-1])
    if usable is not None:
        s = np.where(usable[..., None, None, :], s, -np.inf)
    top = s.max(-1, keepdims=True)
    e = np.exp(s - np.where(np.isfinite(top), top, 0.0))
    out = e / np.maximum(e.sum(-1, keepdims=True), 1e-300) @ _heads(v, heads)
    return np.moveaxis(out, -3, -2).reshape(q.shape)


class Conditioned:
    """Velocity of each gene from its packed tokens, conditioned on the cell's state after every encoder layer.

    ``kind`` says how: ``film`` scales and shifts the tokens, ``cross_attention``
    lets them attend to ``slots`` context vectors of the cell. ``position`` is
    ``none``, ``learned`` (bins of 100 bases) or ``rope``. The promoter's token
    stands at index 0 and is read out. Weights are one flat dictionary, seeded
    or given (``writers.weights`` and ``readers.weights`` keep it), and a given
    one must have the very names and shapes; training them is outside this
    package. Genes are independent: chunks of them give what one pass gives.
    """

    def __init__(self, state: int, tokens: int, *, width: int = 32, heads: int = 4, layers: int = 2, kind: str = "film", position: str = "rope", slots: int = 4, seed: int = 0, weights: dict[str, np.ndarray] | None = None):
        if kind not in ("film", "cross_attention"):
            raise ValueError(f"no conditioning named {kind}")
        if position not in ("none", "learned", "rope"):
            raise ValueError(f"no position named {position}")
        self.width, self.heads, self.layers, self.kind, self.position, self.slots = width, heads, layers, kind, position, slots
        shapes = {"token": (tokens, width), "distance": (1, width), "far": (width, width), "promoter": (2, width), "head": (width, 1)}
        if position == "learned":
            shapes["place"] = (2049, width)
        for k in range(layers):
            shapes |= {f"{k}.{n}": (width, width) for n in ("q", "k", "v", "o")} | {f"{k}.up": (width, 4 * width), f"{k}.down": (4 * width, width)}
            inner = width if kind == "film" else slots * width
            shapes |= {f"{k}.state": (state, inner), f"{k}.context": (inner, 2 * width if kind == "film" else inner)}
            if kind == "cross_attention":
                shapes |= {f"{k}.c{n}": (width, width) for n in "qkvo"}
        shapes |= {f"{n}.bias": (b,) for n, (_, b) in shapes.items() if n not in ("promoter", "place")}
        shapes |= {f"{n}.{part}": (width,) for n in [f"{k}.{m}" for k in range(layers) for m in ("before", "between")] + ["last"] for part in ("scale", "shift")}
        if weights is None:
            r = np.random.default_rng(seed)
            weights = {n: r.standard_normal(s) / np.sqrt(s[0]) if len(s) == 2 else np.full(s, float(n.endswith(".scale"))) for n, s in shapes.items()}
        elif {n: v.shape for n, v in weights.items()} != shapes:
            raise ValueError("these are not the weights of such a field")
        self.weights = weights

    def _dense(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[name] + self.weights[f"{name}.bias"]

    def _norm(self, name: str, x: np.ndarray) -> np.ndarray:
        y = x - x.mean(-1, keepdims=True)
        return y / np.sqrt((y * y).mean(-1, keepdims=True) + 1e-5) * self.weights[f"{name}.scale"] + self.weights[f"{name}.shift"]

    def embed(self, vectors: np.ndarray, distance: np.ndarray, promoter: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``(genes, tokens, width)`` of sequence vector, distance, promoter flag and position; padding is zero."""
        x = self._dense("token", vectors) + self._dense("far", np.tanh(self._dense("distance", distance[..., None] / 100_000.0))) + self.weights["promoter"][promoter.astype(int)]
        if self.position == "learned":
            x = x + self.weights["place"][np.clip(np.rint(distance / 100) + 1024, 0, 2048).astype(int)]
        elif self.position == "rope" and (half := self.width // 2):
            angle = distance[..., None] / 1000.0 * 10_000.0 ** (-np.arange(half) / max(half - 1, 1))
            turned = (x[..., :half] + 1j * x[..., half : 2 * half]) * np.exp(1j * angle)
            x = np.concatenate([turned.real, turned.imag, x[..., 2 * half :]], -1)
        return x * (mask > 0)[..., None]

    def chunk(self, state: np.ndarray, vectors: np.ndarray, distance: np.ndarray, promoter: np.ndarray, mask: np.ndarray) -> np.ndarray:
        usable = mask > 0
        x = np.broadcast_to(self.embed(vectors, distance, promoter, mask), (len(state), *mask.shape, self.width))
        for k in range(self.layers):
            y = self._norm(f"{k}.before", x)
            x = x + self._dense(f"{k}.o", attend(*(self._dense(f"{k}.{n}", y) for n in "qkv"), self.heads, usable))
            x = x + self._dense(f"{k}.down", gelu(self._dense(f"{k}.up", self._norm(f"{k}.between", x))))
            context = self._dense(f"{k}.context", gelu(self._dense(f"{k}.state", state)))
            if self.kind == "film":
                scale, shift = np.split(context[:, None, None, :], 2, -1)
                x = x * (1 + scale) + shift
            else:
                c = context.reshape(len(state), 1, self.slots, self.width)
                x = x + self._dense(f"{k}.co", attend(self._dense(f"{k}.cq", x), self._dense(f"{k}.ck", c), self._dense(f"{k}.cv", c), self.heads))
            x = x * usable[..., None]
        return self._dense("head", self._norm("last", x[:, :, 0]))[..., 0]

    def __call__(self, state: np.ndarray, vectors: np.ndarray, distance: np.ndarray, promoter: np.ndarray, mask: np.ndarray, chunk: int = 512) -> np.ndarray:
        """``(cells, genes)`` of ``state (cells, state)``; tokens ``(genes, n, size)``, distances, promoter flags and mask ``(genes, n)``."""
        parts = [self.chunk(state, *(t[a : a + chunk] for t in (vectors, distance, promoter, mask))) for a in range(0, len(mask), chunk)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(state), 0))


def products(rows: DataFrame, state: str, target: str) -> DataFrame:
    """``(k, values)``: row k of the products of (state, 1) with (state, 1, target), summed over all rows without nulls.

    Each task adds up its own rows; sums meet in two steps, so no task reads
    those of all others. Arrays of unequal length are an error; an empty table
    gives no rows.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    x = rows.where(whole(state) & whole(target)).select(F.col(state).cast("array<double>"), F.col(target).cast("array<double>"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                s, t = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for c in b.columns)
                s = np.c_[s, np.ones(len(b))]
                one = s.T @ np.c_[s, t]
                total = one if total is None else total + one
        if total is not None:
            n, part = len(total), TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "part", "values"])

    def added(t: pa.Table) -> pa.Table:
        total = t.column("values").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(0)
        return t.slice(0, 1).set_column(t.schema.get_field_index("values"), "values", pa.array([total], pa.list_(pa.float64())))

    sums = x.mapInArrow(partial, "k int, part int, values array<double>").groupBy("k", "part").applyInArrow(added, "k int, part int, values array<double>")
    return sums.select("k", "values").groupBy("k").applyInArrow(added, "k int, values array<double>")


def ridge(rows: DataFrame, state: str, target: str, penalty: float = 1e-3) -> Linear:
    """The linear field of least squares over all rows. The driver gets the products, as large as the widths squared, and no rows."""
    got = products(rows, state, target).orderBy("k").collect()
    if not got:
        raise ValueError("there are no rows to learn from")
    return Linear.solved(np.array([r["values"] for r in got]), penalty)


MODELS = {"zero": Zero, "linear": Linear, "mlp": MLP, "conditioned": Conditioned}


def apply(model: VectorField, state: Column) -> Column:
    """Predictions for an array column; null for a null state."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = b.to_pylist()
            at = [k for k, r in enumerate(rows) if r is not None]
            out: list = [None] * len(rows)
            if at:
                for k, p in zip(at, model(np.array([rows[k] for k in at], np.float64)).tolist(), strict=True):
                    out[k] = p
            yield pa.array(out, pa.list_(pa.float64()))

    return run(state)
