"""Text quality by compressed size under dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written
from helixframe.llm.compression import Coder, smallest


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, then the constant


#: Letters to their case, digits to 0, other bytes as they are: how a text is written, without its words.
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 0xC0 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
_TAILS = bytes(range(0x80, 0xC0))


def shape(text: bytes) -> bytes:
    return text.translate(_SHAPE, _TAILS)


class Scales:
    """Compressed sizes of a text and of its shape under the bad, the good and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.views = [[Coder(bad), Coder(good), Coder(None)], [Coder(shape(bad)), Coder(shape(good))]]

    def features(self, text: bytes) -> list[float]:
        """The normalised differences first, then the sizes they come from and the length: they tell repetition, which both dictionaries see alike."""
        n = len(text)
        bad, good, alone = (c.size(text) / n for c in self.views[0])
        outline = shape(text)
        sbad, sgood = (c.size(outline) / len(outline) for c in self.views[1])
        diff, sdiff = (bad - good) / max(bad, good), (sbad - sgood) / max(sbad, sgood)
        return [diff, diff * abs(diff), sdiff, sdiff * abs(sdiff), good, alone, alone * alone, sgood, float(np.log(n))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last weight is the constant."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / dev, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        pull = ridge * np.r_[np.ones(len(w) - 1), 0] * weight.sum()
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), z.T @ (weight * (y - p)) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    flat = w[:-1] / dev
    return np.r_[flat, w[-1] - flat @ mean]


def fit(docs: DataFrame, labels: DataFrame, *, dictionary_docs: int = 200, calibration_docs: int = 2500) -> QualityModel:
    """Dictionaries and calibration from ``docs(doc_id, text)`` with ``labels(doc_id, quality)``.

    The sample is bounded in rows: per class the ``dictionary_docs`` labelled
    texts with the smallest id hash (half of the class if it has fewer than
    twice as many) are the dictionary, the next ``calibration_docs`` calibrate
    the score; texts are taken whole. Each class weighs as its count of labelled
    texts. Ids that are null, repeated with unequal labels, or whose text is
    null, empty or absent teach nothing; without labelled texts of both classes
    the score is the share of label 1 (0.5 without any).
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text")
    # Ids alone meet first; the texts of the chosen few follow.
    marked = texts.select("doc_id").distinct().join(marks, "doc_id")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        p = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return QualityModel(b"", b"", (float(np.log(p / (1 - p))),))
    most = dictionary_docs + calibration_docs
    chosen = smallest(marked, "y", F.xxhash64(F.lit("quality"), "doc_id"), 2 * most, most).select("doc_id", "y", "_rank")
    # About 4 * most ids at most: a bounded side. Of an id with several texts, the least counts.
    chosen = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "_rank").agg(F.min("text").alias("text"))
    chosen = written(chosen, "quality-sample")

    ranks = {0: [], 1: []}
    for r in chosen.select("y", "_rank").collect():
        ranks[r["y"]].append(r["_rank"])
    cut, last = {}, {}
    for y, of in ranks.items():
        of.sort()
        first = min(dictionary_docs, max(1, len(of) // 2))
        cut[y], last[y] = of[first - 1], of[min(first + calibration_docs, len(of)) - 1]
    limit = lambda at: F.when(F.col("y") == 0, F.lit(at[0])).otherwise(F.lit(at[1]))
    held: dict[int, list] = {0: [], 1: []}
    for r in chosen.where(F.col("_rank") <= limit(cut)).select("y", "_rank", "text").collect():
        held[r["y"]].append((r["_rank"], r["text"]))
    bad, good = ("\n".join(t for _, t in sorted(held[y])).encode() for y in (0, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = Scales(good, bad)
        for b in batches:
            x = [scales.features(t.as_py().encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["y", "r", "x"])

    # A class of one text has it on both sides.
    alone = {y: len(set(ranks[y])) == 1 for y in (0, 1)}
    rest = (F.col("_rank") > limit(cut)) | F.when(F.col("y") == 0, F.lit(alone[0])).otherwise(F.lit(alone[1]))
    got = chosen.where(rest & (F.col("_rank") <= limit(last))).select("y", "text", "_rank").mapInArrow(measure, "y int, r long, x array<double>").collect()
    got = sorted(got, key=lambda r: (r["y"], r["r"], r["x"]))
    y = np.array([r["y"] for r in got], float)
    share = counts[1] / sum(counts.values())
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    return QualityModel(good, bad, tuple(float(v) for v in _logistic(np.array([r["x"] for r in got]), y, weight)))


def score(text: Column, model: QualityModel) -> Column:
    """Probability that label 1 fits a whole text; a null or empty text scores 0."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scales = Scales(model.good, model.bad)
        w = np.array(model.weights)
        for batch in batches:
            out = []
            for t in batch:
                b = (t.as_py() or "").encode()
                if not b:
                    out.append(0.0)
                    continue
                z = float(w[:-1] @ scales.features(b) + w[-1]) if model.good else float(w[-1])
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(out, pa.float64())

    return run(text)
