"""Near-duplicate documents: consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import components, written
from helixframe.llm.textvec import Words, mix64, shingles, words

#: Slots of the word document-frequency table that every task gets: a fixed megabyte.
SLOTS = 1 << 18
#: Hashes a document is judged by when documents that share too little are set aside.
SKETCH = 32
#: Documents compared in one task at once: a block against a block.
BLOCK = 100
#: What a shingle's repeats add: a shingle seen tf times weighs 1 + REPEAT * ln(tf).
REPEAT = 0.25
_GOLDEN = 0x9E3779B97F4A7C15


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def word_df(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every word, by hash slot, and the number of documents; over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            n += len(b)
            for _, _, w in words(b.column(0)):
                both = w.doc * SLOTS + (w.hash & np.uint64(SLOTS - 1)).astype(np.int64)
                both.sort()
                if len(both):
                    both = both[np.r_[True, both[1:] != both[:-1]]]
                    df += np.bincount(both & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], names=["slot", "n"])

    # SLOTS + 1 rows at most, as Arrow: pickled rows take the driver some 100 MB.
    got = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS + 1, np.int64)
    df[got.column("slot").to_numpy()] = got.column("n").to_numpy()  # the number of documents, slot -1, comes last
    return df[:SLOTS], int(df[SLOTS])


def weights(df: np.ndarray, n: int, damp: float) -> np.ndarray:
    """Inverse document frequency a slot, from 1 down to ``1 - damp`` for a word of every document.

    Damped, so that one large group of copies, whose own words are frequent
    because of it, is not pulled apart by the few words its members differ in.
    """
    return (1 - damp * (np.log(np.maximum(df, 1)) / np.log(max(n, 2))) ** 2).astype(np.float32)


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    place = mix64((np.arange(len(w.doc)) - np.searchsorted(w.doc, w.doc)).astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(1))
    out = []
    for salt in (0x51, 0xA7):
        run = np.zeros(len(w.doc) + 1, np.uint64)
        np.cumsum(mix64(w.hash ^ (place + np.uint64(salt))), out=run[1:])
        ends = np.cumsum(w.per_doc)
        out.append(run[ends] - run[ends - w.per_doc])
    return out[0], out[1] + w.per_doc.astype(np.uint64)


def _sketch(buckets: int):
    """Rows for each slice of texts: its distinct sampled shingle hashes by bucket, and one header that says whose they are.

    A text of n distinct shingles is judged by those whose hash falls in its
    1/2^e share (SKETCH to 2 * SKETCH of them expected, all if fewer than that)
    and shows twice that share, as a text of 0.8 times or 1.25 times its length
    may be judged by twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = _ids(b.column(0))
            for first, end, w in words(b.column(1)):
                nth += 1
                m = end - first
                doc, h = shingles(w)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                if len(h):
                    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                    doc, h = doc[new], h[new]
                n = np.bincount(doc, minlength=m)
                e = np.maximum(np.floor(np.log2(np.maximum(n, 1) / SKETCH)), 0).astype(np.uint64)
                low = h & np.uint64(0xFFFFFF)
                shown = (low & ((np.uint64(1) << (np.maximum(e, 1) - np.uint64(1))) - np.uint64(1))[doc]) == 0
                doc, h = doc[shown], h[shown]
                judged = (h & np.uint64(0xFFFFFF) & ((np.uint64(1) << e) - np.uint64(1))[doc]) == 0
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
                size = np.diff(np.r_[at, len(h)])
                shared = np.repeat(size > 1, size)
                total = np.where(w.per_doc > 0, np.bincount(doc[judged], minlength=m), -1)
                known = np.bincount(doc[judged & shared], minlength=m)
                owner = np.where((size == 1) & judged[at], doc[at], -1) if len(h) else np.zeros(0, np.int64)
                u = h[at] if len(h) else h
                where = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                one, two = _sequence(w)
                cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(u) else np.zeros(0, int)
                stop = np.r_[cut[1:], len(u)] if len(u) else cut
                head = np.stack([ids[first:end], total, known, one.view(np.int64), two.view(np.int64)]).astype(np.int64)
                rows = [(int(where[a]), nth, int(a), u[a:z].tobytes(), None, None) for a, z in zip(cut, stop, strict=True)]
                rows.append((nth % buckets, nth, -1, None, head.tobytes(), owner.astype(np.int32).tobytes()))
                yield _batch(rows, _SKETCH)

    return run


_SKETCH = (("bucket", pa.int32()), ("slice", pa.int64()), ("at", pa.int32()), ("hashes", pa.binary()), ("head", pa.binary()), ("owner", pa.binary()))
_SKETCH_DDL = "bucket int, slice long, at int, hashes binary, head binary, owner binary"


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], names=[n for n, _ in schema])


def _meet(t: pa.Table) -> pa.Table:
    """Of one bucket: for each slice, a bit a hash that some other slice holds too. Headers pass."""
    rows, parts = [], []
    for s, at, h, head, owner in zip(*(t.column(c).to_pylist() for c in ("slice", "at", "hashes", "head", "owner")), strict=True):
        if at < 0:
            rows.append((0, s, at, None, head, owner))
        else:
            parts.append((s, at, np.frombuffer(h, np.uint64)))
    if parts:
        every = np.concatenate([p[2] for p in parts])
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for s, at, h in parts:
            found = np.zeros(len(h), bool)
            if len(twice):
                place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
                found = twice[place] == h
            if found.any():
                rows.append((0, s, at, np.flatnonzero(found).astype(np.int32).tobytes(), None, None))
    return pa.Table.from_batches([_batch(rows, _SKETCH)])


def _judge(share: float):
    def run(t: pa.Table) -> pa.Table:
        """Of one slice: the texts with words, and whether at least ``share`` of their judged hashes are in another text."""
        parts, head, owner = [], None, None
        for at, h, hd, ow in zip(*(t.column(c).to_pylist() for c in ("at", "hashes", "head", "owner")), strict=True):
            if at < 0:
                head, owner = np.frombuffer(hd, np.int64).reshape(5, -1), np.frombuffer(ow, np.int32)
            else:
                parts.append(np.frombuffer(h, np.int32) + at)
        ids, total, known, one, two = head
        if parts:
            whose = owner[np.concatenate(parts)]
            known = known + np.bincount(whose[whose >= 0], minlength=len(ids))
        text = total >= 0
        return pa.table({"i": ids[text], "h1": one[text], "h2": two[text], "on": (known >= share * total)[text]})

    return run


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


def icws(h: np.ndarray, w: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Improved consistent weighted samples: ``(texts, k)`` hashes of (shingle, step).

    ``h``, ``w``: shingle hashes and weights of all texts one after another;
    ``ends``: where each (non-empty) text ends. r and c are Gamma(2, 1) and beta
    uniform, drawn from the hash of shingle and sample number.
    """
    gamma = _gamma_quantiles()
    r_of, log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    log_w = np.log(w).astype(np.float32)
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    out = np.zeros((len(ends), k), np.uint64)
    for j in range(k):
        x = (h + np.uint64((_GOLDEN * (2 * j + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        r = r_of[(x >> np.uint64(48)).astype(np.int64)]
        c = log_c[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
        step = np.floor(log_w / r + beta)
        a = c - r * (step - beta) - r
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        text = np.searchsorted(ends, hit, "right")
        # A tie (equal floats) goes to the larger hash, whatever the order of the shingles.
        value = mix64(h[hit] ^ (step[hit].astype(np.int64).astype(np.uint64) * np.uint64(_GOLDEN)))
        np.maximum.at(out[:, j], text, value)
    return out


def _weigh(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, weight, feature levels)`` of each text's distinct shingles: (1 + REPEAT ln tf) times the mean idf of the words."""
    n = len(w.hash)
    doc, h = shingles(w)
    each = idf[(w.hash & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.float64)
    run = np.r_[0.0, np.cumsum(each)]
    # Mean idf of the words of each shingle, in the order shingles() returns them.
    first = np.searchsorted(w.doc, doc) + (np.arange(len(doc)) - np.searchsorted(doc, doc))
    length = np.minimum(w.per_doc[doc], 5)
    mean = (run[np.minimum(first + length, n)] - run[first]) / np.maximum(length, 1)
    order = np.lexsort((h, doc))
    doc, h, mean = doc[order], h[order], mean[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, int)
    tf = np.diff(np.r_[new, len(h)])
    steps = np.maximum(np.rint(mean[new] * 255), 1).astype(np.uint8)
    return doc[new], h[new], steps, tf


def _features(h: np.ndarray, steps: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted set whose Jaccard similarity is the weighted one: a shingle's j-th occurrence adds REPEAT * ln(j / (j - 1))."""
    nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf) + 1
    gain = np.where(nth == 1, 1.0, REPEAT * np.log(nth / np.maximum(nth - 1, 1)))
    return mix64(np.repeat(h, tf) + nth.astype(np.uint64)), (np.repeat(steps, tf) * gain / 255).astype(np.float32)


def _samples(idf: np.ndarray, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids(b.column(0))
            for first, end, w in words(b.column(1)):
                doc, h, steps, tf = _weigh(w, idf)
                if not len(h):
                    continue
                at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                ends = np.r_[at[1:], len(doc)]
                weight = (1 + REPEAT * np.log(tf)) * steps / 255
                got = icws(h, weight, ends, bands * rows)
                keys = np.zeros((len(ends), bands), np.uint64)
                for k in range(rows):
                    keys = mix64(keys + got[:, k::rows] + np.uint64(k + 1))
                keys = mix64(keys + np.arange(bands, dtype=np.uint64) * np.uint64(_GOLDEN)).view(np.int64)
                out = []
                for k, (a, z) in enumerate(zip(at, ends, strict=True)):
                    f, g = _features(h[a:z], steps[a:z], tf[a:z])
                    out.append((int(ids[first + doc[a]]), keys[k].tolist(), f.tobytes(), g.tobytes()))
                yield _batch(out, _SAMPLE)

    return run


_SAMPLE = (("i", pa.int64()), ("keys", pa.list_(pa.int64())), ("f", pa.binary()), ("g", pa.binary()))
_SAMPLE_DDL = "i long, keys array<long>, f binary, g binary"


def similar(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], width: int = 1 << 15) -> np.ndarray:
    """Weighted Jaccard similarity of every left set with every right one, by products of ``width`` features at a time."""
    both = left + right
    total = np.array([g.sum(dtype=np.float64) for _, g in both])
    f = np.concatenate([x for x, _ in both])
    g = np.concatenate([x for _, x in both])
    row = np.repeat(np.arange(len(both)), [len(x) for x, _ in both])
    order = np.argsort(f, kind="stable")
    f, g, row = f[order], g[order], row[order]
    new = np.r_[True, f[1:] != f[:-1]] if len(f) else np.zeros(0, bool)
    size = np.diff(np.r_[np.flatnonzero(new), len(f)])
    keep = np.repeat(size > 1, size)
    g, row, col = g[keep], row[keep], (np.cumsum(new[keep]) - 1 if keep.any() else np.zeros(0, int))
    meet = np.zeros((len(left), len(right)))
    most = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, most, width):
        lo, hi = np.searchsorted(col, (a, a + width))
        x = np.zeros((len(both), min(width, most - a)), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = np.sqrt(g[lo:hi])
        meet += x[: len(left)] @ x[len(left) :].T
    return meet / np.maximum(total[: len(left), None] + total[None, len(left) :] - meet, 1e-12)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links ``a[k] - b[k]`` join, one fewer than nodes in each part."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _sets(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(f, np.uint64), np.frombuffer(g, np.float32)) for f, g in zip(t.column("f").to_pylist(), t.column("g").to_pylist(), strict=True)]


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})


def _verify(threshold: float):
    """A spanning forest of the similar pairs of two sides of a group: all rows, or ``side`` 0 against ``side`` 1."""

    def run(t: pa.Table) -> pa.Table:
        ids, side, sets = _ids(t.column("i").combine_chunks()), t.column("side").to_numpy(), _sets(t)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return _edges([])
        # float32 sums err by less than this; such pairs count as similar.
        x, y = np.nonzero(similar([sets[k] for k in left], [sets[k] for k in right]) >= threshold - 1e-5)
        return _edges(forest(ids[left[x]], ids[right[y]]))

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 20, rows: int = 4, damp: float = 0.2) -> DataFrame:
    """``(doc_id, class_id)``, a row per row of ``docs``: classes joined by weighted Jaccard similarity of ``threshold`` or more.

    Shingles are runs of five words (split at white space, A-Z as a-z); a text
    of one to four words is one shingle. A shingle weighs (1 + REPEAT ln tf) times the
    mean inverse document frequency of its words over all documents.

    1. Each slice of texts shows a sample of its distinct shingle hashes to
       hash buckets, which answer which of them another slice holds; a text
       under half of whose judged hashes is elsewhere has no similar partner. A
       passage that all texts share costs a hash a slice.
    2. Texts with equal word sequences fall together, whatever 1 says of them;
       one of them goes on, if 1 leaves it a partner.
    3. Consistent weighted samples, ``bands`` of ``rows`` (a pair at 0.8 is
       missed in 3 cases of 100,000); texts of a bucket are joined through
       its smallest id, which gives clusters to check.
    4. A cluster of up to ``BLOCK`` texts or so is compared by exact weighted
       Jaccard at once. A larger one is cut in blocks: its first text meets each
       block, and texts unlike that one meet all blocks. So a cluster of near
       copies moves about twice, and no link between any two texts is left out
       but where both ends are joined to the first text already. Only edges of a
       spanning forest leave a task; no bucket is capped.

    The large joins are merge joins at every size: none broadcasts a side that
    grows with the documents.

    ``class_id`` is the smallest id of the class. A null id has a null class;
    rows with equal ids are one document; null texts and texts without words
    are alone in their class; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    df, n = word_df(base.select("t"))
    idf = weights(df, n, damp)
    # A bucket gets some 200,000 hashes; there are as many as that takes.
    total = int(df.sum())
    buckets = int(min(max(256, total // 1_000_000), 1 << 20))
    named = base.where("i is not null and t is not null")
    shown = named.mapInArrow(_sketch(buckets), _SKETCH_DDL)
    met = shown.groupBy("bucket").applyInArrow(_meet, _SKETCH_DDL)
    known = written(met.groupBy("slice").applyInArrow(_judge(threshold * 0.6), "i long, h1 long, h2 long, on boolean"), "dedup-known")

    first = known.groupBy("h1", "h2").agg(F.min("i").alias("rep"), F.max("i").alias("top"), F.max("on").alias("on")).where("on or rep < top")
    # Written, so that its exchange is not that of the rows: a text with very many copies can be split in the join.
    first = written(first.select("h1", "h2", "rep", "on"), "dedup-first")
    member = known.select("i", "h1", "h2").join(first.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"]).select("i", "rep")
    reps = first.where("on").select(F.col("rep").alias("i")).distinct()
    sampled = written(named.join(reps.hint("merge"), "i", "left_semi").mapInArrow(_samples(idf, bands, rows), _SAMPLE_DDL), "dedup-samples")

    keyed = sampled.select("i", F.explode("keys").alias("key"))
    low = keyed.groupBy("key").agg(F.min("i").alias("m"), F.max("i").alias("top")).where("m < top").select("key", "m")
    cluster = components(keyed.join(low.hint("merge"), "key").where("i <> m").select(F.col("i").alias("a"), F.col("m").alias("b")))
    size = cluster.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    placed = cluster.join(size, "component").select(F.col("id").alias("i"), F.col("component").alias("c"), "nb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("block"))
    placed = written(sampled.select("i", "f", "g").join(placed.hint("merge"), "i"), "dedup-placed")
    small = placed.where("nb = 1").withColumn("side", F.lit(-1))
    links = small.groupBy("c").applyInArrow(_verify(threshold), "a long, b long")

    # Large clusters: a leader meets every block of its cluster first, so that most texts move once.
    large = placed.where("nb > 1")
    leader = large.where("i = c").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))
    led = large.where("i <> c").withColumn("side", F.lit(1)).unionByName(leader)
    led = written(led.groupBy("c", "block").applyInArrow(_verify(threshold), "a long, b long"), "dedup-led")
    # What is unlike its leader meets all of its cluster, block by block.
    rest = large.where("i <> c").join(led.select(F.col("b").alias("i")).union(led.select(F.col("a").alias("i"))).distinct(), "i", "left_anti")
    rest = written(rest, "dedup-rest")
    many = rest.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("rb"))
    left = rest.join(many, "c").withColumn("ra", F.pmod(F.xxhash64(F.lit(1), "i"), F.col("rb")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))
    right = large.join(many, "c").withColumn("ra", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).withColumn("side", F.lit(1))
    others = left.unionByName(right).groupBy("c", "ra", "block").applyInArrow(_verify(threshold), "a long, b long")
    links = links.unionByName(led).unionByName(others)
    classes = components(links)

    out = member.join(classes, member["rep"] == classes["id"], "left").select("i", F.coalesce("component", "rep").alias("class_id"))
    out = out.groupBy("i").agg(F.min("class_id").alias("class_id"))
    return base.select("i").join(out.hint("merge"), "i", "left").select(F.col("i").alias(id_col), F.coalesce("class_id", "i").alias("class_id"))
