"""Benchmark decontamination: latent semantic retrieval by a distributed randomised SVD of TF-IDF passages, then longest-common-subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import width, written
from helixframe.llm.textvec import PLAIN, Lookup, words

#: Words of a passage; texts are searched by two neighbouring passages at a time.
PASSAGE = 24
#: Most words of an item that one query holds; longer items give several.
QUERY = 48
RANK = 64
#: Words that more than these shares of the passages, or of the items, hold take no part in the retrieval, but of items that would lose more than LOST of their words by it; the words of those weigh LEAST at least.
COMMON, COMMON_ITEMS = 0.05, 0.1
LOST, LEAST = 0.5, 1.0
#: Items (and their words) that go to every task; more are searched group by group.
GROUP_ITEMS, GROUP_WORDS = 10_000, 200_000
MATCH = "array<struct<item_id: long, cosine: double, lcs: double, answer: double>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))


@dataclass
class Items:
    """A bounded group of benchmark items: their words by number in ``vocabulary`` (sorted hashes)."""

    ids: list[int]
    words: list[np.ndarray]
    answer: list[int]  # words of the answer, at the end
    vocabulary: np.ndarray
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))

    def telling(self) -> np.ndarray:
        """Whether each word is in few enough of the items to tell them apart (in a small benchmark, all are), or in an item that has few such words."""
        df = np.zeros(len(self.vocabulary))
        for w in self.words:
            df[np.unique(w)] += 1
        few = df <= max(COMMON_ITEMS * len(self.words), 3)
        out = few.copy()
        for u in self.losing(few):
            out[u] = True
        return out

    def losing(self, live: np.ndarray) -> list[np.ndarray]:
        """The distinct words of each item of which more than ``LOST`` are not live."""
        return [u for u in map(np.unique, self.words) if live[u].sum() < (1 - LOST) * len(u)]


def _answer_words(text: str) -> int:
    """Words of an item's answer: what follows a last ``Answer:``, or else its last sentence of three words or more."""
    count = lambda t: len(re.findall(r"[^\W_]+", t))
    marked = re.split(r"(?i)\banswer\s*:", text)
    if len(marked) > 1 and count(marked[-1]):
        return count(marked[-1])
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    tail = 0
    for p in reversed(parts):
        tail += count(p)
        if tail >= 3:
            break
    return tail


def groups(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items with a text that has words, in groups of bounded size by a hash, one in memory at a time; rows with equal id and other texts are items of their own."""
    rows = benchmark.where(f"{id_col} is not null and {text_col} is not null").select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct()
    size = rows.agg(F.count("*").alias("items"), F.sum(F.size(F.split("t", r"\s+"))).alias("words")).first()
    parts = max(1, -(-size["items"] // GROUP_ITEMS), -(-(size["words"] or 0) // GROUP_WORDS))
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64(F.lit("items"), "i", "t"), F.lit(parts)) == part) if parts > 1 else rows
        ids, hashes, answer = [], [], []
        for r in sorted(mine.collect(), key=lambda r: (r["i"], r["t"])):
            for _, _, w in words(pa.array([r["t"]]), letters=PLAIN):
                if len(w.hash):
                    ids.append(r["i"])
                    hashes.append(w.hash)
                    answer.append(min(_answer_words(r["t"]), len(w.hash)))
        if ids:
            vocabulary = np.unique(np.concatenate(hashes))
            yield Items(ids, [np.searchsorted(vocabulary, h) for h in hashes], answer, vocabulary)


def _passages(w, lookup: Lookup):
    """Of the words of a slice: vocabulary numbers, -1 for others; of those inside, their place and passage; of each passage: text, first word, number in its text."""
    first = np.searchsorted(w.doc, np.arange(len(w.per_doc)))
    many = -(-w.per_doc // PASSAGE)
    text = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = first[text] + nth * PASSAGE
    number = lookup.find(w.hash)
    at = np.flatnonzero(number >= 0)
    of_word = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(np.r_[start, len(w.hash)]))
    return number, at, of_word[at], text, start, nth


def _sums(vectors: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Row sums by (ascending) passage."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if len(passage):
        new = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        out[passage[new]] = np.add.reduceat(vectors, new)
    return out


def _gram(items: Items, test: np.ndarray):
    """Parts of T'T test, T the passages' counts of telling terms, with all terms' passage counts and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = test.shape
        total, df, n = np.zeros((d, k)), np.zeros(d), 0
        lookup, telling = Lookup(items.vocabulary), items.telling()
        for b in batches:
            for _, _, w in words(b.column(0), 1 << 20, PLAIN):
                number, at, passage, text, _, _ = _passages(w, lookup)
                n += len(text)
                if not len(at):
                    continue
                number = number[at]
                both = np.unique(number.astype(np.int64) * len(text) + passage)
                df += np.bincount(both // len(text), minlength=d)
                keep = telling[number]
                number, passage = number[keep], passage[keep]
                if not len(number):
                    continue
                y = _sums(test[number], passage, len(text))
                order = np.argsort(number, kind="stable")
                number, passage = number[order], passage[order]
                new = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                total[number[new]] += np.add.reduceat(y[passage], new)
        body = np.c_[total, df].astype(np.float32)
        cut = np.array_split(np.arange(d), 16)
        way = TaskContext.get().partitionId() % 64
        rows = [(k, way, body[c].tobytes()) for k, c in enumerate(cut) if len(c)] + [(-1, way, np.array([n], np.float64).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["at", "way", "body"])

    return run


def _add(t: pa.Table) -> pa.Table:
    at = t.column("at")[0].as_py()
    kind = np.float64 if at < 0 else np.float32
    total = np.zeros(len(t.column("body")[0].as_py()) // kind().itemsize)
    for body in t.column("body"):
        total += np.frombuffer(body.as_py(), kind)
    return pa.table({"at": pa.array([at], pa.int32()), "way": pa.array([0], pa.int32()), "body": pa.array([total.astype(kind).tobytes()], pa.binary())})


def _summed(texts: DataFrame, items: Items, test: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    ddl = "at int, way int, body binary"
    parts = texts.mapInArrow(_gram(items, test.astype(np.float32)), ddl).groupBy("at", "way").applyInArrow(_add, ddl)
    rows = parts.repartition(width(texts.sparkSession), "at").groupBy("at").applyInArrow(_add, ddl).collect()  # a matrix of vocabulary by rank
    got = {r["at"]: r["body"] for r in rows}
    d, k = test.shape
    body = np.zeros((d, k + 1))
    for at, c in enumerate(np.array_split(np.arange(d), 16)):
        if at in got and len(c):
            body[c] = np.frombuffer(got[at], np.float32).reshape(len(c), k + 1)
    n = int(np.frombuffer(got[-1], np.float64)[0]) if -1 in got else 0
    return body[:, :k], body[:, k], n


def fit(texts: DataFrame, items: Items, *, rank: int = RANK, seed: int = 17) -> Items:
    """Adds to a group the idf of its words over all passages of all texts and the leading ``rank`` right singular vectors of the TF-IDF passages.

    Columns are the words of the items: other words add nothing to a cosine
    with an item; words of more than ``COMMON`` of the passages or
    ``COMMON_ITEMS`` of the items weigh nothing, unless an item would lose most
    of its words: one that leaks often makes its own words common, and in a
    corpus of a few passages all words are. The items' own passages are
    rows too, with so much weight that their directions lead: a leak is rare in
    the corpus, and a basis of the corpus alone keeps its frequent words and
    loses those that tell items apart. One pass over the texts gives A'A of a
    random matrix, and from it a randomised (Nystrom) decomposition of A'A.
    """
    d = len(items.vocabulary)
    k = min(rank + 16, d)
    test = np.random.default_rng(seed).standard_normal((d, k))
    z, df, n = _summed(texts, items, test)
    telling, plain = items.telling(), np.log((n + 1) / (df + 1))
    idf = np.where((df > COMMON * n) | ~telling, 0.0, plain)
    for u in items.losing(idf > 0):
        back = u[telling[u] & (df[u] > COMMON * n)]
        if len(back):
            idf[back] = np.maximum(plain[back], LEAST)
            # What no passage holds meets nothing: it must not outweigh what does.
            unseen = u[df[u] == 0]
            idf[unseen] = np.minimum(idf[unseen], idf[back].max())
    items.idf = idf
    live = np.flatnonzero(idf > 0)
    if not len(live):
        items.basis = np.zeros((d, 1))
        return items
    # The random matrix stands behind the weights: A'A (test / idf) = idf T'T test.
    z, test = idf[live, None] * z[live], test[live] / idf[live, None]
    own = np.zeros((d, k))
    behind = np.zeros((d, k))
    behind[live] = test
    for w in items.words:
        u, c = np.unique(w, return_counts=True)
        row = c * idf[u]
        row = row / max(np.linalg.norm(row), 1e-9)
        own[u] += row[:, None] * (row @ behind[u])
    # A corpus without any word of the items adds nothing: the items alone are the rows then.
    lead = np.linalg.norm(z, 2) / max(np.linalg.norm(own, 2), 1e-9)
    z = z + (4 * lead or 1.0) * own[live]
    shift = 1e-8 * np.linalg.norm(z)
    z = z + shift * test
    core = test.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    half = vector / np.sqrt(np.maximum(value, value.max() * 1e-10))
    left = np.linalg.svd(z @ half, full_matrices=False)[0]
    items.basis = np.zeros((d, min(rank, left.shape[1])))
    items.basis[live] = left[:, :rank]
    return items


def lcs(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and of the part of it (some one of that length) that ``one``'s last words have."""
    masks: dict[int, int] = {}
    for k, x in enumerate(one.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(one)) - 1
    v = full
    for x in two.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(one) - v.bit_count(), v


def matches(text: Column, group: Items, *, cosine: float = 0.55, share: float = 0.6, whole: float = 0.8, rare: float = 0.5) -> Column:
    """The items of a group that a whole text holds, as an array of ``item_id, cosine, lcs, answer``.

    A window of two passages whose latent cosine with an item (or a part of it)
    is ``cosine`` or more is checked by words. The item's longest common
    subsequence with the text around the window must cover ``whole`` of its
    words, or ``share`` with as much of the answer; and the text around must
    hold ``rare`` of the item's rarer half. Null and empty texts hold nothing.
    """
    send = (group.ids, group.words, group.answer, group.vocabulary, group.idf.astype(np.float32), group.basis.astype(np.float32))

    @F.arrow_udf(MATCH)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _Search(Items(*send), cosine, share, whole, rare)
        for column in batches:
            out: list[dict] = [{} for _ in range(len(column))]
            for first, _, w in words(column, 1 << 20, PLAIN):
                search.find(w, out, first)
            yield pa.array([[{"item_id": i, "cosine": c, "lcs": r, "answer": a} for i, (c, r, a) in sorted(x.items())] for x in out], _MATCH)

    return run(text)


class _Search:
    def __init__(self, items: Items, cosine: float, share: float, whole: float, rare: float):
        self.items, self.cosine, self.share, self.whole, self.rare = items, cosine, share, whole, rare
        self.vectors = items.idf[:, None].astype(np.float32) * items.basis
        self.lookup, self.live = Lookup(items.vocabulary), items.idf > 0
        self.query, self.offset, rows = [], [], []
        for k, w in enumerate(items.words):
            for at in range(0, len(w), QUERY):
                at = max(0, min(at, len(w) - QUERY))
                self.query.append(k)
                self.offset.append(at)
                rows.append(self.vectors[w[at : at + QUERY]].sum(axis=0))
        q = np.array(rows)
        self.matrix = (q / np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]).T.copy()
        self.rarer = []
        for w in items.words:
            u = np.unique(w)
            self.rarer.append(frozenset(u[np.argsort(-items.idf[u], kind="stable")[: max(1, len(u) // 2)]].tolist()))

    def find(self, w, out: list[dict], first: int) -> None:
        every, at, passage, text, start, nth = _passages(w, self.lookup)
        keep = self.live[every[at]]
        at, passage = at[keep], passage[keep]
        if not len(at):
            return
        v = _sums(self.vectors[every[at]], passage, len(text))
        last = np.r_[text[1:] != text[:-1], True]
        v[~last] += v[1:][~last[:-1]]
        use = np.flatnonzero(~last | (nth == 0))  # the last passage alone only if it is the first
        v = v[use]
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        begin = np.searchsorted(w.doc, np.arange(len(w.per_doc)))
        for a in range(0, len(use), 4096):
            near = v[a : a + 4096] @ self.matrix
            for p, q in zip(*np.nonzero(near >= self.cosine), strict=True):
                at = use[a + p]
                doc, item = int(text[at]), self.query[q]
                have = out[first + doc]
                key, size = self.items.ids[item], len(self.items.words[item])
                lo = max(begin[doc], start[at] - self.offset[q] - PASSAGE)
                hi = min(begin[doc] + w.per_doc[doc], start[at] - self.offset[q] + max(size, QUERY) + 3 * PASSAGE)
                around = every[lo:hi]
                around = around[around >= 0]
                if len(self.rarer[item].intersection(around.tolist())) < self.rare * len(self.rarer[item]):
                    continue
                covered, left = lcs(self.items.words[item], around)
                tail = self.items.answer[item]
                answer = 1 - ((left >> (size - tail)).bit_count() / tail) if tail else 1.0
                if covered >= self.whole * size or covered >= self.share * size and answer >= self.share:
                    have[key] = max(have.get(key, (0.0, 0.0, 0.0)), (float(near[p, q]), covered / size, answer), key=lambda x: (x[1], x[0]))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answer)``, a row for each item that a row of ``docs`` holds.

    Rows with equal or null ids are searched each for itself. Without items or
    documents there are no rows. A benchmark of several groups is searched one
    group at a time: a pass over the texts to fit and one to search, each.
    """
    texts = docs.select(F.col(id_col), F.col(text_col).alias("t"))
    found = None
    for group in groups(benchmark):
        m = F.explode(matches(F.col("t"), fit(texts.select("t"), group)))
        one = texts.select(F.col(id_col), m.alias("m")).select(id_col, "m.*")
        found = one if found is None else written(found.unionByName(one), "leaks")
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id long, cosine double, lcs double, answer double")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; null and empty texts stay."""
    kept = docs
    for nth, group in enumerate(groups(benchmark)):
        kept = written(kept, "clean") if nth else kept
        kept = kept.where(F.size(matches(F.col(text_col), fit(docs.select(text_col), group))) == 0)
    return kept
