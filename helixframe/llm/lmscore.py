"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (split at white space, A-Z as a-z) and an end. A token is
coded in bits: one of the ``HEAD`` most frequent training words (seen twice at
least: what is seen once stands for what is not seen), the end and an
escape by a Huffman path; behind an escape its number among the text's escaped
words so far, or its bytes and a space by another path. Each bit is predicted in several contexts (the node alone, behind one
word, behind two, behind the last very frequent word; in a word the node at its place and behind 1, 2, 3, 4 and
6 bytes); contexts are hashed to slots that hold counts of both bits from all
training texts. A hash of the context and of every fourth node of a path names a
block of 16 slots, and some bits of it deal the up to 15 nodes below among them, so
that four bits meet one line of memory. The predictions are mixed in the logistic domain with weights
that a gate (depth, confidence of the contexts) selects; they are learned
online, each slice of texts predicted by what came before it in its task, and
averaged over tasks. In a text, the mix is refined adaptively: a scale on its
log odds follows the bits of the text's earlier segments.

The slot tables have a fixed size. What grows with the corpus are long contexts:
where the hash of the three words before says so (one place in ``RUN``), a run
begins that lasts to the next such place. Runs by context are counted over all
training texts in a table met by joins, and a run costs -ln((c + p) / (n + 1)):
c of the n runs that other training texts have in this context are this one, p
is what the mix gives it. Where a run ends follows from its words, so these are
probabilities again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import width, written
from helixframe.llm.textvec import Lookup, Words, mix64, words

HEAD = 1 << 17
#: log2 of the slots of a table: the model has a fixed size, some 24 MB with 16 bits a slot.
WORD_SLOTS, BYTE_SLOTS = 21, 20
ORDERS = (1, 2, 3, 4, 6)
#: Levels of a path whose slots lie in one block of 16, which is more than the nodes of so many levels.
LEVELS = 4
#: Bytes at the beginning of words that are looked at once for all words that begin so: those of a 64-bit number.
SHARED = 8
#: The most frequent words; the last of them in the text is a context of its own.
MARKS = 256
#: Bytes of text whose bits are mixed at once, and tokens between two refinements of a text.
PIECE, SEGMENT = 64 << 10, 512
RANGES = 32
#: Tokens of a run on average: a power of two.
RUN = 32
#: Tasks whose counts are added up at once.
FAN = 256
_K = np.uint64(0x9E3779B97F4A7C15)
_ODD, _STIR = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def huffman(counts: list[int]) -> tuple[np.ndarray, ...]:
    """``(start, length)`` a symbol and ``(node, bit, place in its block, depth)`` a step of all paths, for counts of two or more symbols; ties by symbol number."""
    heap = [(c, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    n, up = len(counts), {}
    for node in range(n - 1):
        (a, p), (b, q) = heapq.heappop(heap), heapq.heappop(heap)
        up[p], up[q] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, n + node))
    start, length, nodes, bits = [], [], [], []
    for k in range(n):
        path, at = [], k
        while at in up:
            node, bit = up[at]
            path.append((node, bit))
            at = n + node
        start.append(len(nodes))
        length.append(len(path))
        nodes += [x for x, _ in reversed(path)]
        bits += [x for _, x in reversed(path)]
    return _steps(np.array(start), np.array(length), np.array(nodes, np.int32), np.array(bits, np.int8))


@dataclass
class Codes:
    """The two codes, and the head words by hash; symbols are numbered by frequency."""

    head: np.ndarray
    count: np.ndarray  # training counts by symbol; the end's at ``end``
    end: int
    word: tuple
    byte: tuple

    @property
    def escape(self) -> int:
        return self.end + 1

    def __reduce__(self):
        """What tasks get: of the paths only what the rest follows from."""
        bare = [(c[0].astype(np.int32), c[1].astype(np.uint8), c[2].astype(np.int32), np.packbits(c[3])) for c in (self.word, self.byte)]
        return _codes_of, (self.head, self.count, self.end, *bare)


def _codes_of(head: np.ndarray, count: np.ndarray, end: int, *bare: tuple) -> Codes:
    return Codes(head, count, end, *(_steps(s.astype(np.int64), n.astype(np.int64), node, np.unpackbits(bit)[: len(node)].astype(np.int8)) for s, n, node, bit in bare))


def _steps(start: np.ndarray, length: np.ndarray, node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, ...]:
    depth = np.arange(len(node)) - np.repeat(start, length)
    # The node at the top of a block has place 1, those below k have 2 k and 2 k + 1.
    place = np.ones(len(node), np.uint8)
    for level in range(1, LEVELS):
        at = np.flatnonzero(depth % LEVELS == level)
        place[at] = 2 * place[at - 1] + bit[at - 1]
    return start, length, node, bit, place, np.minimum(depth, 11).astype(np.uint8)


class _Paths:
    """Of the bits of some symbols: the place of the step in the code's list of paths (``at``) and the block (``block``); of each block whose (``owner``) and its top node, hashed; of each symbol its ``first`` bit and their number."""

    def __init__(self, code: tuple, symbols: np.ndarray):
        n, first = code[1][symbols], code[0][symbols]
        # Index arrays are of the width numpy indexes by: it would widen narrower ones at each use.
        self.n, self.first = n, np.cumsum(n) - n
        self.at = np.repeat(first - self.first, n)
        self.at += np.arange(len(self.at))
        blocks = (n + (LEVELS - 1)) // LEVELS
        self.owner = np.repeat(np.arange(len(symbols)), blocks)
        above = (np.arange(len(self.owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * LEVELS
        self.top = code[2][first[self.owner] + above].astype(np.uint32) * _ODD
        self.block = np.repeat(np.arange(len(self.owner)), np.minimum(n[self.owner] - above, LEVELS))
        self.place = code[4].take(self.at, mode="wrap")  # steps are in range; this mode does not look

    def slots(self, context: np.ndarray, log2: int) -> np.ndarray:
        """Slots of the bits behind 32-bit contexts, one a symbol."""
        x = context.take(self.owner, mode="wrap")
        x ^= self.top
        x *= _STIR
        x ^= x >> np.uint32(15)
        x *= _ODD
        x >>= np.uint32(32 - log2)
        out = x.astype(np.intp).take(self.block, mode="wrap")
        out ^= self.place
        return out


class Bits:
    """Bits to predict: how many each token or byte has and which is its ``first``, slots in each table, gate without confidence, the bit, and how often it occurs (None: once)."""

    def __init__(self, paths: _Paths, bit, slots, gate):
        self.n, self.first, self.bit, self.slots, self.gate, self.times = paths.n, paths.first, bit, slots, gate, None

    @property
    def whose(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def _short(context: np.ndarray) -> np.ndarray:
    return (mix64(context) >> np.uint64(32)).astype(np.uint32)


def _behind(one: np.ndarray, two: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts of words: behind one word, behind two, behind the last very frequent one."""
    return _short(one), _short(one * _K + mix64(two + np.uint64(1))), _short(mark.astype(np.uint64) + np.uint64(1))


def word_bits(codes: Codes, symbols: np.ndarray, one: np.ndarray, two: np.ndarray, mark: np.ndarray) -> Bits:
    """``one``, ``two``: hashes of the words before each token; ``mark``: the last very frequent word.

    The first slots are the steps of the code's paths; the table beside them is laid out so.
    """
    p = _Paths(codes.word, symbols)
    bit, _, depth = codes.word[3:]
    return Bits(p, bit[p.at], [p.at, *(p.slots(c, WORD_SLOTS) for c in _behind(one, two, mark))], depth[p.at])


def _beginnings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of some words by their first bytes, and how many of these each has in common with the word before (the space behind a word is one of its bytes)."""
    size, key = end - start, np.zeros(len(start), np.uint64)
    for k in range(SHARED):
        key <<= np.uint64(8)
        byte = data[np.minimum(start + k, len(data) - 1)] if len(start) else data[:0]
        key |= np.where(k < size, byte, np.where(k == size, np.uint8(32), np.uint8(0)))
    order = np.argsort(key, kind="stable")
    unlike = key[order][1:] ^ key[order][:-1]
    common = np.zeros(len(start), np.int64)
    for k in range(SHARED):
        common[1:] += unlike >> np.uint64(8 * k) == 0
    return order, common


def _sharing(common: np.ndarray) -> np.ndarray:
    """By place (the last row: any beyond) and word: how many words have the byte that is looked at there, each word's predecessor having ``common`` bytes with it."""
    times = np.ones((SHARED + 1, len(common)), np.int32)
    for k in range(SHARED):
        looked = np.flatnonzero(common <= k)
        times[k, looked] = np.diff(looked, append=len(common))
    return times


def byte_bits(codes: Codes, data: np.ndarray, start: np.ndarray, end: np.ndarray, common: np.ndarray | None = None) -> Bits:
    """The bits of some words and the space behind each; not of a word's first ``common`` bytes, which another word has too.

    Each byte that is looked at has a ``word`` and a ``place`` in it.
    """
    n = end - start + 1
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(np.repeat(start, n) + place, max(len(data) - 1, 0))
    byte = np.where(place == np.repeat(n - 1, n), 32, data[at]).astype(np.int64) if len(word) else np.zeros(0, np.int64)
    looked = np.arange(len(word)) if common is None else np.flatnonzero(place >= np.repeat(common, n))
    p = _Paths(codes.byte, byte[looked])
    place_of = np.minimum(place[looked], 15)
    slots = [p.slots(_short(place_of.astype(np.uint64) + np.uint64(1)), BYTE_SLOTS)]
    context, behind = np.zeros(len(byte), np.uint64), 0
    for order in ORDERS:
        while behind < order:
            behind += 1
            before = np.zeros(len(byte), np.uint64)
            before[behind:] = byte[:-behind] + 1
            before[place < behind] = 0
            context = (context + before + np.uint64(1)) * _K
        slots.append(p.slots(_short(context[looked] + np.uint64(order)), BYTE_SLOTS))
    b = Bits(p, codes.byte[3][p.at], slots, np.repeat(place_of.astype(np.uint8), p.n))
    b.word, b.place = word[looked], place[looked]
    return b


def _prices(codes: Codes, mixer: Mixer, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Natural-log cost of the bytes of each word."""
    order, common = _beginnings(data, start, end)
    start, end = start[order], end[order]
    n, price = len(order), np.zeros(len(order))
    early = np.zeros((SHARED, n))
    for a, z in _parts(n):
        b = byte_bits(codes, data, start[a:z], end[a:z], common[a:z])
        cost = np.add.reduceat(_cost(_toward(mixer.odds(b), b.bit)), b.first, dtype=np.float64) if len(b.word) else np.zeros(0)
        late = b.place >= SHARED
        price[a:z] = np.bincount(b.word[late], cost[late], z - a)
        early[b.place[~late], a + b.word[~late]] = cost[~late]
    for k in range(SHARED):
        # A byte that was not looked at costs what it cost in the word before.
        looked = np.maximum.accumulate(np.where(common > k, 0, np.arange(n)))
        price += np.where(k <= end - start, early[k][looked], 0)
    out = np.empty(n)
    out[order] = price
    return out


_LOGS = np.log(np.arange(1 << 12) + 0.4)


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of int64 counts: log odds in sixteenths times 4, and how sure they are (0 to 3) in the lowest two bits."""
    small = len(_LOGS) - 1
    la, lb = _LOGS[np.minimum(a, small)], _LOGS[np.minimum(b, small)]
    for x, lx in ((a, la), (b, lb)):
        big = np.flatnonzero(x > small)
        lx[big] = np.log(x[big] + 0.4)
    total = a + b
    out = np.clip(np.rint((lb - la) * 16), -160, 160).astype(np.int16) * 4 + (1 + (total > 3) + (total > 24)).astype(np.int16)
    out[total == 0] = 0
    return out


#: Of all pairs of counts under 64, which most slots hold.
_FEW = _packed(*(x.ravel().astype(np.int64) for x in np.divmod(np.arange(1 << 12), 64)))


def _stretched(n: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """:func:`_packed` of ``(2, slots)`` counts, so many at once as stay in a cache."""
    out = np.empty(n.shape[1], np.int16)
    for at in range(0, len(out), most):
        a, b = n[:, at : at + most]
        part = _FEW.take(((a & 63) << 6) + (b & 63), mode="wrap")
        many = np.flatnonzero((a | b) > 63)
        part[many] = _packed(a[many].astype(np.int64), b[many].astype(np.int64))
        out[at : at + most] = part
    return out


class Mixer:
    """Predictions of one kind of bits from its tables, with gated weights.

    ``tables``: packed log odds and sureness. The gate adds the sureness of two tables.
    """

    def __init__(self, tables: list, weights: np.ndarray, sure: tuple[int, int]):
        self.tables, self.weights, self.sure = tables, weights, sure
        self.slope = np.full(weights.shape, 30.0)

    def inputs(self, b: Bits) -> tuple[list[np.ndarray], np.ndarray]:
        v = [np.take(t, s, mode="wrap") for t, s in zip(self.tables, b.slots, strict=True)]  # slots are in range; this mode does not look
        p, q = self.sure
        g = (b.gate.astype(np.int16) << 4) + ((v[p] & 3) << 2) + (v[q] & 3)
        return [x.astype(np.float32) for x in v], g.astype(np.intp)

    def _odds(self, x: list[np.ndarray], g: np.ndarray) -> np.ndarray:
        w = self.weights * np.float32(1 / 64)
        z = w[0].take(g, mode="wrap") * x[0]
        for k in range(1, len(x)):
            z += w[k].take(g, mode="wrap") * x[k]
        return np.clip(z, -14, 14, out=z)

    def odds(self, b: Bits) -> np.ndarray:
        return self._odds(*self.inputs(b))

    def learn(self, b: Bits) -> np.ndarray:
        """One step of the weights along the error of these bits, ever shorter (by the sum of squared steps); returns bits a gate."""
        x, g = self.inputs(b)
        miss = (b.bit - 1 / (1 + np.exp(-self._odds(x, g)))).astype(np.float64)
        if b.times is not None:
            miss *= b.times
        k, size = self.weights.shape
        for i in range(k):
            pull = np.bincount(g, miss * x[i], size) / 64
            self.slope[i] += pull * pull
            self.weights[i] = np.clip(self.weights[i] + 0.25 * pull / np.sqrt(self.slope[i]), -1, 3)
        return np.bincount(g, b.times, minlength=size)


def _new_weights(inputs: int) -> np.ndarray:
    return np.full((inputs, 16 * 16), 1.2 / inputs, np.float32)


def _toward(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Log odds z against the bits: with the sign turned where the bit is 1."""
    return (z.view(np.uint32) ^ (bit.astype(np.uint32) << np.uint32(31))).view(np.float32)


def _cost(s: np.ndarray) -> np.ndarray:
    """Natural-log cost of bits at log odds s against them."""
    e = np.exp(-np.abs(s))
    e += 1
    return np.log(e, out=e) + np.maximum(s, 0)


class _Text:
    """Tokens of a slice: symbols with the ends, the context words before, and the text of each."""

    def __init__(self, codes: Codes, head: Lookup, w: Words, texts: int):
        n = len(w.hash) + texts
        self.end = codes.end
        self.stop = np.cumsum(w.per_doc + 1)  # of each text, the token behind its end
        ends = self.stop - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        self.text = np.repeat(np.arange(texts, dtype=np.int32), w.per_doc + 1)
        symbol = head.find(w.hash)
        self.rare = np.flatnonzero(symbol < 0)  # numbers of words
        symbol[self.rare] = codes.escape
        self.symbol = np.full(n, codes.end)
        self.symbol[inner] = symbol
        self.one = np.zeros(n, np.uint64)
        self.one[1:][inner[:-1]] = w.hash
        first = ends[:-1] + 1
        self.one[first] = 0
        self.two = np.zeros(n, np.uint64)
        self.two[1:] = self.one[:-1]
        self.two[first] = 0
        # The last very frequent word before each token, in its own text.
        here = np.where(self.symbol < MARKS, np.arange(n, dtype=np.int32), -1)
        got = np.r_[np.int32(-1), np.maximum.accumulate(here)[:-1]] if n else here
        self.mark = np.where(got >= np.r_[0, first][self.text], self.symbol[got] + 1, 0) if n else got


    def runs(self, w: Words) -> tuple[np.ndarray, ...]:
        """Of each run: its first token, the token behind its last, its context, its words' hash, and how often its text has the context, and the run in it."""
        n = len(self.symbol)
        at, first = np.arange(n), np.r_[0, self.stop[:-1]][self.text]
        three = np.zeros(n, np.uint64)
        three[1:] = self.two[:-1]
        context = mix64(self.one + mix64(self.two + mix64(three + _K)))
        begin = np.flatnonzero((at - first >= 3) & ((context & np.uint64(RUN - 1)) == 0))
        token = np.ones(n, np.uint64)
        token[self.symbol != self.end] = w.hash
        stop = np.minimum(np.r_[begin[1:], n], self.stop[self.text[begin]])
        place = np.zeros(n, np.uint64)
        place[begin] = 1
        nth = at - np.maximum.accumulate(np.where(place > 0, at, 0))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(token ^ ((nth + 1).astype(np.uint64) * _K)), out=total[1:])
        f = context[begin]
        g = mix64(total[stop] - total[begin] + (stop - begin).astype(np.uint64))
        text = self.text[begin]
        own = []
        for what in (f, mix64(f + mix64(g))):
            order = np.lexsort((what, text))
            new = np.r_[True, (what[order][1:] != what[order][:-1]) | (text[order][1:] != text[order][:-1])][: len(begin)]
            times = np.diff(np.r_[np.flatnonzero(new), len(begin)])
            have = np.empty(len(begin), np.int64)
            have[order] = np.repeat(times, times)
            own.append(have)
        return begin, stop, f, g, own[0], own[1]


class _Rare:
    """Escaped words of a few slices, each distinct one once."""

    def __init__(self):
        self.hash, self.data, self.size, self.bytes = [], [], [], 0

    def add(self, w: Words, at: np.ndarray) -> None:
        h, first = np.unique(w.hash[at], return_index=True)
        at = at[first]
        n = w.end[at] - w.start[at]
        place = np.repeat(w.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.hash.append(h)
        self.data.append(w.data[place])
        self.size.append(n)
        self.bytes += int(n.sum())

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, sorted, with bytes and their starts and ends."""
        if not self.hash:
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        data, size = np.concatenate(self.data), np.concatenate(self.size)
        end = np.cumsum(size)
        h, first = np.unique(np.concatenate(self.hash), return_index=True)
        return h, data, (end - size)[first], end[first]


def _parts(n: int, most: int = 2_500):
    for a in range(0, n, most):
        yield a, min(a + most, n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts (kind 0), bytes of words (1), texts (2)."""
    spelled, texts = np.zeros(256, np.int64), 0
    have: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h, c = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
        order = np.argsort(h)
        h, c = h[order], c[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        return h[new], np.add.reduceat(c, new) if len(new) else c

    def rows(kind, h, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(n)], names=["kind", "h", "n"])

    for b in batches:
        texts += len(b)
        for _, _, w in words(b.column(0)):
            have.append(np.unique(w.hash, return_counts=True))
            solid = np.bincount(w.data, minlength=256)
            spelled += solid
            if sum(len(x) for x, _ in have) > 1_500_000:
                have = [merged()]
                if len(have[0][0]) > 750_000:
                    yield rows(0, have[0][0].view(np.int64), have[0][1])
                    have = []
    if have:
        h, c = merged()
        yield rows(0, h.view(np.int64), c)
    yield rows(1, np.arange(256), spelled)
    yield rows(2, np.zeros(1, np.int64), np.array([texts]))


def _codes(counts: DataFrame, words_total: int, spelled: dict[int, int], texts: int) -> Codes:
    # A histogram of counts, sixteen buckets to a doubling, finds how frequent a head word must be: no sort, and no more than HEAD rows come here.
    bucket = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["b"], r["n"]) for r in counts.where("c > 1").groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    low, room = 1 << 30, HEAD
    for b, n in sizes:
        if n > room:
            break
        low, room = b, room - n
    top = counts.where("c > 1").where(bucket >= low).select("h", "c").toArrow()
    h, c = (np.asarray(top.column(k), np.int64) for k in ("h", "c"))
    order = np.lexsort((h, -c))
    h, c = h[order].view(np.uint64), c[order]
    rest = words_total - int(c.sum())
    bytes_of = [spelled.get(k, 0) + 1 for k in range(256)]
    bytes_of[32] += words_total
    for k in (9, 10, 11, 12, 13):
        bytes_of[k] = 1
    return Codes(h, np.r_[c, texts, 0], len(c), huffman([*c.tolist(), texts + 1, rest + 1]), huffman(bytes_of))


class _Tally:
    """Counts of both bits by slot, in one task, and the mixer that learns beside them."""

    def __init__(self, sizes: list[int], sure: tuple[int, int], code: tuple | None = None):
        """``code``: of a first table met by steps of its paths; the counts of nodes follow from those of symbols."""
        self.code = code
        self.symbols = np.zeros(len(code[0]) if code else 0, np.int64)
        if code:
            start, length, node, bit = code[:4]
            # What is below each bit of a node: symbols, or nodes numbered behind them; and the nodes of each depth, the deepest first.
            last, inner = start + length - 1, np.ones(len(node), bool)
            inner[last] = False
            inner = np.flatnonzero(inner)
            self.below = np.zeros((2, sizes[0]), np.int64)
            self.below[bit[last], node[last]] = np.arange(len(start))
            self.below[bit[inner], node[inner]] = len(start) + node[inner + 1]
            depth = np.full(sizes[0], -1)
            depth[node] = np.arange(len(node)) - np.repeat(start, length)
            self.levels = [np.flatnonzero(depth == k) for k in range(depth.max(), -1, -1)]
        self.n = [np.zeros((s, 2), np.int32).T for s in sizes]  # both counts of a slot lie together
        self.mixer = Mixer([np.zeros(s, np.int16) for s in sizes], _new_weights(len(sizes)), sure)
        self.seen = np.zeros(self.mixer.weights.shape[1])

    def count(self, table: int, slot: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        at = slot << 1
        at += bit
        np.add.at(self.n[table].T.reshape(-1), at, np.int32(1) if times is None else times)

    def settle(self) -> None:
        """Brings the counts of nodes up to those of symbols."""
        if self.code:
            n, first = np.zeros(self.n[0].shape, np.int64), len(self.symbols)
            total = np.r_[self.symbols, np.zeros(n.shape[1], np.int64)]
            for at in self.levels:
                n[:, at] = total[self.below[:, at]]
                total[first + at] = n[0, at] + n[1, at]
            self.n[0] = n

    def refresh(self) -> None:
        self.settle()
        for k, n in enumerate(self.n):
            self.mixer.tables[k] = _stretched(n)
        if self.code:
            self.mixer.tables[0] = self.mixer.tables[0][self.code[2]]


_CHUNK = "part int, at int, way int, body binary"


def _sent(n: np.ndarray) -> bytes:
    """Counts, packed in the fewest bytes each that hold the largest; the first byte says how many."""
    width = next(k for k in (1, 2, 4, 8) if n.max(initial=0) < 1 << (8 * k - (k == 8)))
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + n.astype(f"<u{width}", order="C").tobytes())


def _received(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _train(shared, end: int):
    """``shared``: a broadcast of the codes."""
    sizes = [end + 2, *[1 << WORD_SLOTS] * 3]
    byte_sizes = [1 << BYTE_SLOTS] * (1 + len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        head = Lookup(codes.head)
        of_words, of_bytes, rare = _Tally(sizes, (1, 2), codes.word), _Tally(byte_sizes, (4, 5)), _Rare()

        size, due, early = 0, 1 << 15, True

        def spell():
            """Counts the escaped words at hand, each once."""
            h, data, start, end = rare.words()
            known = of_bytes.n[0].any()
            for a, z in _parts(len(h)):
                order, common = _beginnings(data, start[a:z], end[a:z])
                b = byte_bits(codes, data, start[a:z][order], end[a:z][order], common)
                b.times = np.repeat(_sharing(common)[np.minimum(b.place, SHARED), b.word], b.n)
                if known:
                    of_bytes.seen += of_bytes.mixer.learn(b)
                bit = b.bit.astype(np.intp)
                for k, slot in enumerate(b.slots):
                    of_bytes.count(k, slot, bit, b.times)

        known = False
        for b in batches:
            for first, last, w in words(b.column(0), PIECE):
                t = _Text(codes, head, w, last - first)
                bits = word_bits(codes, t.symbol, t.one, t.two, t.mark)
                if known:
                    of_words.seen += of_words.mixer.learn(bits)
                # The first table counts by node: that follows from the symbols.
                of_words.symbols += np.bincount(t.symbol, minlength=len(of_words.symbols))
                bit = bits.bit.astype(np.intp)
                for k in (1, 2, 3):
                    of_words.count(k, bits.slots[k], bit)
                rare.add(w, t.rare)
                size += len(t.symbol)
                if size > due:
                    # What comes after is predicted by what is counted so far.
                    of_words.refresh()
                    known = True
                    if early or rare.bytes > 8 << 20:
                        spell()
                        of_bytes.refresh()
                        rare, early = _Rare(), False
                    size, due = 0, min(2 * due, 1 << 20)
        spell()
        of_words.settle()
        packer = zstandard.ZstdCompressor(level=1)
        way = TaskContext.get().partitionId()
        rows = []
        for base, tally in ((0, of_words), (10, of_bytes)):
            rows.append((100 + base, 0, way, packer.compress(np.r_[tally.mixer.weights * tally.seen, tally.seen[None]].astype(np.float64).tobytes())))
            for k, n in enumerate(tally.n):
                for at, piece in enumerate(np.array_split(n, RANGES, axis=1)):
                    if piece.any():
                        rows.append((base + k, at, way, _sent(piece)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "at", "way", "body"])

    return run, sizes, byte_sizes


def _add(t: pa.Table) -> pa.Table:
    """The sum of packed arrays, one after another."""
    if len(t) == 1:
        return t
    total, weights = None, t.column("part")[0].as_py() >= 100
    for body in t.column("body"):
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py())) if weights else _received(body.as_py())
        total = x if total is None else total + x
    first = t.slice(0, 1)
    return pa.table({"part": first.column("part"), "at": first.column("at"), "way": first.column("way"), "body": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes()) if weights else _sent(total)], pa.binary())})


def _models(chunks: list, codes: Codes, sizes: list[int], byte_sizes: list[int]) -> tuple[Mixer, Mixer]:
    bodies = {(r["part"], r["at"]): r["body"] for r in chunks}
    out = []
    for base, shape, sure in ((0, sizes, (1, 2)), (10, byte_sizes, (4, 5))):
        tables = []
        for k, size in enumerate(shape):
            pieces = []
            for at, blank in enumerate(np.array_split(np.zeros((2, size), np.int8), RANGES, axis=1)):
                got = bodies.get((base + k, at))
                n = np.zeros(blank.shape, np.int64) if got is None else _received(got).reshape(2, -1)
                pieces.append(_stretched(n))
            tables.append(np.concatenate(pieces))
        if not base:
            tables[0] = tables[0][codes.word[2]]
        weights = _new_weights(len(shape))
        if (100 + base, 0) in bodies:
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(bodies[100 + base, 0])).reshape(len(shape) + 1, -1)
            seen = got[-1]
            weights = np.where(seen > 0, (got[:-1] + 16 * weights) / (seen + 16), weights).astype(np.float32)
        out.append(Mixer(tables, weights, sure))
    return out[0], out[1]


def _refined(z: np.ndarray, b: Bits, t: _Text, texts: int) -> np.ndarray:
    """Natural-log cost of each token's bits, their log odds scaled by what the text's earlier segments call for."""
    # Each token has a bit at least.
    whole = b.first if isinstance(b, Bits) else np.flatnonzero(np.r_[True, b.whose[1:] != b.whose[:-1]])
    against = _toward(z, b.bit)
    ends = np.cumsum(np.bincount(t.text, minlength=texts))
    tokens = np.diff(ends, prepend=0)
    long = np.flatnonzero(tokens > SEGMENT)
    if not len(long):
        return np.add.reduceat(_cost(against), whole, dtype=np.float64)
    # Bits stand in the order of the texts: what lies between long texts is one run of bits, a segment of a long one another.
    edge, cost, done = np.r_[whole, len(z)], np.empty(len(z), np.float32), 0
    for x in long:
        first = edge[ends[x] - tokens[x]]
        cost[done:first] = _cost(against[done:first])
        scale, bend = np.float32(1), 60.0
        cuts = edge[np.r_[np.arange(ends[x] - tokens[x], ends[x], SEGMENT), ends[x]]]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            s = against[a:e] * scale
            odds = np.exp(-np.abs(s))
            more = odds + 1
            cost[a:e] = np.log(more) + np.maximum(s, 0)
            if e < cuts[-1]:
                # The probability of the other bit is that of s; the error along z and its bend, miss (1 - miss) s s, follow from it.
                miss = np.where(s > 0, np.float32(1), odds)
                miss /= more
                miss *= s
                pull = -float(np.add.reduce(miss)) / scale
                bend += float(np.einsum("i,i->", miss, s - miss)) / (scale * scale)
                scale = np.float32(min(max(scale + pull / bend, 0.5), 2.0))
        done = cuts[-1]
    cost[done:] = _cost(against[done:])
    return np.add.reduceat(cost, whole, dtype=np.float64)


def _escaped(doc: np.ndarray, hashes: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Natural-log cost of each escaped word of some texts, in order.

    A bit says whether the text had the word before, predicted by how often
    such bits were set so far in the text; then follows its number among the
    text's escaped words, or its bytes.
    """
    n = len(doc)
    order = np.lexsort((hashes, doc))
    new = np.ones(n, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    fresh = np.zeros(n, bool)
    fresh[order[new]] = True
    start = np.searchsorted(doc, doc)
    before = np.arange(n) - start
    run = np.r_[0, np.cumsum(fresh)]
    known = run[:-1] - run[start]  # distinct words so far
    again = (before - known + 0.3) / (before + 3.0)
    return np.where(fresh, price - np.where(known > 0, np.log1p(-again), 0), np.log(np.maximum(known, 1)) - np.log(again))


_SCORED = (("i", pa.int64()), ("key", pa.int64()), ("h", pa.int64()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()), ("bytes", pa.int64()), ("held", pa.bool_()), ("f", pa.int64()), ("g", pa.int64()), ("cost", pa.float32()), ("own_f", pa.int32()), ("own_g", pa.int32()))
_SCORED_DDL = "i long, key long, h long, tf long, n_tokens long, known long, base double, bits double, bytes long, held boolean, f long, g long, cost float, own_f int, own_g int"


def _score(shared, model):
    """``shared``, ``model``: broadcasts of the codes and the mixers. A row a text with what the mix gives; a row for each escaped word of a text, and for each of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (of_words, of_bytes) = shared.value, model.value
        head = Lookup(codes.head)
        key = TaskContext.get().partitionId() << 33
        log = np.log10(codes.count + 1.0)
        waiting: list[tuple] = []
        rare = _Rare()

        def flush():
            h, data, start, end = rare.words()
            price = _prices(codes, of_bytes, data, start, end)
            for cols, doc, hashes, cost, at, (begin, stop, f, g, own_f, own_g), text in waiting:
                cost[at] += _escaped(doc, hashes, price[np.searchsorted(h, hashes)])
                cols["bits"] = np.bincount(text, cost, len(cols["key"])) / np.log(2)
                yield batch(cols)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, int)
                yield batch({"key": cols["key"][doc[new]], "h": hashes[new].view(np.int64), "tf": np.diff(np.r_[new, len(doc)])})
                run = np.r_[0.0, np.cumsum(cost)]
                whose = text[begin]
                yield batch({"key": cols["key"][whose], "held": cols["held"].take(pa.array(whose)), "f": f.view(np.int64), "g": g.view(np.int64), "cost": (run[stop] - run[begin]).astype(np.float32), "own_f": own_f, "own_g": own_g})

        def batch(cols):
            n = len(cols["key"])
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in _SCORED], names=[c for c, _ in _SCORED])

        for b in batches:
            ids, held = b.column(1).cast(pa.int64()), b.column(2)
            size = pa.compute.binary_length(b.column(0)).fill_null(0)
            for first, last, w in words(b.column(0), PIECE):
                n = last - first
                t = _Text(codes, head, w, n)
                bits = word_bits(codes, t.symbol, t.one, t.two, t.mark)
                cost = _refined(of_words.odds(bits), bits, t, n)
                sure = t.symbol != codes.escape
                cols = {
                    "i": ids.slice(first, n), "key": key + np.arange(n), "n_tokens": w.per_doc + 1, "known": np.bincount(t.text[sure & (codes.count[t.symbol] > 0)], minlength=n),
                    "base": np.bincount(t.text[sure], log[t.symbol[sure]], n), "bytes": size.slice(first, n).cast(pa.int64()), "held": held.slice(first, n),
                }
                key += n
                rare.add(w, t.rare)
                place = t.rare + w.doc[t.rare]  # of a word among the tokens: an end stands behind each text before
                waiting.append((cols, w.doc[t.rare], w.hash[t.rare], cost, place, t.runs(w), t.text))
                if rare.bytes > 4 << 20:
                    yield from flush()
                    waiting, rare = [], _Rare()
        yield from flush()

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, a row per row of ``docs``.

    Learns from the rows whose ``held_col`` is not true, all of them, and scores
    all rows, whole texts. ``score`` is the model's log10 probability of the
    tokens, ``base_score`` the add-one unigram one. Word counts and runs of
    training tokens are tables that grow with the corpus, met by joins; only the
    head (``HEAD`` words) and slot tables of fixed size go to every task. A text
    of the training rows is not among those that its own runs are held against.
    A word is known by a 64-bit hash.

    A null text is empty (an end alone); a null ``held_col`` counts as not held
    out; null and repeated ids are kept as they are; without training rows the
    model knows nothing and all bits cost as in an untrained mix. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).cast("long").alias("i"), F.coalesce(held_col, F.lit(False)).alias("held"))
    train = rows.where("not held").select("t")
    counted = written(train.mapInArrow(_count, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("c")), "lm-counts")
    counts = counted.where("kind = 0")
    got = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    small = counted.where("kind > 0").collect()
    texts = sum(r["c"] for r in small if r["kind"] == 2)
    n_words, n_types = int(got["n"] or 0), int(got["v"])
    codes = _codes(counts, n_words, {r["h"]: r["c"] for r in small if r["kind"] == 1}, texts)

    shared = spark.sparkContext.broadcast(codes)
    run, sizes, byte_sizes = _train(shared, codes.end)
    # Sums of so many tasks each, then of so many sums: no group grows with the corpus.
    chunks = train.mapInArrow(run, _CHUNK)
    for fan in (FAN, FAN**2, FAN**4):
        chunks = chunks.withColumn("way", F.expr(f"cast(way div {fan} * {fan} as int)")).repartition(width(spark), "part", "at", "way").groupBy("part", "at", "way").applyInArrow(_add, _CHUNK)
    model = spark.sparkContext.broadcast(_models(chunks.collect(), codes, sizes, byte_sizes))

    scored = written(rows.mapInArrow(_score(shared, model), _SCORED_DDL), "lm-scored")
    rare = scored.where("h is not null").select("key", "h", "tf").join(counts.select("h", "c").hint("merge"), "h", "left")
    rare = rare.select("key", (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known_more"), F.lit(0.0).alias("gain"))

    runs = scored.where("f is not null").select("key", "f", "g", "cost", F.when(F.col("held"), 0).otherwise(F.col("own_f")).alias("own_f"), F.when(F.col("held"), 0).otherwise(F.col("own_g")).alias("own_g"), "held")
    seen = runs.where("not held").groupBy("f", "g").agg(F.count("*").alias("c"))
    often = seen.groupBy("f").agg(F.sum("c").alias("n"))
    met = runs.join(often.hint("merge"), "f").where("n > own_f").join(seen.hint("merge"), ["f", "g"], "left")
    n_other, c_other = F.col("n") - F.col("own_f"), F.coalesce("c", F.lit(0)) - F.col("own_g")
    gain = F.when(c_other > 0, F.col("cost") + F.log(c_other + F.exp(-F.col("cost").cast("double")))).otherwise(0.0) - F.log(n_other + 1.0)
    met = met.select("key", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("known_more"), gain.alias("gain"))

    more = rare.unionByName(met).groupBy("key").agg(F.sum("more").alias("more"), F.sum("known_more").alias("known_more"), F.sum("gain").alias("gain"))
    n, v = n_words + texts, n_types + (texts > 0)
    out = scored.where("h is null and f is null").select("i", "key", "held", "n_tokens", "known", "base", "bits", "bytes").join(more, "key", "left")
    bits = F.col("bits") - F.coalesce("gain", F.lit(0.0)) * F.lit(float(1 / np.log(2)))
    return out.select(
        F.col("i").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        (bits / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
