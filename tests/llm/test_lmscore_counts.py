"""The language model's shortcuts give what the plain computations give."""

import types

import numpy as np
import pyarrow as pa

from helixframe.llm import lmscore, textvec

CODES = lmscore.Codes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 0, lmscore.huffman([5, 4, 3, 2, 1, 1, 1]), lmscore.huffman([1] * 256))


def test_counts_of_nodes_follow_from_those_of_symbols():
    symbols = np.random.default_rng(1).integers(0, 7, 500)
    tally = lmscore._Tally([6, 8], (0, 1), CODES.word)
    tally.symbols += np.bincount(symbols, minlength=7)
    tally.settle()
    tally.settle()
    plain = np.zeros((2, 6), np.int64)
    for x in symbols:
        a = CODES.word[0][x]
        for k in range(a, a + CODES.word[1][x]):
            plain[CODES.word[3][k], CODES.word[2][k]] += 1
    assert (tally.n[0] == plain).all()
    tally.refresh()
    assert (tally.mixer.tables[0] == lmscore._stretched(plain)[CODES.word[2]]).all()


def test_log_odds_of_few_and_many_counts():
    a, b = (x.ravel() for x in np.meshgrid([0, 1, 2, 25, 63, 64, 4095, 4096, 10**7], [0, 1, 3, 24, 63, 64, 5000, 10**9]))
    total = a + b
    odds = np.clip(np.rint((np.log(b + 0.4) - np.log(a + 0.4)) * 16), -160, 160) * 4
    plain = np.where(total > 0, odds + 1 + (total > 3) + (total > 24), 0)
    assert (lmscore._stretched(np.stack([a, b])) == plain).all()
    assert (lmscore._stretched(np.stack([a, b]).astype(np.int32)) == plain).all()


def _plain(z, bit, whose, text, token_of_text):
    """One bit after another."""
    segment = token_of_text // lmscore.SEGMENT
    last = {x: segment[text == x].max() for x in set(text.tolist())}
    cost, scale, bend = np.zeros(len(text)), {}, {}
    for x in sorted(last):
        for k in range(last[x] + 1):
            now = scale.get(x, 1.0)
            up = down = 0.0
            for j in np.flatnonzero((text[whose] == x) & (segment[whose] == k)):
                s = now * float(z[j])
                cost[whose[j]] += np.logaddexp(0, -s if bit[j] else s)
                p = 1 / (1 + np.exp(-s))
                up += (bit[j] - p) * float(z[j])
                down += p * (1 - p) * float(z[j]) ** 2
            if k < last[x]:
                bend[x] = bend.get(x, 60.0) + down
                scale[x] = min(max(now + up / bend[x], 0.5), 2.0)
    return cost


def test_refinement_of_short_and_long_texts(monkeypatch):
    monkeypatch.setattr(lmscore, "SEGMENT", 8)
    rng = np.random.default_rng(2)
    for lengths in ([1, 8, 9, 40, 3, 16, 17], [60], [2, 3], [30, 30], [8, 8]):
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.concatenate([np.arange(n) for n in lengths])
        whose = np.repeat(np.arange(len(text)), rng.integers(1, 5, len(text)))
        z = (rng.standard_normal(len(whose)) * 4).astype(np.float32)
        z[::7] = 0
        bit = rng.integers(0, 2, len(whose)).astype(np.int8)
        got = lmscore._refined(z.copy(), types.SimpleNamespace(whose=whose, bit=bit), types.SimpleNamespace(text=text), len(lengths))
        assert np.allclose(got, _plain(z, bit, whose, text, place), rtol=1e-4, atol=1e-4), lengths


def test_refinement_does_not_visit_a_long_text_once_a_segment(monkeypatch):
    seen = []
    take = np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda x: seen.append(len(x)) or take(x))
    w = next(textvec.words(pa.array(["a " * (lmscore.SEGMENT * 20)])))[2]
    n = len(w.hash) + 1
    b = types.SimpleNamespace(whose=np.arange(n), bit=np.zeros(n, np.int8))
    seen.clear()
    lmscore._refined(np.ones(n, np.float32), b, types.SimpleNamespace(text=np.zeros(n, np.int32)), 1)
    assert sum(seen) < 1.5 * n


def _spelled(seed=4):
    """Codes over bytes, and distinct words with many common beginnings, one of them empty of letters, some longer than what is shared."""
    rng = np.random.default_rng(seed)
    texts = {"".join(rng.choice(list("ab\0é"), rng.integers(1, 14))) for _ in range(400)} | {"a", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "aaaaaaa"}
    data = [x.encode() for x in sorted(texts, key=hash)]
    size = np.array([len(x) for x in data])
    end = np.cumsum(size)
    codes = lmscore.Codes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 0, lmscore.huffman([2, 1]), lmscore.huffman(list(range(1, 257))))
    return codes, np.frombuffer(b"".join(data), np.uint8), end - size, end


def test_four_levels_of_a_path_meet_one_block():
    codes = lmscore.Codes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 0, lmscore.huffman([2**k for k in range(12)]), lmscore.huffman([1] * 256))
    symbols = np.tile(np.arange(12), 50)
    one = np.repeat(np.arange(50, dtype=np.uint64), 12)
    b = lmscore.word_bits(codes, symbols, one, one, one)
    for slots in b.slots[1:]:
        assert slots.min() >= 0 and slots.max() < 1 << lmscore.WORD_SLOTS
        at = 0
        for n in b.n:
            block = slots[at : at + n] >> 4
            assert all(len(set(block[k : k + 4])) == 1 for k in range(0, n, 4))
            at += n
    # A context's nodes have a slot each within a block, and each the same for all symbols below.
    node = codes.word[2][b.slots[0]]
    for x in range(50):
        here = np.repeat(one, b.n) == x
        met = dict(zip(node[here].tolist(), b.slots[1][here].tolist(), strict=True))
        assert all(met[k] == s for k, s in zip(node[here].tolist(), b.slots[1][here].tolist(), strict=True))
        for top in range(0, 12, 4):
            path = [met[k] for k in codes.word[2][codes.word[0][0] :][top : top + 4].tolist() if k in met]
            assert len(set(path)) == len(path)


def test_common_beginnings_are_looked_at_once_and_cost_the_same():
    codes, data, start, end = _spelled()
    rng = np.random.default_rng(5)
    tables = [rng.integers(-600, 600, 1 << lmscore.BYTE_SLOTS).astype(np.int16) for _ in range(6)]
    mixer = lmscore.Mixer(tables, lmscore._new_weights(6), (4, 5))
    b = lmscore.byte_bits(codes, data, start, end)
    plain = np.bincount(np.repeat(b.word, b.n), lmscore._cost(lmscore._toward(mixer.odds(b), b.bit)), len(start))
    assert np.allclose(lmscore._prices(codes, mixer, data, start, end), plain, rtol=1e-6)
    assert len(lmscore._prices(codes, mixer, data[:0], start[:0], end[:0])) == 0
    order, common = lmscore._beginnings(data, start, end)
    assert len(lmscore.byte_bits(codes, data, start[order], end[order], common).bit) < 0.7 * len(b.bit)


def test_common_beginnings_teach_as_often_as_they_occur():
    codes, data, start, end = _spelled(6)
    order, common = lmscore._beginnings(data, start, end)
    few = lmscore.byte_bits(codes, data, start[order], end[order], common)
    few.times = np.repeat(lmscore._sharing(common)[np.minimum(few.place, lmscore.SHARED), few.word], few.n)
    tallies = []
    for b in (lmscore.byte_bits(codes, data, start, end), few):
        tally = lmscore._Tally([1 << lmscore.BYTE_SLOTS] * 6, (4, 5))
        for k, slot in enumerate(b.slots):
            tally.count(k, slot, b.bit, b.times)
        tally.refresh()
        tally.seen += tally.mixer.learn(b)
        tallies.append(tally)
    a, b = tallies
    assert all((x == y).all() for x, y in zip(a.n, b.n, strict=True)) and (a.seen == b.seen).all()
    assert np.allclose(a.mixer.weights, b.mixer.weights, atol=1e-6)


def test_counts_travel_in_the_fewest_bytes_that_hold_them():
    for most in (0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62):
        n = np.array([[0, most, 1], [2, 0, most]], np.int64)
        assert (lmscore._received(lmscore._sent(n)).reshape(2, -1) == n).all()
    bodies = [lmscore._sent(np.full((2, 3), x).T.copy().T) for x in (200, 100, 70_000)]
    t = pa.table({"part": pa.array([1] * 3, pa.int32()), "at": pa.array([0] * 3, pa.int32()), "way": pa.array([0] * 3, pa.int32()), "body": pa.array(bodies, pa.binary())})
    got = lmscore._add(t)
    assert len(got) == 1 and (lmscore._received(got.column("body")[0].as_py()) == 70_300).all()
