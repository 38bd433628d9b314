"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common, decontam, hosttext, itq, langid, license, lmscore, minhash, mixing, quality, queries, textvec, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, i long, t string, rep long"


def prose(seed, n, stock="abcdefghijklmnop"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(stock) for _ in range(r.randint(2, 7))) for _ in range(n))


def docs(spark, rows):
    """``(id, text, lang, source)`` with columns whose names clash with inner ones."""
    return spark.createDataFrame([(a, b, c, d, len(b or ""), 1, "x", 2) for a, b, c, d in rows], DOC)


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def classes(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return [root(x) for x in range(n)]


# --- 1 -----------------------------------------------------------------------------------------


def weighted_sets(texts, damp=0.2):
    """Plain weighted shingle sets, as the operator defines them."""
    words = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    df = collections.Counter(w for x in words for w in set(x))
    n = len(texts)
    idf = {w: 1 - damp * (math.log(c) / math.log(max(n, 2))) ** 2 for w, c in df.items()}
    out = []
    for x in words:
        runs = [tuple(x[k : k + 5]) for k in range(len(x) - 4)] or ([tuple(x)] if x else [])
        tf = collections.Counter(runs)
        out.append({s: (1 + minhash.REPEAT * math.log(c)) * max(1, round(255 * sum(idf[w] for w in s) / len(s))) / 255 for s, c in tf.items()})
    return out


def jaccard(a, b):
    low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


@pytest.mark.parametrize("block", [100, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = [prose(k, 120) for k in range(4)]
    texts = base + [edited(base[0], k, 2) for k in range(6)] + [base[1]] * 3 + [base[1].upper(), "two words", "Two  Words", "", None, prose(9, 6000), " ".join(base[2].split() + base[3].split()), "la " * 40, "la " * 44]
    texts += [edited(edited(base[0], 1, 2), k, 8) for k in (21, 22)] + [edited(base[0], k, 5) for k in range(30, 42)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = weighted_sets(texts)
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    assert got == dict(enumerate(classes(len(texts), links)))
    assert got[1] == got[10] == got[13] and got[14] == got[15] and got[16] == 16 and got[17] == 17


def test_copies_of_texts_that_repeat_themselves_meet(spark):
    texts = ["".join(prose(700 + 9 * k + j, 8) + "\n" for j in range(1 + k % 5)) * 60 for k in range(30)] + [(prose(9000 + k, 1) + " ") * 300 for k in range(20)]
    rows = [(100 * c + k, x, "en", "s") for k, t in enumerate(texts) for c, x in enumerate((t, t, t + t[: len(t) // 20]))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = dict(zip((k for k, *_ in rows), weighted_sets([t for _, t, _, _ in rows]), strict=True))
    near = [k for k in range(50) if jaccard(sets[k], sets[200 + k]) >= 0.8]
    assert len(near) > 30 and all(got[k] == got[100 + k] == k for k in range(50)) and all(got[200 + k] == k for k in near)


def test_copies_meet_whatever_the_filter_says(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_judge", lambda share, judge=minhash._judge: judge(2.0))
    rows = [(k, prose(k % 5, 80), "en", "s") for k in range(10)] + [(20, "", "en", "s"), (21, None, "en", "s"), (22, " ", "en", "s")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {k: k % 5 for k in range(10)} | {20: 20, 21: 21, 22: 22}


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(docs(spark, [])).collect() == []
    t = prose(1, 50)
    got = minhash.near_duplicates(docs(spark, [(None, t, None, None), (None, None, None, None), (7, t, None, None), (7, t, None, None), (3, t, None, None)])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"]) == [(3, 3), (7, 3), (7, 3)] and sum(r["class_id"] is None for r in got) == 2


def test_large_cluster_is_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = prose(5, 100)
    rows = [(k, edited(base, k, 1), "en", "s") for k in range(23)] + [(99, prose(6, 100), "en", "s")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert set(got[k] for k in range(23)) == {0} and got[99] == 99


def test_consistent_samples_meet_as_often_as_the_similarity():
    r = np.random.default_rng(0)
    h = textvec.mix64(np.arange(1, 401, dtype=np.uint64))
    w = r.uniform(0.5, 3, 400)
    a, b = np.arange(300), np.arange(60, 360)
    wb = w.copy()
    wb[100:200] *= 0.7
    got = minhash.icws(np.r_[h[a], h[b]], np.r_[w[a], wb[b]], np.array([300, 600]), 3000)
    true = sum(min(w[k], wb[k]) for k in range(60, 300)) / (w[a].sum() + wb[b].sum() - sum(min(w[k], wb[k]) for k in range(60, 300)))
    assert (got[0] == got[1]).mean() == pytest.approx(true, abs=0.04)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    got = {x["id"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(140, [e for e in edges if e[0] != e[1]])
    assert got == {k: want[k] for e in edges if e[0] != e[1] for k in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a b  c\n\nd\te f g h", "É ab", "x" * 5000])
def test_words_and_shingles(text):
    column = pa.array([text, None, text + " z", "q"])
    for _, _, w in textvec.words(column):
        assert [int(x) for x in w.per_doc] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in (text, None, text + " z", "q")]
        doc, h = textvec.shingles(w)
        assert np.bincount(doc, minlength=4).tolist() == [max(1, n - 4) if n else 0 for n in w.per_doc.tolist()]


# --- 2 -----------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    long_page = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(5, "http://a/1", long_page), (2, "http://a/2\r\nX: y", long_page), (9, None, long_page), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "z" * 100), (8, "u", "z" * 99), (10, "u", "z" * 99), (2, "http://a/2\r\nX: y", long_page), (None, "u", long_page)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    warc.write_warc(pages, str(tmp_path / "w"), records_per_file=2)
    got = warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        again = len(b) >= 100 and i is not None and i > min(same)
        want.append((i if i is not None else -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert sorted(map(str, ((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    warc.write_warc(pages.where("false"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# --- 3 -----------------------------------------------------------------------------------------


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 16))
    for k in range(60):
        x[k + 1] = x[0] + r.standard_normal(16) * 0.08 * np.linalg.norm(x[0]) / 4
    for k in range(100, 160, 2):
        v = r.standard_normal(16)
        v -= (v @ x[k]) / (x[k] @ x[k]) * x[k]
        c = 0.9 + 0.003 * (k % 20)
        x[k + 1] = 3 * (c * x[k] / np.linalg.norm(x[k]) + math.sqrt(1 - c * c) * v / np.linalg.norm(v))
    x[200:205] = x[199]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], []]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 0)]
    got = {q["vec_id"]: q for q in itq.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, g int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[k]["n_links"] for k in range(300)])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum()
    if found.sum() == link.sum():
        assert [got[k]["component_id"] for k in range(300)] == classes(300, zip(*np.nonzero(link), strict=True))
    assert all(got[1000 + k]["n_links"] == 0 and got[1000 + k]["kept"] for k in range(len(odd)))
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert itq.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


# --- 4 -----------------------------------------------------------------------------------------


def test_main_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">Cookies</div><article><header><h1>Head &amp; line</h1><p>By line</p></header><p><b>One<br>two &lt;x&gt;</p><!-- no --><aside>Side</aside><ul><li>three<li>four</ul>
    <form><input>Find</form><div id="comments"><p>Nice</p></div></article><footer>Foot</footer></body></html>"""
    assert hosttext.blocks(page) == (["Head & line", "One", "two <x>", "three", "four"], True)
    assert hosttext.blocks("<div id=main><p>a</p></div><div class=sidebar>b</div>") == (["a"], True)
    assert hosttext.blocks("plain &amp; <i>simp</i>le") == (["plain & simple"], False) and hosttext.blocks("") == ([], False)
    assert hosttext.blocks("<p>a<p hidden>b</p><p style='display: none'>c</p><p>d") == (["a", "d"], False)


def test_long_attribute_values():
    long = "x > y " * 9000
    page = f"""<body><p>Out</p><script data-a="{long}">var code = 1;</script><article data-b='{long}'><div class="advert" style="{long}"><p>Buy</p></div><p>In</p><img src="data:{long}"><p>more</p></article><p>Under</p></body>"""
    assert hosttext.blocks(page) == (["In", "more"], True)
    assert hosttext.blocks("<p>a</p><p title='" + long + "'>b</p><p>c") == (["a", "b", "c"], False)


def test_repeated_substrings_equal_brute_force():
    r = random.Random(4)
    for _ in range(20):
        pages = [[r.randrange(4) for _ in range(r.randint(0, 30))] for _ in range(5)]
        tokens, page = [x for p in pages for x in p], [k for k, p in enumerate(pages) for _ in p]
        got = hosttext.repeated(hosttext.spread(np.array(tokens, np.uint64), np.array(page, np.int64), 3), 3, 3)
        want = [False] * len(tokens)
        for a in range(len(tokens) - 2):
            if page[a] == page[a + 2]:
                s = tokens[a : a + 3]
                if len({k for k, p in enumerate(pages) if any(p[j : j + 3] == s for j in range(len(p)))}) >= 3:
                    want[a : a + 3] = [True] * 3
        assert got.tolist() == want


def test_what_a_host_repeats_goes(spark):
    frame = "<div><p>All the news that we print every single day</p></div>{}<div><p>Write to the editor of this fine paper now</p></div>"
    bodies = [prose(k, 40) for k in range(6)]
    rows = [(k, f"http://h.org/{k}", frame.format(f"<p>{b}</p>")) for k, b in enumerate(bodies)]
    rows += [(10 + k, "http://c.org/", f"<article><p>{bodies[0]}</p></article>") for k in range(4)]  # copies stay whole
    rows += [(20, None, None), (21, None, ""), (22, "http://h.org/x", "<p>only this</p>")]
    got = {r["page_id"]: r for r in hosttext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k]["text"] == b for k, b in enumerate(bodies)) and all(got[10 + k]["text"] == bodies[0] for k in range(4))
    assert got[20]["text"] == "" == got[21]["text"] and got[20]["n_chars"] == 0 and got[22]["text"] == "only this"
    assert hosttext.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_runs_go_and_unique_runs_stay_as_by_plain_comparison():
    r = random.Random(9)
    for trial in range(30):
        n = r.randint(3, 12)
        pages = [[" ".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 3))] for _ in range(n)]
        held = [r.random() < 0.3 for _ in range(n)]
        got = hosttext.without_boilerplate(pages, held, 4, 0.3, 3, 0.6, 4)
        plain = [" ".join(x) for x in pages]
        distinct = list(dict.fromkeys(plain))
        first = {x: plain.index(x) for x in distinct}
        grams = {x: [y.split()[k : k + 4] for y in [" ".join(pages[first[x]])] for k in range(len(y.split()) - 3)] for x in distinct}
        for k, x in enumerate(plain):
            k = first[x]
            need = max(4, math.ceil(0.6 * len(distinct))) if held[k] else max(3, math.ceil(0.3 * len(distinct)))
            tokens = x.split()
            cover = [False] * len(tokens)
            for a in range(len(tokens) - 3):
                if sum(tokens[a : a + 4] in g for g in grams.values()) >= need:
                    cover[a : a + 4] = [True] * 4
            # A page of nothing else stays whole.
            want = " ".join(t for t, c in zip(tokens, cover, strict=True) if not c) or " ".join(tokens)
            assert " ".join(got[k].split()) == want, (trial, k)


def test_repeated_runs_inside_blocks(spark):
    run = "click here to read what our partners have to say today"
    rows = [(k, f"http://h.org/{k}", f"<p>{prose(k, 12)} {run} {prose(k + 90, 12)}</p>") for k in range(20)]
    quote = [(100 + k, f"http://q.org/{k}", f"<article><p>{prose(k, 20)}</p><p>{run}</p></article>" if k < 8 else f"<article><p>{prose(k, 20)}</p></article>") for k in range(20)]
    frame = [(200 + k, f"http://f.org/{k}", f"<article><p>{run}</p><p>{prose(k, 20)}</p></article>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in hosttext.extract(spark.createDataFrame(rows + quote + frame, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{prose(k, 12)} {prose(k + 90, 12)}" for k in range(20))
    assert all(got[100 + k] == f"{prose(k, 20)} {run}" for k in range(8))  # a quoted passage is text
    assert all(got[200 + k] == prose(k, 20) for k in range(20))  # what all articles have is a frame


def test_paragraphs_of_articles_and_depth():
    assert hosttext.blocks('<article><p class="notice-of-motion">The motion</p><p class="ad">Buy</p><div class="share-bar">Share</div><p>Passed</p></article>') == (["The motion", "Passed"], True)
    took = []
    for n in (2_000, 16_000):
        began = time.process_time()
        hosttext.blocks("<div>" * n + "a" + "</div>" * n + "<p><b>" * 50)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


# --- 5 -----------------------------------------------------------------------------------------


def test_licences(spark):
    lines = {"Apache": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC": "Licensed under CC BY-NC 4.0.", "Proprietary": "ALL RIGHTS RESERVED."}
    rows = [(k, prose(k, 30) + ".\n" + x + "\n" + prose(k + 50, 300), "en", "s") for k, x in enumerate(lines.values())]
    rows += [(10 + k, prose(k + 90, 200), "en", "s") for k in range(30)] + [(50, None, None, None), (51, "", None, None), (52, "she has the right to drive and a license to fish here", "en", "s")]
    d = docs(spark, rows)
    got = [(r["doc_id"], r["family"], r["paragraph"]) for r in license.notices(d, license.fit(d)).collect()]
    assert sorted(got) == [(k, f, 1) for k, f in enumerate(lines)]
    assert license.notices(d.where("false"), license.train([])).collect() == []


# --- 6 -----------------------------------------------------------------------------------------


def test_languages(spark):
    stock = {g: prose(g, 80).split() for g in ("aa", "bb", "cc")}
    prose_of = lambda seed, n, w: " ".join(random.Random(seed).choices(w, k=n))
    rows = [(k, prose_of(k, 60, stock[g]), g, "s") for k, g in enumerate(list(stock) * 40)]
    model = langid.fit(docs(spark, rows))
    test = [(k, prose_of(k + 999, n, stock[g]), None, None) for k, (g, n) in enumerate(itertools.product(stock, (5, 50, 9000)))] + [(90, None, "aa", "s"), (91, "", "aa", "s"), (92, "12 !? 3", "aa", "s")]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, test), model).collect()}
    assert [got[k]["lang_pred"] for k in range(9)] == [g for g in stock for _ in range(3)]
    assert all(got[k]["lang_pred"] == "und" and got[k]["lang_rejected"] and got[k]["lang_score"] == 0 for k in (90, 91, 92))
    assert all(0 <= r["lang_score"] <= 1 for r in got.values()) and "rep" in got[0]
    none = langid.fit(docs(spark, []))
    assert none == {} and langid.identify(docs(spark, test[:1]), none).first()["lang_pred"] == "und"


# --- 7 -----------------------------------------------------------------------------------------


def test_quality(spark):
    good = [(k, prose(k, 80), "en", "s") for k in range(150)]
    bad = [(1000 + k, " ".join(w + "!!" for w in prose(k, 80).upper().split()), "en", "s") for k in range(80)]
    d = docs(spark, good + bad + [(5000, None, None, None), (5001, "", None, None)])
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in (good + bad) if r[0] % 3] + [(1, 0, 0), (None, 1, 0), (5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels, dictionary_docs=40, calibration_docs=100)
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()}
    held = [k for k in got if k % 3 == 0 and k < 5000]
    assert np.mean([(got[k] >= 0.3) == (k < 1000) for k in held]) > 0.97 and got[5000] == got[5001] == 0.0
    flat = quality.fit(d, labels.where("false"))
    assert d.where("doc_id = 3").select(quality.score(F.col("text"), flat)).first()[0] == pytest.approx(0.5)


# --- 8 -----------------------------------------------------------------------------------------


def test_language_model(spark):
    lm = [(k, prose(k % 40 if k % 2 else k, 1 + k * 7 % 90), "en", "s") for k in range(160)] + [(500, None, None, None), (501, "", None, None), (502, "A a\n\nÉ ", None, None), (502, prose(3, 4000), None, None)]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    d = docs(spark, lm).withColumn("held_out", queries.fold(7) == 2)
    got = sorted(lmscore.score(d).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    tokens = sorted(((k, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]) for k, t, _, _ in lm), key=lambda x: (x[0], len(x[1])))
    c = collections.Counter(w for k, x in tokens if not held(k) for w in x)
    n, v = sum(c.values()), len(c)
    for r, (k, x) in zip(got, tokens, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (k, held(k), len(x), n)
        assert r["n_known"] == sum(c[w] > 0 for w in x)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), abs=1e-6)
        assert -1e9 < r["score"] < 0
    assert lmscore.score(d.where("false")).collect() == []
    alone = lmscore.score(d.withColumn("held_out", F.lit(True))).where("doc_id = 501").first()
    assert alone["train_tokens"] == 0 and alone["base_score"] == 0.0 and alone["score"] < 0


def test_every_token_and_context_teaches_the_model():
    codes = lmscore.Codes(np.arange(1, 6, dtype=np.uint64), np.ones(7, np.int64), 5, lmscore.huffman([5, 4, 3, 2, 1, 1, 1]), lmscore.huffman([1] * 256))
    one, mark = np.full(2, 7, np.uint64), np.zeros(2, np.int64)
    a, b = (lmscore.word_bits(codes, np.array([2, 2]), one, np.full(2, x, np.uint64), mark).slots for x in (8, 9))
    assert [np.array_equal(x, y) for x, y in zip(a, b, strict=True)] == [True, True, False, True]
    data = np.frombuffer(b"abcdefghij", np.uint8)
    assert len(lmscore.byte_bits(codes, data, np.array([0]), np.array([10])).slots) == 6
    text = pa.array([prose(k, 40_000) for k in range(3)])
    codes = lmscore.Codes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 0, lmscore.huffman([2, 1]), lmscore.huffman([1] * 256))
    run, *_ = lmscore._train(type("B", (), {"value": codes}), codes.end)
    lmscore.TaskContext, held = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda s: 0})())}), lmscore.TaskContext
    try:
        got = {r["part"]: r["body"] for b in run(iter([pa.RecordBatch.from_arrays([text], names=["t"])])) for r in b.to_pylist() if r["part"] >= 100}
    finally:
        lmscore.TaskContext = held
    seen = np.frombuffer(lmscore.zstandard.ZstdDecompressor().decompress(got[100])).reshape(5, -1)[-1].sum()
    assert seen >= 120_003 - (1 << 16)


def test_runs_by_plain_comparison(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(r.choice((0, 2, 5, 120)))) for _ in range(40)]
    codes = lmscore.Codes(np.zeros(0, np.uint64), np.zeros(2, np.int64), 0, lmscore.huffman([2, 1]), lmscore.huffman([1] * 256))
    monkeypatch.setattr(lmscore, "RUN", 8)
    (_, _, w), *_ = list(textvec.words(pa.array(texts)))
    t = lmscore._Text(codes, textvec.Lookup(codes.head), w, len(texts))
    begin, stop, f, g, own_f, own_g = t.runs(w)
    tokens = [x for y in texts for x in (*y.split(), None)]
    where = [(k, j) for k, y in enumerate(texts) for j in range(len(y.split()) + 1)]
    context, run, found = {}, {}, []
    for b, e, x, y in zip(begin, stop, f, g, strict=True):
        assert where[b][1] >= 3 and where[b][0] == where[e - 1][0] and (e == len(tokens) or where[e][1] == 0 or e in begin)
        assert context.setdefault(tuple(tokens[b - 3 : b]), x) == x and run.setdefault(tuple(tokens[b:e]), y) == y
        found.append((where[b][0], tuple(tokens[b - 3 : b]), tuple(tokens[b:e])))
    assert len(set(context.values())) == len(context) > 1 and len(set(run.values())) == len(run)
    assert all(where[k][1] < 3 or tuple(tokens[k - 3 : k]) not in context or k in begin for k in range(len(tokens)))  # every such place begins a run
    count = collections.Counter((k, c) for k, c, _ in found), collections.Counter(found)
    assert own_f.tolist() == [count[0][k, c] for k, c, _ in found] and own_g.tolist() == [count[1][x] for x in found]


def test_other_texts_teach_long_contexts(spark):
    rows = [(k, prose(k, 250), "en", "s") for k in range(60)]
    rows += [(100 + k, prose(k, 250), "en", "s") for k in range(20)]  # the first twenty occur twice
    d = docs(spark, rows).withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r["bits_per_byte"] for r in lmscore.score(d).collect()}
    twice = [got[k] for k in (*range(20), *range(100, 120))]
    assert max(twice) < 0.6 * min(got[k] for k in range(20, 60))
    held = {r["doc_id"]: r["bits_per_byte"] for r in lmscore.score(d.withColumn("held_out", F.col("doc_id") < 40)).collect()}
    assert max(held[k] for k in range(20)) < 0.6 * min(held[k] for k in range(20, 60))


def test_huffman_paths_are_a_code():
    start, length, node, bit, _, _ = lmscore.huffman([5, 1, 1, 8, 3, 1])
    codes = lmscore.Codes(np.arange(4, dtype=np.uint64), np.ones(6, np.int64), 4, lmscore.huffman([5, 1, 1, 8, 3, 1]), lmscore.huffman([1] * 256))
    sent = pickle.loads(pickle.dumps(codes))
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for x, y in ((codes.word, sent.word), (codes.byte, sent.byte)) for a, b in zip(x, y, strict=True))
    words = ["".join(str(b) for b in bit[s : s + n]) for s, n in zip(start, length, strict=True)]
    assert sum(2.0 ** -len(w) for w in words) == 1.0 and len(set(words)) == 6
    assert sum(a * b for a, b in zip(length, [5, 1, 1, 8, 3, 1], strict=True)) == 41


# --- 9 -----------------------------------------------------------------------------------------


def test_common_subsequence():
    r = random.Random(7)
    for _ in range(50):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(np.array(a), np.array(b))[0] == t[-1][-1]


def test_leaks(spark):
    items = [prose(k + 300, 15 + k * 4) for k in range(12)] + [prose(400, 300), None, "", "!!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, prose(k, 150) + " " + items[k % 13] + " " + prose(k + 70, 90), "en", "s") for k in range(26)]
    swapped = items[11].split()
    swapped[5], swapped[20] = "other", "words"
    rows += [(40, prose(1, 50) + " " + " ".join(swapped).upper() + "!", "en", "s"), (41, items[3], "en", "s"), (42, items[2] + " x " + items[5], "en", "s")]
    rows += [(50 + k, prose(k + 500, 200), "en", "s") for k in range(40)] + [(90, None, None, None), (91, "", None, None), (92, items[12][: len(items[12]) // 3], "en", "s")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(k, k % 13) for k in range(26)} | {(40, 11), (41, 3), (42, 2), (42, 5)}
    assert decontam.contaminated(docs(spark, rows[:2]), bench.where("false")).collect() == []
    assert decontam.contaminated(docs(spark, []), bench).collect() == []


def test_frequent_leaks_and_small_corpora(spark):
    items = [prose(k + 300, 30) for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, prose(k, 40) + " " + (edited(items[4], k, 3) if k % 6 == 0 else items[4]) + " " + prose(k + 500, 30) if k % 3 == 0 else prose(k, 100), "en", "s") for k in range(120)]
    rows += [(200, prose(201, 50) + " " + items[7], "en", "s")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(k, 4) for k in range(0, 120, 3)} | {(200, 7)}
    few = [(0, items[3], "en", "s"), (1, prose(1, 60), "en", "s"), (2, prose(2, 30) + " " + items[5] + " " + prose(3, 20), "en", "s")]
    for n in (1, 3):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, few[:n]), bench).collect()}
        assert got == {(0, 3), (2, 5)} if n > 1 else got == {(0, 3)}


def test_items_that_many_items_repeat(spark):
    bench = spark.createDataFrame([(k, prose(300, 30)) for k in range(8)] + [(20 + k, prose(k + 320, 30)) for k in range(12)], "item_id long, text string")
    rows = [(k, prose(k, 150), "en", "s") for k in range(40)] + [(90, prose(91, 50) + " " + prose(300, 30), "en", "s")]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), bench).collect()} == {(90, k) for k in range(8)}


# --- 10 ----------------------------------------------------------------------------------------


def test_mix(spark):
    r = random.Random(2)
    rows = [(k, " ".join("w" * r.randint(0, 90)), None, f"s{min(int(r.expovariate(0.8)), 5)}") for k in range(400)]
    rows += [(k, "a b c", None, None) for k in (1, 1, 2)] + [(None, "x y", None, "s1"), (None, "x", None, "s1"), (900, None, None, "zero"), (901, " \n", None, "zero"), (902, "one", None, "tiny")]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, room = {}, set(names), sum(sizes.values())
    while left:  # plain resharing until none is above
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            room -= 3 * sizes[s]
        left -= over
    taken = collections.Counter()
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == sizes[x["source"]] and 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 4 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mix(docs(spark, [])).collect() == []


# --- all ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, data), c.sql(queries.ORACLE_SQL[name])
    pick = lambda cols, rows: sorted(repr([r[cols.index(k)] for k in sorted(cols)]) for r in rows)
    assert pick(ours.columns, map(tuple, ours.collect())) == pick(theirs.columns, theirs.fetchall())


def test_shared_folder_is_the_session_setting(spark):
    assert common.workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
