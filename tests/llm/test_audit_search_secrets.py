"""The filter audit, ranked search and secret scan against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import time

import pytest

from helixframe.llm import audit, hosttext, license, queries, search, secrets

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, row long, term string, state int, n long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    """``(id, text, source)`` with columns whose names clash with inner ones."""
    return spark.createDataFrame([(a, b, "en", c, len(b or ""), "p", 5, "t", 1, 9) for a, b, c in rows], DOC)


def prose(seed, n, stock=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}" for _ in range(n))


# --- 11 ----------------------------------------------------------------------------------------


def failing(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), e))
    return out


def plain_audit(rows, labels):
    fails = failing(rows)
    mark = lambda i, k: any(x[0] == i and x[k] == 1 for x in labels) if i is not None else False
    shapley, out = collections.Counter(), {}
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone, stay = [k for k in left if fails[k][f]], [k for k in left if not fails[k][f]]
                early = [k for k in own if fails[k][f] and k not in left]
                alone = sum(fails[k][f] and sum(fails[k]) == 1 for k in own)
                out[part, "".join("ABCDE"[k] for k in order), step + 1] = [len(stay), len(gone), len(early), alone, sum(mark(rows[k][0], 1) for k in gone), sum(mark(rows[k][0], 2) for k in gone)]
                shapley[part, f] += len(gone)
                left = stay
    return {(p, o, s): tuple(v) + (shapley[p, "ABCDE".index(o[s - 1])],) for (p, o, s), v in out.items()}


def test_audit_equals_applying_every_order(spark):
    wide = " ".join(f"w{k}" for k in range(60))
    texts = [wide, wide, wide + " #", "A B C " * 30, None, "", prose(1, 80), "É" * 70, wide.upper(), "x " * 20 + "$", wide + " tail", "a\x0bb\x1cc", "Ab " * 20000]
    r = random.Random(3)
    rows = [(k, texts[r.randrange(len(texts))], r.choice(["s", "t", None, ""])) for k in range(60)]
    rows += [(7, wide, "s"), (7, wide, "s"), (None, wide, "t"), (None, None, None), (61, texts[-1], "long"), (62, "only here", "lonely")]
    labels = [(k, r.choice([0, 1]), r.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.orders(audit.flagged(docs(spark, rows), frame), list("ABCDE"), ["good", "toxic"]).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    assert {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in got} == want


def test_audit_visits_each_set_once_and_leaves_nothing_persisted(spark):
    rows = audit.flagged(docs(spark, [(k, prose(k, 60), "s") for k in range(8)]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    found = audit.edges(rows, list("ABCDE"), ["good"])
    states = [r["state"] for r in found.select("state").collect()]
    assert len(states) == len(set(states)) <= 31
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    two = audit.orders(rows, ["B", "E"], []).collect()
    assert sorted((r["filter_order"], r["step"]) for r in two) == [("BE", 1), ("BE", 2), ("EB", 1), ("EB", 2)]
    with pytest.raises(ValueError):
        audit.edges(rows, list("ABCDEABC"), [])


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.orders(audit.flagged(docs(spark, []), empty), list("ABCDE"), ["good", "toxic"]).collect() == []


# --- 12 ----------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(rows, items, k):
    bags = [collections.Counter(terms(t)) for _, t, _ in rows]
    n, total = sum(bool(b) for b in bags), sum(b.total() for b in bags)
    df = collections.Counter(t for b in bags for t in b)
    out, wanted = {}, collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    for i, ts in wanted.items():
        found = []
        for at, b in enumerate(bags):
            m = 50 + 50 * b.total() * n // total if b else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                doc = rows[at][0]
                found.append((-s, doc is None, doc or 0, at))
        out[i] = [(None if x[1] else x[2], -x[0]) for x in sorted(found)[:k]]
    return {i: v for i, v in out.items() if v}


def ranked(spark, rows, items, k):
    wanted = search.terms_of(spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int"))
    got = search.search(search.postings(docs(spark, rows), wanted), wanted, k).orderBy("item", "rank").collect()
    out = collections.defaultdict(list)
    for r in got:
        out[r["item"]].append((r["doc"], r["score"]))
        assert r["rank"] == len(out[r["item"]])
    return dict(out)


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_scoring_everything(spark, monkeypatch, k):
    monkeypatch.setattr(search, "ROWS", 50)
    r = random.Random(1)
    rows = [(k, prose(k, r.randrange(1, 90), 120), "s") for k in range(80)]
    rows += [(90, "Naïve ÉTUDE w1 W2\x00w3_w4-w5", "s"), (91, None, None), (92, "", "s"), (93, " --- ", "s"), (5, "w1 w2", "s"), (5, "w1 w2", "s"), (None, "w1 w2", "s"), (94, "rare " * 30000 + "w1", "s"), (95, "tie one", "s"), (96, "tie one", "s")]
    items = [(0, "w1 w2 W3 w1"), (1, "étude naïve ÉTUDE"), (2, "tie one"), (3, None), (4, "nothing of that"), (5, "rare w7"), (6, "w4"), (6, "w9"), (None, "w11 w12")]
    want = plain_search(rows, items, k)
    assert ranked(spark, rows, items, k) == want
    assert [d for d, _ in want[2]] == [95, 96] and 3 not in want


def test_search_of_odd_tables(spark):
    assert ranked(spark, [], [(0, "w1")], 5) == {}
    assert ranked(spark, [(1, "w1", "s")], [], 5) == {}
    # A term of all documents weighs log of nearly 1, which is 0.
    assert ranked(spark, [(k, "all", "s") for k in range(3000)], [(0, "all")], 5) == {}


def test_all_postings_are_kept_without_a_choice(spark):
    got = search.postings(docs(spark, [(1, "b a b", "s"), (2, "a", "s"), (3, None, "s")])).collect()
    assert sorted((r["doc"], r["n"], r["term"] or "", r["tf"]) for r in got) == [(1, 3, "", 0), (1, 3, "a", 1), (1, 3, "b", 2), (2, 1, "", 0), (2, 1, "a", 1)]
    assert all((r["bucket"] == -1) == (r["term"] is None) for r in got) and len({r["row"] for r in got}) == 2


# --- 13 ----------------------------------------------------------------------------------------

PLAIN = {
    "assign": re.compile(secrets.PATTERNS["assign"], re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "vendor": re.compile(secrets.PATTERNS["vendor"]),
    "opaque": re.compile(secrets.PATTERNS["opaque"]),
}


def plain_scan(rows, wide=secrets.WIDE):
    """Base spans exactly as the contract says, then those of other kinds by ownership."""
    found, owners = [], collections.defaultdict(set)
    for _, t, s in rows:
        own = []
        for k, (name, p) in enumerate(PLAIN.items()):
            for m in p.finditer(t or ""):
                v = m[2] if name == "assign" else m[0]
                if {"assign": len(v) >= 8, "access": len(v) >= 16, "hex": len(v) >= 32, "vendor": True, "opaque": len(v) <= 128 and all(re.search(c, v) for c in ("[0-9]", "[a-z]", "[A-Z]"))}[name]:
                    own.append((m.start(), k, m.end(), v))
        own = [x for x in own if x[1] < 3 or not any(y[1] < x[1] and y[0] < x[2] and x[0] < y[2] for y in own)]
        for x in own:
            owners[x[3]].add(s)
        found.append(sorted(own))
    out = []
    for (i, _, _), own in zip(rows, found, strict=True):
        live = [x for x in own if x[1] < 3 or len(owners[x[3]]) < wide]
        say = lambda xs: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in xs)
        base = [x for x in live if x[1] < 3]
        out.append((i, *(sum(x[1] == k for x in live) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(live), sum(x[1] > 2 for x in live), sum(len(owners[x[3]]) < wide for x in live), sum(len(owners[x[3]]) >= wide for x in live)))
    return sorted(out, key=repr)


def scanned(spark, rows):
    got = secrets.digest(secrets.scan(docs(spark, rows))).collect()
    return sorted((tuple(r) for r in got), key=repr)


HEX, KEY = "0123456789abcdef" * 3, "AKIA" + "Z9" * 8


def test_secrets_equal_plain_matching(spark):
    texts = [
        f"password={HEX[:18]} and {KEY}", f"\U0001f511é PASSWORD : 'short' token='longenough1' {HEX}", "token:secret: abcdefghij", "api_key==abc=defgh apikey = \"x/y+z_12.3\"",
        f"{KEY}{KEY} AKIA AKIAAKIA{'B' * 11} AKIAshort", f"{HEX[:31]} {HEX[:32]}g{HEX}", "passwd=" + "a" * 7 + " passwd=" + "a" * 8, "Secret  :=abcdefgh ſecret=abcdefgh toKen=abcdefgh toKen=abcdefgh", None, "", "plain prose only",
        "ghp_" + "aB3" * 12, "token=ghp_" + "aB3" * 12, "sk_live_" + "q1W2" * 5 + " Zx9" + "yW8_" * 7, "no-case-mix-in-this-long-run-at-all", "A1b-" * 40, f"password{' ' * 5000}= {HEX}", "xoxb-" + "1234-abcdEF" * 2,
    ]
    rows = [(k, t, f"o{k % 3}") for k, t in enumerate(texts)] + [(None, texts[0], None), (3, texts[3], "o1"), (3, texts[3], "o1")]
    got = scanned(spark, rows)
    assert got == plain_scan(rows)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[11][5].startswith("vendor:0:") and by[12][1] == 1 and "vendor" not in by[12][5] and by[10][5] == by[8][5] == ""


def test_widely_owned_values_are_examples(spark):
    example, own, leaked = "ghp_" + "aB3" * 12, "ghp_" + "cD4" * 12, f"token={HEX[:20]}"
    rows = [(k, f"see {example} {leaked}", f"o{k % 8}") for k in range(40)] + [(100 + k, f"mine {own}", "o1") for k in range(30)]
    got = scanned(spark, rows)
    assert got == plain_scan(rows)
    assert all(r[6] == 0 and r[8] == 1 for r in got if r[0] < 100) and all(r[6] == 1 and r[7] == 1 for r in got if r[0] >= 100)


def test_many_secrets_in_one_text_and_empty_tables(spark):
    assert scanned(spark, []) == []
    text = " ".join(f"é{k} passwd={k:09d} {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(20000))
    (got,) = scanned(spark, [(1, text, "s")])
    assert got[1] == 20000 and got[3] == 20000
    first = PLAIN["assign"].search(text)
    assert got[5].startswith(f"assign:{first.start()}:{first.end()},hex:")


def test_ownership_counts_owners_and_repositories(spark):
    rows = [("d", "o1", "r1"), ("d", "o1", "r1"), ("d", "o1", "r2"), ("d", "o2", "r1"), ("d", None, "r1"), ("e", "o1", None)]
    got = secrets.ownership(spark.createDataFrame(rows, "digest string, owner string, repo string")).collect()
    assert sorted((r["digest"], r["owners"], r["repos"]) for r in got) == [("d", 3, 4), ("e", 1, 1)]


# --- pages and folds ---------------------------------------------------------------------------


@pytest.mark.parametrize("piece", ["<a ", "</a ", "<![CDATA[", "<![CDATA[>", '<a "x>"', "<!", "<a '", "<", '<p class="', "<!-- ", "<script>"])
def test_markup_that_never_ends_costs_no_square(piece):
    began = time.process_time()
    assert hosttext.blocks("<p>ok</p>" + piece * (600_000 // len(piece)))[0][0] == "ok"
    assert time.process_time() - began < 5


def test_names_inside_an_article_must_say_nothing_else():
    page = """<article><p>A</p><div class="social-history"><p>Cities grew.</p></div><section class="replies-to-critics"><p>No.</p></section>
    <span class="ad-hoc">ad hoc rule</span><h2 id="comments">Comments</h2><div class="comment-list">gone</div><div class="ad-slot-2">gone</div><div id="comments">gone</div><p class="notice">gone</p></article>
    <div class="social-history">gone</div>"""
    assert hosttext.blocks(page) == (["A", "Cities grew.", "No.", "ad hoc rule", "Comments"], True)


def test_markup_is_read_as_tags_and_text():
    page = """<!DOCTYPE html><p title="a > b">1 < 2 <b>x</B></p><!-- <p>no</p> --!><p>y<?php > ?></p><![CDATA[<p>no</p>]]><p data-x='"'>z</p><script>"</p><p>no"</script ><p>w"""
    assert hosttext.blocks(page) == (["1 < 2 x", "y ?>", "z", "w"], False)


def test_a_null_id_is_held_out_nowhere(spark):
    got = spark.createDataFrame([(None,), (3,)], "doc_id long").select("doc_id", *[(queries.fold(m) == k).alias(f"f{m}") for m, k in ((3, 1), (5, 0), (7, 2))]).collect()
    assert all(r[f"f{m}"] is not None for r in got for m in (3, 5, 7)) and not any(r[f"f{m}"] for r in got if r["doc_id"] is None for m in (3, 5, 7))


def test_licences_of_no_family_are_unknown(spark):
    plain = [f"{prose(k, 12, 400)}. {prose(k + 1, 9, 400)}." for k in range(60)]
    frame = docs(spark, [(k, t, "s") for k, t in enumerate(plain)])
    model = license.fit(frame)
    rows = [(100, "the Frobnicate Open License 3.1", "s"), (101, "Licensed under the Apache License, Version 2.0", "s"), (102, "w1 w2 w3", "s"), (103, None, "s"), (104, f"{prose(9, 20, 400)}\nthe Frobnicate Open License 3.1\n{prose(8, 20, 400)}", "s")]
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in license.notices(docs(spark, rows), model).collect()}
    assert got == {(100, 0): "unknown", (101, 0): "Apache", (104, 1): "unknown"}
    assert license.notices(frame, model).count() == 0
