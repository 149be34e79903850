"""Infilling, collocations and url filters against brute force, SQL and edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomspark.llm import collocations, infilling, neardup, queries, urls

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, lang string, source string, id string, n int, k int, f int, l int, r int, a int, size int, phrase string, output string, form string"
EDGE = [None, "", " \t\n", "one", " one", "one ", "a  b\tc\x0b\x0cd\r\n", "x" * 30000, " ".join(f"w{i}" for i in range(9000)), "漢字 ünï\u00a0x 𝒳 текст", "\x00\x1f ctl", "a <P> b", "<S>", "tie tie tie", "tie tie tie", "< P> <P", "<M"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    value = lambda x: None if pd.isna(x) else str(int(x)) if isinstance(x, float) or hasattr(x, "__index__") else str(x)
    plain = lambda df: sorted((tuple(map(value, r)) for r in df[cols].astype(object).itertuples(index=False)), key=str)
    assert plain(got) == plain(want)


def _expected(key, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    low, high = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_and_infilling_against_brute_force(spark):
    rng = random.Random(1)
    a = infilling.automaton()
    for _ in range(400):
        t = "".join(rng.choice(" \t\n\x0b\x0c\rab<>PSM漢𝒳\x1c\u00a0") for _ in range(rng.randrange(40)))
        found = UNIT.findall(t)
        units = infilling.Units(infilling.events(t, a)[0], len(t))
        assert units.n == len(found)
        assert [units.end(i) for i in range(units.n + 1)] == [len("".join(found[:i])) for i in range(units.n + 1)]
    data = [(i, t, None, None, "id", 1, 2, 3, 4, 5, 6, 7, "p", "o", "f") for i, t in enumerate(EDGE * 12)]
    data += [(7, "same id other text", *data[0][2:]), (None, "no id at all", *data[0][2:])]
    df = spark.createDataFrame(data, CLASHING)
    got = infilling.fill_in_middle(df).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((r[0], *_expected("" if r[0] is None else r[0], r[1])) for r in data)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r, t in zip(sorted(infilling.digests(infilling.fill_in_middle(df.where("doc_id <> 7"))).collect()), sorted(x for x in data if x[0] not in (7, None)), strict=True):
        assert r.restored_sha256 == hashlib.sha256((t[1] or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(_expected(t[0], t[1])[4].encode()).hexdigest()
    assert infilling.fill_in_middle(df.limit(0)).collect() == []


def test_automaton_states():
    rng = np.random.default_rng(1)
    for depth in (2, 4):
        for _ in range(40):
            w = rng.integers(0, 4, rng.integers(1, 40))
            ends = defaultdict(set)
            for i in range(len(w)):
                for m in range(1, depth + 1):
                    g = tuple(w[i - m + 1 : i + 1]) if i - m + 1 >= 0 else ()
                    if g and 0 not in g:
                        ends[g].add(i)
            states = list(zip(*collocations.automaton(w, depth), strict=True))
            seen = {}
            for n, (e, length, shortest, count) in enumerate(states):
                for m in range(shortest, length + 1):
                    g = tuple(w[e - m + 1 : e + 1])
                    assert g not in seen and len(ends[g]) == count
                    seen[g] = n
            assert set(seen) == set(ends)
            # substrings with the same ends are in one state, and only those
            by_ends = defaultdict(set)
            for g, x in ends.items():
                by_ends[frozenset(x)].add(seen[g])
            assert all(len(x) == 1 for x in by_ends.values()) and len(by_ends) == len(states)


def _collocations(data, least, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {g: x for g, x in c.items() if len(g) > 1 and x >= least}
        inside = Counter()
        for g, x in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], x)
        rows = []
        for g, a in cand.items():
            if 100 * inside[g] >= cover * a and inside[g]:
                continue
            score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_collocations_against_brute_force(spark, monkeypatch, shard):
    rng = random.Random(2)
    monkeypatch.setattr(collocations, "BLOCK", 100)
    names = ["The", "cat", "sat", "on", "a", "mat", "ünï", "漢字", "x\u00a0y", "\x1c", "Zoë", "zz"]
    texts = []
    for i in range(400):
        w = [rng.choice(names[: 3 + i % 10]) for _ in range(rng.randrange(60))]
        w[5:5] = ["new", "york", "City", "hall"] * (i % 3)
        texts.append(("".join(x + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "!\n", "\r", " ; "]) for x in w), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    texts += [(None, "en"), ("", "en"), (" .,;", "fr"), ("one", "it"), *texts[:30]]
    texts.append((" ".join(rng.choice(["long", "text", "here"]) for _ in range(3000)), "en"))
    df = spark.createDataFrame([(i, t, x, None, "id", 1, 2, 3, 4, 5, 6, 7, "p", "o", "f") for i, (t, x) in enumerate(texts)], CLASHING).repartition(5)
    for how in ({"least": 5, "longest": 4, "cover": 80, "top": 25}, {"least": 2, "longest": 3, "cover": 50, "top": 2000}):
        got = sorted(tuple(r) for r in collocations.collocations(df, shard=shard, **how).collect())
        assert got == _collocations(texts, how["least"], how["longest"], how["cover"], how["top"]) and len(got) > 40
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.where("doc_id > 400 and doc_id < 404")).collect() == []


def test_scores_are_exact(spark):
    big = [(10**13 + 7, 3 * 10**13 + 1, 10**13 + 9), (2**62, 2**63 - 1, 2**63 - 1), (30, 61, 30), (1, 3, 3)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = df.selectExpr("a", "l", "r", collocations._share("a", "cast(l as decimal(20,0)) + cast(r as decimal(20,0))") + " as s").collect()
    assert [r.s for r in got] == [2000000 * a // (x + r) for a, x, r in big]


def _fit(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    h, p = (m.group(2).lower(), m.group(3)) if m else ("", "")
    fit = [(len(r), r, v) for v, r in urls.RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith("/" + r.split("/", 1)[1])]
    return h, p, *(max(fit)[1:] if fit else (None, None))


def _form(url):
    """What urls of one node share, written apart from the library."""
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    if not m:
        return url
    scheme, h, p, q = m.groups()
    keep = [x for x in (q or "").split("&") if x and not re.match(r"(utm_[a-z]+|gclid|fbclid|msclkid)(=|$)", x, re.I)]
    web = scheme.lower() in ("http", "https")
    return ("web" if web else scheme.lower(), re.sub(r":(80|443)?$", "", h.lower()) if web else h.lower(), p or "/", "&".join(keep))


def _judged(pages, links, redirects=()):
    """Verdicts by union-find over all urls."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    said = [(u, t) for (_, u, _), t in zip(pages, links, strict=True) if u and t] + list(redirects)
    marks = defaultdict(set)
    for a, b in said:
        up[find(_form(a))] = find(_form(b))
    for u in [u for _, u, _ in pages if u] + [x for ab in said for x in ab]:
        marks[find(_form(u))].add(_fit(u)[3])
    out = []
    for k, u, _ in pages:
        h, p, rule, v = _fit(u)
        m = marks[find(_form(u))] if u else set()
        out.append((k, h, p, rule, v or ("block" if "block" in m and "allow" not in m else "allow")))
    return Counter(out)


@pytest.mark.parametrize("few", [urls.FEW, 0])
def test_urls_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "FEW", few)
    rng = random.Random(3)
    hosts = ["a.example.com", "example.org", "x.example.org", "B.Example.NET", "example.net:443", "net", "notexample.org", "com"]
    def url():
        return f"{rng.choice(['http', 'https', 'HTTPS', 'ftp'])}://{rng.choice(hosts)}" + rng.choice(["", "/", "/de/5", "/fr/7", "/es/3", "/en/1", "/en/10?x=1", "/en/2?utm_source=a", "/en/2?utm_source=a&p=1", "/en/3#top", "/q?de=/de/", "/en/7/../x"])

    pages, links = [], []
    for i in range(700):
        u, t = url(), url() if rng.random() < 0.5 else None
        tag = "" if t is None else rng.choice([f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' REL='Canonical'/>", f'<meta http-equiv="Refresh" content="0; URL={t}">', f"<link rel=canonical href={t} >"]).replace("&", "&amp;")
        pages.append((i, u, f"<html><!-- <link rel=\"canonical\" href=\"http://x.com/de/0\"> --><head>{tag}<link rel=icon href=/i></head>canonical refresh</html>"))
        links.append(t)
    chain = [f"http://chain.net/{i}" for i in range(40)]
    redirects = [*zip(chain, chain[1:], strict=False), (chain[-1], "https://spam.com/de/x"), ("http://other.net/1", "http://other.net/2"), ("http://other.net/2", "https://good.org/")]
    odd = [None, "", "no scheme", "://", "http://", "a://b://com/de/", chain[0], chain[20], chain[20], "http://other.net/1#f", "http://free.net/", "https://spam.com/de/x", "http://[::1]/de/", "http://com./de/1", "HTTP://CHAIN.NET:80/7?gclid=1"]
    for i, u in enumerate(odd):
        pages.append((1000 + i, u, None if i % 2 else "<html>"))
        links.append(None)
    pages.append((None, chain[3], ""))
    links.append(None)
    pages.append(pages[0])
    links.append(links[0])
    df = spark.createDataFrame([(*p, "x", "y", 1, "z") for p in pages], "page_id long, url string, html string, host string, path string, n int, node string").repartition(3)
    more = spark.createDataFrame(redirects, "from_url string, to_url string")
    got = Counter(tuple(r) for r in urls.judge(df, redirects=more).collect())
    want = _judged(pages, links, redirects)
    assert got == want
    by = {r[0]: r[4] for r in got}
    assert by[1006] == by[1007] == by[1014] == "block" and by[1009] == by[1010] == "allow" and by[None] == "block"
    assert urls.judge(df.limit(0)).collect() == []
    alone = Counter(tuple(r) for r in urls.judge(df, html_col=None).collect())
    assert alone == _judged(pages, [None] * len(pages))


def test_links_are_resolved(spark):
    u = "https://h.net/a/b?q=/x"
    cases = {"/c": "https://h.net/c", "c": "https://h.net/a/c", "//i.net/c": "https://i.net/c", "http://z/": "http://z/", "#top": None, "mailto:a@b": None, "": None, "?p=1": "https://h.net/a/?p=1"}
    df = spark.createDataFrame([(u, k) for k in cases], "u string, k string")
    assert {r.k: r.t for r in df.select("k", urls.resolved(df.k, df.u).alias("t")).collect()} == cases


def test_components_in_one_task_and_by_stars(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 3), (7, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = lambda **how: {r.id: r.component for r in neardup.components(edges, **how).collect()}
    one = found()
    assert one == found(local=False) and one[1059] == 1000
    monkeypatch.setattr(neardup, "FEW_ROWS", 10)
    assert found() == one


def test_links_of_several_partitions_take_no_turns(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW_ROWS", 10)
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), 150 + rng.randrange(40)) for _ in range(90)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup("one task", "")
    try:
        one = {r.id: r.component for r in neardup.components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one task")) < 8  # stars: dozens
    monkeypatch.setattr(neardup, "FEW_LINKS", 0)
    assert one == {r.id: r.component for r in neardup.components(edges).collect()} and one[260] == 200
