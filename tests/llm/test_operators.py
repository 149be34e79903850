"""The training-data operators against brute force, round trips and edge rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, licenses, lm, mixing, neardup, packing, passages, pii, quality, sharding

SF = "/root/testdata/sf0.001"
#: Columns of documents, and others whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, k int, kind string, row int, h string, s string, _source string, _hits int, tokens int, bucket int, _kept_id int, component_id int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    base = [
        None,
        "",
        " \t\n",
        "one",
        "one two three",
        "a b c d e f g h i j k l m n o p",
        "x" * 30000,
        " ".join(f"w{i}" for i in range(9000)),
        "tab\tnew\nline\x0b\x0c end",
        "ünï cödé 漢字 текст",
        "\x00\x1f ctl",
        "same text here now please",
        "same text here now please",
    ]
    rows = [(i, t, None, None if i % 2 else "s", 0, "id", 1, 2, "k", 3, "h", "s", "x", 4, 5, 6, 7, 8) for i, t in enumerate(base)]
    return spark.createDataFrame([*rows, rows[4], (None, *rows[4][1:]), (None, *rows[7][1:])], SCHEMA).cache()


OPS = {
    "passages": lambda d: passages.passages(d),
    "licenses": lambda d: licenses.scan_documents(d),
    "lm": lambda d: lm.score(d),
    "pii": lambda d: pii.replace(d, "k"),
    "mixing": lambda d: mixing.mix(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "keep_one": lambda d: neardup.keep_one(d),
    "fingerprints": lambda d: fingerprints.edited_likeness(d),
    "sharding": lambda d: sharding.assign(d),
    "packing": lambda d: packing.pack(d),
    "quality": lambda d: quality.measure(d),
    "keep": lambda d: quality.keep(d),
}
ROW_FOR_ROW = ("licenses", "lm", "pii", "neardup", "fingerprints", "sharding", "quality")


@pytest.mark.parametrize("name", OPS)
def test_edges_and_empty(spark, edge, name):
    got = OPS[name](edge).collect()
    if name in ROW_FOR_ROW:
        # without an id a row has no place in the order of documents
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edge.collect() if r.doc_id is not None or name != "fingerprints")
    if name in ("pii", "mixing", "keep_one", "keep"):
        assert set(edge.columns) <= set(OPS[name](edge).columns)
    assert OPS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_base_counts(docs, texts):
    for r in quality.measure(docs).collect():
        t = texts[r.doc_id]
        w = WORDS.findall(t)
        win = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (r.kept is False or not r.base_failed)


def test_license_places(spark):
    t = "Apache License apache license, MIT-license; cc by-nc 4.0 GNU general Public LICENSE x"
    got = licenses.scan_documents(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    at = [i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(w), len(at), min(at), max(at))
    assert got.base_labels == "apache,cc-by,gpl,mit" and "cc-by-nc" in got.labels.split(",")


def test_license_expressions():
    post, ok = licenses.parse("mit or apache-2.0 and (gpl-2.0 with classpath-exception-2.0)")
    assert ok and post == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    n, leaves = licenses.evaluate(post)
    assert n == 2 and leaves == {"mit", "apache-2.0", "gpl-2.0 with classpath-exception-2.0"}
    assert not licenses.parse("(mit or")[1] and not licenses.parse("or mit")[1]


def test_lm(docs, texts):
    rows = {r.doc_id: r for r in lm.score(docs).collect()}
    tok = {k: [*map(bytes, t.encode().translate(lm.LOWER).split()), b"\n"] for k, t in texts.items()}
    c = Counter(x for k, v in tok.items() if lm.fold(k) != 1 for x in v)
    n, v = sum(c.values()), len(c)
    for k, r in rows.items():
        want = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok[k])
        assert r.train_tokens == n and r.n_tokens == len(tok[k]) and r.n_known == sum(c[x] > 0 for x in tok[k])
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
    held = [r.bits_per_byte for r in rows.values() if r.held_out and r.n_tokens > 50]
    assert np.mean(held) < 3.5


def test_lm_probabilities_sum_to_one():
    rng, bits = np.random.default_rng(1), lm.slot_bits(100)
    slots = sum(1 << b for b in bits)
    checks = np.zeros(slots, np.uint8)
    for b in range(256):
        for *_, places in lm.Contexts([b"the cat" + bytes([b])]).nodes(bits):
            for s, check in places:
                checks[s] = check
    m = lm.Model(bits, rng.integers(0, 9, (slots, 2)).astype(np.uint16), checks)
    cost = 0.0
    for b in range(256):
        c = lm.Contexts([b"the cat" + bytes([b])])
        at = c.where[7]
        cost += 2.0 ** -m.bits(c)[at]
    assert abs(cost - 1) < 1e-6


def test_surrogates(spark):
    rows = [(1, "call +1 (212) 555-1234 or mail Ann.Lee@x.org, card 4111111111111111."), (2, "again +1 (212) 555-1234; ip 10.20.30.40; ann.lee@x.org; Mrs. Clara Stone"), (3, "nothing here")]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", count_col="n").collect()}
    a, b = got[1].text, got[2].text
    phone = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")
    assert phone.search(a)[0] == phone.search(b)[0] != "+1 (212) 555-1234"
    mail = re.compile(r"\S+@\S+?\.net")
    assert mail.search(a)[0] == mail.search(b)[0] and "x.org" not in a + b
    assert "4111111111111111" not in a and "10.20.30.40" not in b and "Stone" not in b and "Mrs. " in b
    card = re.search(r"\d{16}", a)[0]
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(card[::-1])) % 10 == 0
    assert got[3].text == "nothing here" and (got[1].n, got[2].n, got[3].n) == (3, 4, 0)


def test_surrogates_are_distinct(spark):
    forms = spark.range(3000).select(F.lit("phone").alias("kind"), F.concat(F.lit("212"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("canon"))
    got = pii.surrogates(forms, "k").collect()
    assert len(got) == 3000 == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & {r.canon for r in got}


def test_mixing(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 2000, "x").when(F.col("id") < 2900, "y").otherwise("z").alias("source"))
    got = mixing.mix(df).collect()
    by = Counter(r._source for r in got)
    weight = {r._source: r._weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9 and weight["x"] < 2000 / 3000 and weight["z"] > 100 / 3000
    for s, n in by.items():
        assert abs(n - weight[s] * 3000) <= 1
    times = Counter((r.doc_id, r._source) for r in got)
    assert max(times.values()) - min(n for (_, s), n in times.items() if s == "z") <= 4


def naive_components(texts):
    sets = {k: set(neardup.shingles(t).tolist()) for k, t in texts.items()}
    at, parent = defaultdict(list), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for h in s:
            at[h].append(k)
    for a, b in {(x, y) for v in at.values() for i, x in enumerate(v) for y in v[i + 1 :]}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def test_near_duplicates(docs, texts):
    want, sizes = naive_components(texts)
    rows = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_sparse_links_of_a_large_group_in_blocks(spark, monkeypatch):
    """Copies of one text with changed words, most pairs a little under the threshold, compared in blocks of few."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    group = {}
    for k in range(150):
        words = list(base)
        for i in r.choice(200, r.integers(3, 7), replace=False):
            words[i] = f"x{r.integers(10**6)}"
        group[k] = " ".join(words)
    want, _ = naive_components(group)
    assert 10 < len(set(want.values())) < 140
    got = neardup.near_duplicates(spark.createDataFrame(list(group.items()), "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_components_of_a_long_path(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in neardup.components(e).collect()} == {0}


def naive_winnow(text):
    units = [u for u in re.findall(r"[^\x20\x09-\x0D]{1,8}", text)]
    n = max(0, len(units) - 3) or (1 if units else 0)
    windows = max(1, n - 7) if n else 0
    return n, windows


def test_winnowing(docs, texts):
    for r in fingerprints.edited_likeness(docs).collect():
        picks = [int(p.split("@")[1]) for p in r.fingerprint.split(",")] if r.fingerprint else []
        n, windows = naive_winnow(texts[r.doc_id])
        assert picks == sorted(set(picks)) and len(picks) <= windows
        # the guarantee: no window of eight hashes is without a pick
        assert all(any(i <= p < i + 8 for p in picks) for i in range(0, n - 7))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_sharding(docs, texts):
    rows = sharding.assign(docs).collect()
    at = defaultdict(list)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
        at[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in at.values())


def test_flow_moves_the_least():
    flow = sharding.min_cost_flow([10, 6, 2], [6, 6, 6], lambda i, j: int(i != j))
    assert [sum(x) for x in zip(*flow)] == [6, 6, 6] and sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 4


def test_packing_round_trip(docs, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for k, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        end = 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            end += r.length
        assert end == len(ids)
    pad = 0
    for rs in seq.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
        pad += 0 if end & (end - 1) == 0 else 2048 - end
    assert pad <= 2048 * 4


def test_passages(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    p = words(80)
    fuzzy = [*p]
    for i in (20, 41, 63):
        fuzzy[i] = "changed"
    texts = [words(200) + p + words(100), words(50) + p + words(300), words(10) + fuzzy + words(10), words(400)]
    got = passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in got} == {(1, 0), (2, 0), (2, 1)}
    exact = next(r for r in got if r.doc_id == 1)
    assert (exact.start_word, exact.end_word, exact.ref_start_word, exact.identity) == (50, 130, 200, 1.0)


def test_identity():
    a = np.arange(50, dtype=np.uint64)
    assert passages.identity(a, a) == 1 and passages.identity(a, np.delete(a, 7)) == 1 - 1 / 50
    b = a.copy()
    b[[5, 30]] = 999
    assert passages.identity(a, b) == 1 - 2 / 50


def test_pipeline(spark, texts):
    """Each stage's decisions take effect on all that its predecessor kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        kept.append({r.doc_id: r for r in docs.collect()} if len(kept) < 3 else docs.collect())
    ruled, single, clean, mixed = kept
    assert set(ruled) == {r.doc_id for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    groups, _ = naive_components({k: r.text for k, r in ruled.items()})
    assert set(single) == set(groups.values())
    assert set(clean) == set(single) and all(r.n_chars == len(r.text) for r in clean.values())
    mails = re.compile(r"[\w.+-]+@[\w.-]+\.[a-z]+")
    assert not {m for r in clean.values() for m in mails.findall(r.text)} & {m for r in single.values() for m in mails.findall(r.text)}
    assert {r.doc_id for r in mixed} <= set(clean) and all(r.text == clean[r.doc_id].text for r in mixed)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    pieces = Counter()
    for r in last:
        pieces[r.doc_id] += r.length
    size = {r.doc_id: r.doc_tokens for r in last}
    assert pieces == {k: size[k] * n for k, n in Counter(r.doc_id for r in mixed).items()}
