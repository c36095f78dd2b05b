"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import bpe, jaccard, jpeg, kernels, lm, mixing, quality, samples, substrings, toxicity, urlrules, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "x y z", None, 0), (1, "", "a", 1), (2, None, "a", 2), (3, "  \t\n", "b", 3), (4, "same text here", "b", 4), (4, "same text here", "b", 4), (5, "ß é 日本 🙂 " * 30, "a", 5)]
SCHEMA = "doc_id long, text string, source string, _spans long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, with an extra column whose name an operator uses inside."""
    return spark.createDataFrame([*ODD, (6, "w" * 200_000, "c", 6), (7, "lo " * 60_000, "c", 7)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def words(text):
    return WORD.findall(text or "")


# kernels


def test_words_and_names():
    texts = ["", None, " a  b", "c", "a\u00a0b\u2003c \x0b\x0c d", "x" * 70_000]
    w = kernels.Words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]
    names = dict(zip(sum(got, []), w.hashes().tolist()))
    assert len(set(names.values())) == len(names)
    seq, at = kernels.sequence_hash(w.hashes(), w.first, 2)
    assert len(seq) == sum(max(0, len(words(t)) - 1) for t in texts)


# op1


def brute_trigrams(rows, leave_out, backoff=0.4):
    texts = [(i, words(t)) for i, t in rows]
    grams = lambda t: Counter(tuple(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1))
    every = Counter()
    for _, t in texts:
        every.update(grams(t))
    out = []
    for i, t in texts:
        own = grams(t) if leave_out else Counter()
        total = max(1, sum(len(u) for _, u in texts) - len(t) * leave_out)
        c = lambda g: every[g] - own[g]  # noqa: B023, E731

        def s(gram):
            if len(gram) == 1:
                return c(gram) / total if c(gram) else backoff / total  # noqa: B023
            return c(gram) / c(gram[:-1]) if c(gram) else backoff * s(gram[1:])

        value = sum(math.log(s(tuple(t[max(0, k - 2) : k + 1]))) for k in range(len(t)))
        out.append((i, len(t), round(value, 6), round(value / len(t), 8) if t else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,leave_out", [(8 << 20, True), (4000, True), (8 << 20, False)])
def test_lm(spark, docs, odd, empty, monkeypatch, chunk, leave_out):
    """Also with texts in many chunks, and texts longer than one."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    # more words than 16 bits can number, each twice; texts of one word and of two; one n-gram in every text
    many = " ".join(f"w{k}" for k in range(70_000))
    wide = spark.createDataFrame([(1, many), (2, many + " w3 w3"), (3, "w69999"), (4, "once"), (5, "w3 w4"), (6, "w3 w3"), *((10 + k, f"w1 w2 w3 x{k}") for k in range(50))], "doc_id long, text string")
    for df in (docs, odd, wide) if chunk > 4000 else (docs, odd):
        got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.mean_log_score if r.mean_log_score is None else round(r.mean_log_score, 8)) for r in lm.score(df, leave_out=leave_out).collect()), key=str)
        want = brute_trigrams([(r.doc_id, r.text) for r in df.collect()], leave_out)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-5 * max(1, g[1]) and (g[3] is None) == (w[3] is None) for g, w in zip(got, want))
    assert lm.score(empty, leave_out=leave_out).count() == 0


def test_lm_ids_and_copies(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") + r.choice("klmnopq") for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(f"id{k}", t, k) for k, t in enumerate(texts + texts[:10])], "doc_id string, text string, chunk long")
    got = {x.doc_id: x.mean_log_score for x in lm.score(df).collect()}
    # a text that occurs twice is its copy's evidence; any other one backs off
    twice = [got[f"id{k}"] for k in [*range(10), *range(30, 40)]]
    assert min(twice) > max(got[f"id{k}"] for k in range(10, 30)) + 1
    lone = lm.score(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert abs(lone.log_score - (math.log(0.4) + math.log(0.4**2) + math.log(0.4**3))) < 1e-12


# op2


def brute_repeats(rows, window=50):
    texts, low = [(i, words(t)) for i, t in rows], {}
    for i, w in texts:
        for k in range(len(w) - window + 1) if i is not None else ():
            low[tuple(w[k : k + window])] = min(low.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if low[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 20, 64])
def test_substrings(spark, monkeypatch, hot):
    """With a tiny limit every bucket is split by salt."""
    monkeypatch.setattr(substrings, "HOT_BYTES", hot)
    monkeypatch.setattr(substrings, "HOT_TIMES", 4 if hot > 64 else 0)
    r, vocabulary = random.Random(5), [f"w{i}" for i in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 60, 120, 200)] + [["a"] * 40 + ["b"] * 40, ["x", "y"] * 60, ["z"] * 120]
    rows = []
    for k in range(250):
        w = []
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            at = r.randrange(max(1, len(p) - 48))
            w += [r.choice(vocabulary) for _ in range(r.randrange(40))] + p[at : at + r.randrange(45, 200)]
        rows.append((k * 3, " ".join(w)))
    rows += [(None, " ".join(passages[4])), (0, ""), (7, None), (3001, " ".join(passages[5])), (3001, " ".join(passages[5]))]
    got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute_repeats(rows)


def test_substrings_edges(spark, odd, empty):
    assert sorted([tuple(x) for x in substrings.digests(odd).collect()], key=str) == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    assert substrings.digests(empty).count() == 0
    kept = substrings.dedup(odd).collect()
    assert len(kept) == odd.count()
    twice = spark.createDataFrame([(1, "a b " * 40), (2, "a b " * 40), (3, "c  " + "a b " * 40 + " d")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.dedup(twice).collect()} == {1: "a b " * 40, 3: "c d"}


# op3


def test_url_parts_and_rules(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    cases = [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://Www.Example.COM/en/a?b#c", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("https://b.example.com/en/x", "b.example.com", "/en/x", "example.com/en/", "block"),
        ("https://net/es/", "net", "/es/", "net/es/", "block"),
        ("https://planet/es/", "planet", "/es/", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("x://a.com/?q://b", "a.com", "/", "com/", "allow"),
        ("x://\u00c0B.com#f", "\u00c0b.com", "", None, "allow"),
        ("x://a.net/fr/?", "a.net", "/fr/", "net/fr/", "block"),
        ("x://a.net/fr/" + "y" * 100_000, "a.net", "/fr/" + "y" * 100_000, "net/fr/", "block"),
    ]
    cases.append(cases[-2])
    names = ["hit", "antecedent", "url", "host", "path", "rule", "verdict", "says", "kept", "tokens", "confidence"]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, address string").select("*", *[F.lit(1).alias(c) for c in names])
    mined = spark.createDataFrame([(["path=nowhere"], 1.0, 2.0, 5)], "antecedent array<string>, confidence double, lift double, support long")
    for m in (None, mined, mined.limit(0)):
        got = urlrules.judge(df, m, rules, "address").orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in cases]
    assert urlrules.judge(df.limit(0), mined, rules, "address").count() == 0
    with pytest.raises(ValueError):
        urlrules.judge(df, None, rules, "address", keep=("host",))


def url_tokens(url):
    m = re.match(r"([^#?]*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", url or "", re.S)
    if not m:
        return frozenset()
    scheme, host, path, query, fragment = m.groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    labels, ext = host.split("."), re.search(r"\.([A-Za-z0-9]+)$", path)
    out = {f"scheme={scheme}", f"fragment={fragment or ''}", f"ext={ext[1] if ext else ''}"}
    out |= {"host=" + ".".join(labels[k:]) for k in range(len(labels))} | {f"path={x}" for x in path.split("/") if x}
    out |= {"query=" + x.split("=")[0] for x in (query or "").split("&")}
    return frozenset(t for t in out if not t.endswith("="))


def brute_rules(rows, least, confidence, lift):
    """Every combination of tokens of the bad urls, counted on all labelled urls."""
    held = [(url_tokens(u), b) for u, b in rows if url_tokens(u)]
    good, bad = Counter(), Counter()
    for t, b in held:
        hosts = sorted(x for x in t if x.startswith("host="))
        names = [x for x in t if x not in hosts]
        # one host token at most: a name stands for its parents'
        for size in range(len(names) + 1):
            for part in itertools.combinations(sorted(names), size):
                for host in [(), *[(h,) for h in hosts]]:
                    if part or host:
                        (bad if b else good)[tuple(sorted(part + host))] += 1
    share = sum(b for _, b in held) / max(1, len(held))
    sure = {x: n / (n + good[x]) for x, n in bad.items() if n >= least}
    return {x: (round(c, 9), round(c / share, 9), bad[x]) for x, c in sure.items() if c >= confidence and c / share >= lift}


def test_url_mining_on_whole_tables(spark, sf):
    """The query's own steps against brute force: page labels, mined rules, verdicts; mined rules decide some rows."""
    from latticework.llm.queries import URL_RULES, op3_url_rules

    pages, docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("pages", "documents", "labels"))
    flat = lambda t: "".join(c for c in t or "" if c.isalnum())
    bad_text = {}
    of = {x.doc_id: int(x.toxic == 1 or x.quality == 0) for x in labels if zlib.crc32(str(x.doc_id).encode()) % 4 != 2}
    for d in docs:
        if d.doc_id in of and flat(d.text):
            bad_text[flat(d.text)] = max(bad_text.get(flat(d.text), 0), of[d.doc_id])
    shown = {}
    for p in pages:
        body = re.search(r"<article[^>]*>(.*?)</article>", p.html, re.S)
        shown[p.page_id] = flat(html.unescape(re.sub(r"<h1[^>]*>.*?</h1>|<[^>]*>", " ", body[1] if body else "", flags=re.S)))
    rows = [(p.url, bad_text[shown[p.page_id]]) for p in pages if shown[p.page_id] in bad_text]
    assert len(rows) > len(pages) // 4
    rules = brute_rules(rows, 5, 0.5, 1.5)
    table = spark.createDataFrame(rows, "url string, bad int")
    mined = {tuple(r.antecedent): (round(r.confidence, 9), round(r.lift, 9), r.support) for r in urlrules.mine(table).collect()}
    assert mined == rules and rules
    seen = Counter()
    for r in op3_url_rules(spark, sf).collect():
        url = next(p.url for p in pages if p.page_id == r.page_id)
        fits = [(c, n, x) for x, (c, _, n) in rules.items() if set(x) <= url_tokens(url)]
        if r.rule is None:
            assert r.verdict == ("block" if fits else "allow") and (tuple(r.antecedent) == max(fits)[2] if fits else r.antecedent is None)
            seen[r.verdict] += 1
        else:
            assert r.verdict == dict(URL_RULES)[r.rule] and r.antecedent is None
    assert seen["block"] and seen["allow"]


def test_url_mining_edges(spark):
    bare = spark.createDataFrame([], "url string, bad int")
    assert urlrules.mine(bare).count() == 0
    assert urlrules.mine(spark.createDataFrame([("http://a.b/c", 1)] * 9, "url string, bad int")).count() == 0
    rows = [("http://a.org/x", 1)] * 5 + [("http://b.org/x", 0)] * 5 + [(None, 1), (None, 0), ("plain", 1), ("http://c.org/y", None)]
    got = {tuple(r.antecedent): r.confidence for r in urlrules.mine(spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert ("host=a.org",) in got and got[("host=a.org",)] == 1.0 and not any("host=org" in x for x in got)
    # rules beyond the broadcast limit are joined
    pages = spark.createDataFrame([(1, "http://a.org/x", 3), (1, "http://a.org/x", 3), (2, "http://b.org/x", 3)], "page_id long, url string, hit int")
    mined = urlrules.mine(spark.createDataFrame(rows, "url string, bad int"))
    for most in (0, 20_000):
        urlrules.BROADCAST_RULES = most
        assert sorted((r.page_id, r.verdict) for r in urlrules.judge(pages, mined, []).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    texts = spark.createDataFrame([(1, "A b-c"), (2, None), (None, "d"), (4, ""), (5, "Abc"), (5, "Abc")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (5, 1), (4, 1), (2, 1), (None, 1), (5, None)], "doc_id long, bad int")
    shown = spark.createDataFrame([(1, "u", "<article class=x><h1>t</h1><p>a</p> &amp; B&#39;c</article>"), (2, None, "<article>A bc</article>"), (3, "v", None), (4, "w", "")], "page_id long, url string, html string")
    assert [tuple(r) for r in urlrules.page_labels(shown, texts, marks).collect()] == [(2, None, 1)]


# op4


def test_block_max_is_exact():
    r = np.random.default_rng(3)
    table = np.zeros((700, 60))
    for k in range(700):
        t = r.choice(60, r.integers(1, 12), replace=False)
        table[k, t] = r.random(len(t)) * np.where(t < 10, 0.1, 1)
    table[5:9] = table[4]
    table /= np.sqrt((table * table).sum(axis=1, keepdims=True))
    cut = np.append(0, np.cumsum((table > 0).sum(axis=1)))
    term, weight = np.nonzero(table)[1], table[table > 0]
    for common in (1 / 48, 2.0, 0.0):  # some terms bounded by block, none, all that more than a block of examples hold
        toxicity.COMMON, old = common, toxicity.COMMON
        index = toxicity.BlockMaxIndex(cut, term, weight, 60)
        toxicity.COMMON = old
        found = index.nearest(cut, term, weight, 9, skip=np.arange(700))
        for k in range(700):
            s = np.round(table @ table[k], 12)
            s[k] = 0
            want = [e for e in np.lexsort((np.arange(700), -s)) if s[e] > 0][:9]
            assert found[k][0].tolist() == want and np.allclose(found[k][1], s[want], atol=1e-9)
    few = toxicity.BlockMaxIndex(cut[:4], term[: cut[3]], weight[: cut[3]], 60)
    assert len(few.nearest(np.array([0, 0, 1]), term[:1], weight[:1], 15)) == 2


def brute_toxicity(rows, marks):
    """Scores by plain loops over whole vectors; texts share no three words, so every text is an example of its own."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = {i: Counter(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower(t))) for i, t in rows}
    ex = sorted((i, y) for i, y in marks if not held(i) and i in terms)
    n = Counter(y for _, y in ex)
    known = set().union(*(terms[i] for i, _ in ex))
    df = Counter(w for i in terms for w in terms[i] if w in known)
    weight = {}
    for w in known:
        p1, p0 = (sum(1 for i, y in ex if y == k and w in terms[i]) / n[k] for k in (1, 0))
        share = (p1 * n[1] + p0 * n[0]) / len(ex)
        chi = (p1 - p0) ** 2 / (share * (1 - share) * (1 / n[1] + 1 / n[0])) if share < 1 else 0
        weight[w] = (math.log((1 + len(rows)) / (1 + df[w])) + 1) * (1 + max(chi - 10, 0) / 30)

    def vector(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in terms[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = [vector(i) for i, _ in ex]
    rate = n[1] / len(ex)

    def vote(v, skip=None):
        near = sorted((-round(sum(x * u.get(w, 0) for w, x in v.items()), 12), k) for k, u in enumerate(vectors) if k != skip)[:15]
        near = [(-s, k) for s, k in near if s < 0]
        w = [1 / (1.05 - min(s, 1)) for s, _ in near]
        p = (sum(x for x, (_, k) in zip(w, near) if ex[k][1]) + 0.05 * rate) / (sum(w) + 0.05) if near else None
        return (None if p is None else math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))), [(ex[k][0], s) for s, k in near[:5]]

    x, y = zip(*[(vote(v, k)[0], ex[k][1]) for k, v in enumerate(vectors) if vote(v, k)[0] is not None])
    slope, shift = toxicity._platt(np.array(x), np.array(y, dtype=float), np.ones(len(x)))
    out = {}
    for i in terms:
        s, near = vote(vector(i))
        out[i] = (rate, []) if s is None else (1 / (1 + math.exp(-(slope * s + shift))), near)
    return out


def test_toxicity_is_brute_force(spark):
    r = random.Random(8)
    plain = [f"w{k}" for k in range(400)]
    rows, marks = [], []
    for k in range(160):
        t = [r.choice(plain) for _ in range(30)] + [f"own{k}", f"OWN{k}", f"own{k}."]
        if k % 4 == 0:
            t[r.randrange(30)] = r.choice(["Vile,", "(scum)", "vile"])
        rows.append((k, " ".join(t)))
        if k % 5:
            marks.append((k, int(k % 4 == 0)))
    rows += [(900, ""), (901, None), (902, "nothing known"), (903, "VILE")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    want = brute_toxicity(rows, marks)
    for x in toxicity.score(df, toxicity.fit(df, lab)).collect():
        assert abs(x.score - want[x.doc_id][0]) < 1e-9
        assert [e.doc_id for e in x.evidence] == [i for i, _ in want[x.doc_id][1]]
        assert all(abs(e.cosine - s) < 1e-9 for e, (_, s) in zip(x.evidence, want[x.doc_id][1]))


def test_toxicity_held_out(spark):
    r = random.Random(2)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for k in range(1200):
        t = [r.choice(plain) for _ in range(40)]
        toxic = r.random() < 0.2
        if toxic:
            t.insert(r.randrange(40), r.choice(["vileling", "vilest", "scumm"]))
        rows.append((k, " ".join(t)))
        marks.append((k, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).join(lab, "doc_id").where(samples.held_out(F.col("doc_id"))).collect()
    assert sum((g.score >= 0.3) == (g.toxic == 1) for g in got) / len(got) > 0.95
    assert all(0 <= g.score <= 1 for g in got)


def test_toxicity_rare_words(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["green", "house", "river", "stone", "cloud"]) for _ in range(20))) for k in range(300)]
    # each toxic text has words of its own, so no word of theirs depends on the label beyond chance
    rows += [(1000 + k, " ".join(f"{chr(97 + k)}{chr(97 + j)}zq" for j in range(12))) for k in range(20)]
    copies = [(2000 + k, rows[300 + k][1]) for k in range(20)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    learned = {x.doc_id for x in samples.learnable(lab, "toxic").collect()}
    got = {x.doc_id: x for x in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    for k in range(20):
        if 1000 + k in learned:
            e = got[2000 + k].evidence
            assert (e[0].doc_id, round(e[0].cosine, 9), e[0].toxic) == (1000 + k, 1.0, 1) and got[2000 + k].score >= 0.3
    assert all(got[k].evidence and got[k].score < 0.3 for k in range(300))


def test_classifier_edges(spark, odd, empty, docs, labels):
    bare = labels.limit(0)
    for df in (odd, empty):
        t = toxicity.score(df, toxicity.fit(docs, labels)).collect()
        assert len(t) == df.count() and all(0 <= x.score <= 1 for x in t)
        q = quality.score(df, quality.fit(docs, labels)).collect()
        assert len(q) == df.count() and all(0 <= x.score <= 1 for x in q)
    assert {x.score for x in toxicity.score(odd, toxicity.fit(odd, bare)).collect()} == {0.0}
    assert {x.score for x in quality.score(odd, quality.fit(odd, bare)).collect()} == {0.5}


def test_held_out_labels_teach_nothing(spark, docs, labels):
    flipped = labels.withColumn("toxic", F.when(samples.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


# op5


def test_vptree(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 12)) * r.random((700, 1))
    x[100:130] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0]), (40, x[40].tolist()), (904, [None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), 7, 1.0).orderBy("query_id", "rank").collect()
    want = []
    for q in range(0, 700, 20):
        s = (x * x[q]).sum(axis=1)
        best = [k for k in np.lexsort((np.arange(700), -s)) if k != q][:7]
        want += [(q, n + 1, int(k)) for n, k in enumerate(best)]
    assert [(g.query_id, g.rank, g.vec_id) for g in got] == want
    few = df.where("vec_id < 3")
    # several shards, and shards of several parts: exact with factor 1, equal vectors and repeated ids too
    for shard, ahead in ((64, 2), (20, 1), (300, 1)):
        monkeypatch.setattr(vptree, "SHARD", shard)
        monkeypatch.setattr(vptree, "AHEAD", ahead)
        got = vptree.nearest(df, df.where("vec_id % 20 = 0"), 7, 1.0).orderBy("query_id", "rank").collect()
        assert [(g.query_id, g.rank, g.vec_id) for g in got] == want
    assert vptree.nearest(few, few, 20).count() == 6
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_vptree_equal_vectors(spark, monkeypatch):
    """One vector in most rows: its smallest ids come first, whatever the shards."""
    monkeypatch.setattr(vptree, "SHARD", 50)
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(400)] + [(400 + k, [float(k), 1.0, 0.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, df.where("vec_id in (3, 300)"), 5, 1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    far = [(459 - k, float(59 - k)) for k in range(5)]
    assert got == {3: far, 300: far}
    near = vptree.nearest(df.where("vec_id < 400"), df.where("vec_id in (3, 300)"), 5, 1.0).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == [(3, 0), (3, 1), (3, 2), (3, 4), (3, 5), (300, 0), (300, 1), (300, 2), (300, 3), (300, 4)]


@pytest.mark.parametrize("shard", [8192, 50])
def test_vptree_recall(spark, sf, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact, near = ({(r.query_id, r.vec_id) for r in vptree.nearest(v, v.where("vec_id % 20 = 0"), 20, f).collect()} for f in (1.0, 1.2))
    assert len(exact & near) >= 0.9 * len(exact)


# op6


def brute_components(rows, n, percent):
    sets = []
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min((v for v in (low.get(find(k)), i) if v is not None), default=None)
    return sorted(((i, len(s), None if i is None else low[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 9, 12, 30, 100, 200]))] for _ in range(25)]
    rows = []
    for k in range(350):
        w = list(r.choice(bases[:4] if k % 2 else bases))
        for _ in range(r.choice([0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k * 3, " ".join(bases[24] + w if k % 9 == 0 else w)))
    rows += [(5000, ""), (5001, None), (5002, "a"), (5003, "A"), (5004, "a b"), (5005, " A  B "), (5005, " A  B ")]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute_components(rows, n, percent)


def test_jaccard_edges(spark, odd, empty):
    got = sorted([tuple(x) for x in jaccard.components(odd).collect()], key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()], 3, 90)
    assert jaccard.components(empty).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns
    with pytest.raises(ValueError):
        jaccard.components(odd, percent=50)


def test_keep_one_row_of_each_class(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "y"), (7, b + " c", "y"), (7, b + " c", "y"), (None, a, "x"), (None, "d e f", "z"), (None, "d e f", "z"), (9, "", "x"), (9, "", "x"), (None, None, "x")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, gone string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a, "x"), (5, b, "y"), (None, "d e f", "z"), (9, "", "x"), (9, "", "x"), (None, None, "x")], key=str)


def test_jaccard_in_many_blocks(spark, monkeypatch):
    """Near copies that one hot n-gram joins, in blocks of eight sets."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SQUARE", 2)
    r = random.Random(9)
    base = [[f"{g}w{k}" for k in range(60)] for g in range(3)]
    rows = []
    for k in range(150):
        w = list(base[k % 3])
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"x{r.randrange(500)}"
        rows.append((k, " ".join(w)))
    for n, percent in ((3, 90), (5, 80)):
        got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert sorted([tuple(x) for x in got], key=str) == brute_components(rows, n, percent)


def test_block_product():
    r = np.random.default_rng(2)
    left, right = ([np.unique(r.integers(0, 40 if k % 2 else 4000, 30).astype(np.uint64)) for k in range(m)] for m in (90, 70))
    assert (jaccard.product(left, right) == [[len(np.intersect1d(a, b)) for b in right] for a in left]).all()


# op7


def test_jpeg_round_trip(spark, odd, empty):
    for df in (odd, empty):
        rows = jpeg.stored_documents(df, with_media=True).collect()
        assert len(rows) == df.count()
        texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        for r in rows:
            raw = texts[r.doc_id]
            raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(raw))
            assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.media_bytes == len(r.media)


def test_jpeg_feature_is_brute_force(spark, docs):
    rows = [(1, "a"), (2, None), (3, "a"), (4, "xyz " * 700), (5, "\u00e9" * 3000), *((10 + r.doc_id, r.text) for r in docs.limit(20).collect())]
    got = {r.doc_id: r.feature for r in jpeg.stored_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        high = len(raw) // 576
        mean, bits = sum(raw) / len(raw), ""
        for y in range(8):
            for x in range(8):
                part = [raw[r * 576 + c] for r in range(y * high // 8, max((y + 1) * high // 8, y * high // 8 + 1)) for c in range(x * 72, x * 72 + 72)]
                bits += "1" if sum(part) / len(part) > mean + 1e-9 else "0"
        assert got[i] == f"4608x{high * 8}:{int(bits, 2):016x}"
    assert got[1] == got[3]


def test_jpeg_reader():
    """Images without restart markers, with AC codes, three components, and broken ones."""
    dc, ac = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))), (bytes([0, 2, 1] + [0] * 13), bytes([0x00, 0x01, 0xF0]))
    codes = [jpeg._codes(*t) for t in (dc, ac)]

    def build(parts, diffs, restart=0):
        bits = ""
        for d in diffs:
            size = abs(d).bit_length()
            c, n = codes[0][size]
            bits += format(c, f"0{n}b") + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
            for symbol, extra in ((0x01, "1"), (0xF0, ""), (0x00, "")):
                c, n = codes[1][symbol]
                bits += format(c, f"0{n}b") + extra
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
        frame = b"".join(bytes([k + 1, s, 0]) for k, s in enumerate(parts))
        scan = b"".join(bytes([k + 1, 0]) for k in range(len(parts)))
        return b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, bytes([8, 0, 16, 0, 16, len(parts)]) + frame) + seg(0xC4, b"\0" + b"".join(dc) + b"\x10" + b"".join(ac)) + seg(0xDA, bytes([len(parts)]) + scan + b"\0\x3f\0") + data + b"\xff\xd9"

    gray = build([0x11], [10, -3, 0, 20])
    colour = build([0x22, 0x11, 0x11], [10, -3, 0, 20, 5, -5])
    seen = jpeg.read([gray, colour, b"", b"junk", gray[:60], gray.replace(b"\xff\xc0", b"\xff\xc2")])
    want = [[128 + 20, 128 + 14], [128 + 14, 128 + 54]]
    assert seen[0][0].thumbnail.tolist() == want and seen[1][0].thumbnail.tolist() == want
    assert [s[0].status for s in seen[2:]] == ["no_image", "no_image", "broken", "unsupported"]


# op8


def test_bpe_is_the_public_coding(spark, docs, odd, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = ["a", "s", "'", "t", "l", "d", " ", "  ", "\n", "\t", "1", "é", "!", "r", "e", "v", "m", "日", "\u3000", "\x85", "\u200b", "²"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)] + ["it's", "''s", "x\n\n y", "a" * 3000, "<|endoftext|>"]
    ours = bpe.coder(path)
    ids, at = ours.encode(pa.array(texts))
    back, to = ours.decode(ids, at)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == theirs.encode_ordinary(t)
        assert back[to[k] : to[k + 1]].tobytes() == t.encode()
    for df in (docs, odd, empty):
        want = {}
        for x in df.collect():
            own = theirs.encode_ordinary(x.text or "")
            want[x.doc_id] = (len(own), hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest())
        got = bpe.digest_documents(df, path).collect()
        assert len(got) == df.count() and all(want[g.doc_id] == (g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got)


def test_bpe_refuses_other_patterns():
    import public_tokenizers

    bpe.check_pattern(public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        bpe.check_pattern(r"\S+|\s+")


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000):
        keys = kernels.mix(np.arange(n, dtype=np.uint64))
        h = bpe.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(n)) and (h.find(keys) == np.arange(n)).all()
        assert (h.find(kernels.mix(np.arange(n, n + 50, dtype=np.uint64))) == -1).all()


# op9


def brute_mix(rows):
    size = [len(words(t)) for _, t, _ in rows]
    order = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total, weight = Counter(), {s: k % 3 + 1 for k, s in enumerate(order)}
    for n, (*_, s) in zip(size, rows):
        total[s] += n
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped) or 1
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    return size, total, target


def test_mixing(spark, docs, odd, empty):
    r = random.Random(4)
    made = spark.createDataFrame([(k, "w " * r.randrange(1, 40), f"s{min(k % 60, 9)}" if k % 70 else None, 0) for k in range(2500)], SCHEMA)
    for df in (odd, made):
        rows = [(x.doc_id, x.text, x.source) for x in df.collect()]
        size, total, target = brute_mix(rows)
        got = mixing.plan_mix(df).collect()
        assert Counter((g.doc_id, g["size"], g.source) for g in got) == Counter((i, n, s) for (i, _, s), n in zip(rows, size))
        largest = Counter()
        taken = Counter()
        for g in got:
            assert g.source_size == total[g.source] and abs(g.target - target[g.source]) < 1e-6 * (1 + g.target)
            assert 0 <= g.taken <= 3 * g["size"]
            largest[g.source] = max(largest[g.source], g["size"])
            taken[g.source] += g.taken
        assert all(abs(taken[s] - target[s]) <= max(largest[s], 4) for s in total)
    assert sorted(got, key=str) == sorted(mixing.plan_mix(made.repartition(3)).collect(), key=str)
    assert mixing.plan_mix(empty).count() == 0
    # rows of one id and of none, equal ones too: each source still comes within a document of its target
    same = spark.createDataFrame([(i, "w " * 10, s, 0) for i, s in ((7, "a"), (None, "b")) for _ in range(500)], SCHEMA)
    other = spark.createDataFrame([(i, "w " * 9 + f"x{k}", s, 0) for i, s in ((7, "a"), (None, "b")) for k in range(500)], SCHEMA)
    for df in (same, other):
        taken = {x.source: (x.n, x.t) for x in mixing.plan_mix(df).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()}
        assert all(abs(n - t) <= 10 for n, t in taken.values()) and len(taken) == 2
        back = {x.source: x["count"] * 10 for x in mixing.mix(df).groupBy("source").count().collect()}
        assert back == {s: n for s, (n, _) in taken.items()}
    mixed = mixing.mix(made)
    assert mixed.columns == made.columns and mixed.count() == sum(g.taken // g["size"] for g in got if g["size"])


# clashing names


def test_extra_columns_pass(spark, docs, labels):
    """Every name that an operator uses inside, as an extra column of its input."""
    names = ["_spans", "spans", "_of", "of", "size", "h", "times", "times_of", "times_p", "times_per", "_words", "_times", "_copy", "_toxicity", "score", "gone", "_gone", "k", "comp", "node", "n", "id", "text_hash", "s", "p", "cut", "extra", "copies", "bucket", "chunk", "ids"]
    wide = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    model = toxicity.fit(wide, labels)
    for out in (substrings.dedup(wide), mixing.mix(wide), toxicity.keep_clean(wide, model, 0.3), jaccard.keep_one(wide)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == k for r in rows for k, c in enumerate(names))
    for out in (lm.score(wide), substrings.digests(wide), jaccard.components(wide), toxicity.score(wide, model), mixing.plan_mix(wide)):
        assert out.count() == docs.count()


# op10


def test_pu_learning():
    r = np.random.default_rng(0)
    good, bad = r.normal(1.0, 1, (1500, 6)).astype(np.float32), r.normal(-1.0, 1, (600, 6)).astype(np.float32)
    m = quality.fit_pu(good[:700], np.concatenate([good[700:], bad[:400]]))
    assert abs(m.prior - 2 / 3) < 0.12
    assert (m.score(good[700:]) >= 0.5).mean() > 0.9 and (m.score(bad[400:]) < 0.5).mean() > 0.9


def test_quality_score_is_brute_force(spark, odd):
    """Features by plain loops over bytes and words, then the model's formula."""
    marks = b"!|%$&*#?.,;:-'<{=@"

    def kind(b):
        if b in marks:
            return 9 + marks.index(b)
        if 97 <= b < 123:
            return 0
        return 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b in (9, 32) else 4 if b in (10, 13) else 5 if b < 32 else 6 if 128 <= b < 192 else 7 if b >= 192 else 8

    r = np.random.default_rng(4)
    width = quality.WIDTH
    m = quality.QualityModel(r.random(width).astype(np.float32) * 0.1, (0.1 + r.random(width)).astype(np.float32), r.normal(size=width).astype(np.float32), 0.25, 0.5)
    texts = spark.createDataFrame([(1, "The quick  brown fox!"), (2, "a a b a b a"), (3, "x" * 40 + " y"), (4, "<a> {b} = 'c'\n\t1,2;3"), (5, "x" * 40 + " y")], "doc_id long, text string")
    for df in (texts, odd.select("doc_id", "text").where("length(text) < 1000 or text is null")):
        want = Counter()
        for i, t in [(x.doc_id, x.text) for x in df.collect()]:
            raw, w = (t or "").encode(), words(t)
            f = np.zeros(width)
            for a, b in zip(raw, raw[1:]):
                f[kind(a) * quality.CLASSES + kind(b)] += 1
            f[: -quality.STATS] = np.sqrt(f[: -quality.STATS] / max(len(raw) - 1, 1))
            n = max(len(w), 1)
            sizes = [len(x.encode()) for x in w]
            same = [sum(a == b for a, b in zip(w, w[k:])) / n for k in (1, 2)]
            f[-quality.STATS :] = [math.log1p(len(w)) / 10, min(sum(sizes) / n, 40) / 10, len(set(w)) / n, *same, sum(x > 25 for x in sizes) / n]
            z = float(np.clip((f - m.mean) / m.scale, -8, 8) @ m.weights + m.bias)
            want[i, round(1 / (1 + math.exp(-z)), 4)] += 1
        got = Counter((x.doc_id, round(x.score, 4)) for x in quality.score(df, m).collect())
        near = lambda a, b: all(any(i == j and abs(s - u) < 2e-3 for j, u in b) for i, s in a)
        assert sum(got.values()) == sum(want.values()) and near(got, want) and near(want, got)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(samples.held_out(F.col("doc_id"))).collect()
    assert sum((g.score >= 0.7) == (g.quality == 1) for g in got) / len(got) > 0.9


# SQL


@pytest.mark.parametrize("name", ["op1_stupid_backoff", "op2_substring_dedup", "op6_ngram_jaccard", "op9_mixing"])
def test_query_matches_sql(spark, sf, name):
    import duckdb

    from latticework.llm import oracles, queries

    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    df, rows = queries.queries()[name](spark, sf), c.sql(oracles.SQL[name])
    assert sorted(rows.columns) == sorted(df.columns)
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    at = [rows.columns.index(k) for k in df.columns]
    assert sorted(tuple(repr(plain(v)) for v in r) for r in df.collect()) == sorted(tuple(repr(plain(r[k])) for k in at) for r in rows.fetchall())


# pipeline


def test_pipeline_edges(spark, odd, empty, sf):
    import corpus_pipeline as c

    again = odd.unionByName(odd)
    for df in (empty, again):
        now = df
        for _, stage in c.STAGES:
            now = stage(spark, now, sf)
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() == 0) == (df is empty)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as c
    import public_tokenizers
    import tiktoken

    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "mixing", "byte_bpe"]
    now = docs
    for k, (name, stage) in enumerate(c.STAGES):
        before, now = now, stage(spark, now, sf)
        now = spark.createDataFrame(now.collect(), now.schema)
        if k < 4:
            assert now.columns == docs.columns
        old = {r.doc_id: r for r in before.collect()}
        new = now.collect()
        if name in ("toxicity", "ngram_jaccard"):
            assert all(tuple(r) == tuple(old[r.doc_id]) for r in new)
        if name == "ngram_jaccard":
            want = {i for i, n, comp in brute_components([(r.doc_id, r.text) for r in old.values()], 5, 80) if comp == i or not n}
            assert {r.doc_id for r in new} == want
        if name == "substring_dedup":
            lost = {i: (n, g) for i, n, g, _ in brute_repeats([(r.doc_id, r.text) for r in old.values()])}
            assert {r.doc_id: len(words(r.text)) for r in new} == {i: n - g for i, (n, g) in lost.items() if not g or g < n}
        if name == "mixing":
            size, _, target = brute_mix([(r.doc_id, r.text, r.source) for r in old.values()])
            big = max(size)
            got = Counter()
            for r in new:
                got[r.source] += len(words(r.text))
            assert all(abs(got[s] - t) <= big for s, t in target.items())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(np.frombuffer(r.ids, dtype="<u4").tolist() == theirs.encode_ordinary(r.text) for r in now.collect())
    assert c.run(spark, sf).count() == now.count()
