"""The ten operators against brute force, round trips and held-out accuracy, and on awkward tables."""

from __future__ import annotations

import hashlib
import html as H
import os
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import common, html_text, jaccard, language, media, mixing, packing, quality, registry, toxicity, url_filters, warc
from factloom.llm import words as W
from factloom.session import ship

from ..oracle import duck, duck_rows, spark_rows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ENGLISH = "the house and the garden with a river that was there before them and for us all in one of those places " * 4
AWKWARD = [
    (1, ENGLISH, "en", "src0"),
    (1, ENGLISH, "en", "src0"),
    (2, None, None, None),
    (None, "a b c", "fr", "src1"),
    (None, None, None, None),
    (3, "", "de", ""),
    (4, " \t\n\x0b\x0c\r ", "xx", "src1"),
    (5, LONG, "en", None),
    (6, "Ünïcödé 漢字 🙂 \x85 a\u00a0b word", "es", "src1"),
    (7, ENGLISH.upper(), "EN-us", "src0"),
]
CLASH = ["score", "n", "key", "host", "e", "p", "row", "component_id", "size", "taken", "shard", "value", "n_chars"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, more columns whose names operators use."""
    df = ship(spark).createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, sf, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == duck_rows(duck(sf), registry.ORACLE_SQL[name])


# -- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b.é漢", max_size=30)), max_size=6))
def test_words_and_grams(texts):
    w = W.words(pa.array(texts, pa.string()), fold=True)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want = [SPLIT.findall(low(t)) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    ids = {}
    for h, x in zip(w.hashes.tolist(), [y for x in want for y in x], strict=True):
        assert ids.setdefault(x, h) == h
    assert len(set(ids.values())) == len(ids)
    g, at = W.all_grams(w, 3)
    for i, x in enumerate(want):
        assert (g[at[i] : at[i + 1]] == W.grams(w.hashes[w.first[i] : w.first[i + 1]], 3)).all()
        assert at[i + 1] - at[i] == (max(1, len(x) - 2) if x else 0)


# -- 1 language ID


def test_language_held_out(spark, docs):
    model = language.train(docs.filter("doc_id % 2 = 0"))
    test = docs.filter("doc_id % 2 = 1").select("doc_id", "text", F.lit(False).alias("html"), F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host"), "lang")
    got = language.identify(test, model, ["doc_id", "lang"]).filter("kept")
    assert got.filter("language = lang").count() >= 0.98 * test.count()


def test_language_evidence(spark):
    """Short texts follow their host, its domain and their country; a declared language weighs against them; junk is rejected."""
    sample = [(i, t, lang) for i, (t, lang) in enumerate([("aab aba baa abb", "xx"), ("aab aba baa abc", "yy")] * 20)]
    model = language.train(ship(spark).createDataFrame(sample, "doc_id long, text string, lang string"))
    rows = [(i, "aab abb", "www.one.org", "xx") for i in range(30)] + [(100, "aab", "www.one.org", None), (101, "aab", "new.one.org", None), (102, "aab", "www.one.org", "yy"), (103, "123 !!", "www.one.org", "xx"), (104, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, host string, declared string").withColumn("html", F.lit(False))
    got = {r.id: r for r in language.identify(df, model, ["id"]).collect()}
    assert got[100].language == "xx" and got[101].language == "xx" and got[100].posterior > got[101].posterior > 0.5
    assert got[102].posterior < got[100].posterior or got[102].language == "yy"
    assert (got[103].language, got[103].kept) == ("und", False) and (got[104].language, got[104].kept) == ("und", False)


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    " ".join("bcdfghjklmnpqrstvwxz"[(7 * i * i + 3 * i) % 20] * (i % 2 + 1) + "qxzkvwjp"[i * i % 8] + "bcdfghjklm"[i * 3 % 10] for i in range(300)),
    "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[x] for x in np.random.default_rng(3).integers(0, 64, 2000)),
]


def test_language_rejects_what_fits_none(spark, docs):
    """Foreign languages, other scripts, consonants and base64; the documents themselves stay."""
    model = language.train(docs)
    df = ship(spark).createDataFrame(list(enumerate(FOREIGN)), "id long, text string")
    df = df.select("id", "text", F.lit(False).alias("html"), F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host"))
    assert not language.identify(df, model, ["id"]).filter("kept or language <> 'und'").count()


def test_language_learns_every_label(spark):
    """Also labels past the 64 most frequent."""
    name = lambda i: "abcdefghij"[i // 10] + "klmnopqrst"[i % 10]
    word = lambda i: f"{name(i)}{name(i)}a {name(i)}o{name(i)}"
    df = ship(spark).createDataFrame([(i, word(i % 70), name(i % 70)) for i in range(210)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == sorted(name(i) for i in range(70))
    got = language.identify(df.select("doc_id", "lang", "text", F.lit(False).alias("html"), F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host")), model, ["doc_id", "lang"])
    assert got.filter("kept and language = lang").count() == 210


def plain_language(sample, rows):
    """Of (text, label) samples and (id, text, declared, host) rows: posteriors by plain sums over dictionaries."""

    def grams(t):
        raw = b" " + (t or "").encode() + b" "
        fold = [32 if x < 128 and not chr(x).isalpha() else x + 32 if 65 <= x <= 90 else x for x in raw]
        return [((fold[i - 1] << 16 | fold[i] << 8 | fold[i + 1]) * 2654435769 % (1 << 32)) >> 16 for i in range(1, len(fold) - 1) if fold[i] != 32]

    names = sorted({x for _, x in sample})
    counts = {x: Counter() for x in names}
    for t, x in sample:
        counts[x].update(grams(t))
    total = {x: 0.1 * 65536 + sum(c.values()) for x, c in counts.items()}
    damp = lambda n: 1 + n / 60.0
    wrong = np.log(max(0.1 / max(1, len(names) - 1), 1e-6))
    normal = lambda v: (lambda e: e / e.sum())(np.exp(v - v.max()))
    e, n = {}, {}
    for k, t, declared, _ in rows:
        g = grams(t)
        v = np.array([sum(np.log((0.1 + counts[x][c]) / total[x]) for c in g) for x in names]) / damp(len(g))
        v = v - v.max()
        if declared in names:
            v = v + wrong
            v[names.index(declared)] += np.log(0.9) - wrong
        e[k], n[k] = v, len(g)
    soft = {k: normal(e[k]) * (n[k] > 0) for k in e}
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]
    of = lambda part, value: [k for k, _, _, h in rows if part(h) == value]
    out = {}
    for k, _, _, h in rows:
        if not n[k]:
            out[k] = None
            continue
        sums = lambda ks: (sum((soft[j] for j in ks), np.zeros(len(names))), float(sum(n[j] > 0 for j in ks)))
        c, m = sums([r[0] for r in rows])
        up = (c + 1.0) / (m + len(names))
        for part in (suffix, domain):
            c, m = sums(of(part, part(h)))
            up = (c + 5.0 * up) / (m + 5.0)
        c, m = sums(of(lambda x: x, h))
        out[k] = normal(e[k] + np.log((np.maximum(c - soft[k], 0) + 5.0 * up) / (max(m - 1, 0) + 5.0)))
    return names, out


def test_language_by_plain_sums(spark):
    """Every posterior against a plain version of likelihoods, declarations and the priors of host, domain and suffix."""
    rng = np.random.default_rng(8)
    text = lambda w: " ".join("".join(rng.choice(list(w), 3)) for _ in range(rng.integers(1, 5)))
    sample = [(text(w), x) for w, x in (("abc", "xx"), ("bcd", "yy"), ("cde", "zz")) for _ in range(30)]
    hosts = ["www.one.org", "a.one.org", "two.org", "b.three.net", ""]
    rows = [(i, text("abcde"), [None, "xx", "yy", "qq"][int(rng.integers(0, 4))], hosts[int(rng.integers(0, 5))]) for i in range(80)] + [(80, None, "xx", "two.org"), (81, "12", None, "two.org")]
    model = language.train(ship(spark).createDataFrame([(i, t, x) for i, (t, x) in enumerate(sample)], "doc_id long, text string, lang string"))
    model.least = np.full(3, -np.inf)  # what fits no language is tested elsewhere
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string").withColumn("html", F.lit(False))
    got = {r.id: r for r in language.identify(df, model, ["id"]).collect()}
    names, want = plain_language(sample, rows)
    for k, q in want.items():
        if q is None:
            assert (got[k].language, got[k].kept) == ("und", False)
        else:
            assert got[k].posterior == pytest.approx(q.max(), abs=1e-5)
            assert got[k].language == (names[int(q.argmax())] if q.max() >= language.MIN_POSTERIOR else "und") or np.sort(q)[-1] - np.sort(q)[-2] < 1e-6


def test_language_awkward(spark, awkward):
    out = language.identify(language.of_documents(awkward), language.train(awkward), ["doc_id"])
    assert out.count() == len(AWKWARD) and not out.filter("doc_id in (2, 3, 4) and kept").count()
    assert language.identify(language.of_documents(empty(awkward)), language.train(empty(awkward)), ["doc_id"]).count() == 0
    assert language.identify(language.of_documents(awkward), language.train(empty(awkward)), ["doc_id"]).filter("kept").count() == 0


# -- 2 URL filters


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab/*?.", max_size=8), max_size=30), st.lists(st.text(alphabet="ab/.", max_size=12), min_size=1, max_size=5))
def test_automaton(globs, texts):
    def regex(g):
        out = ""
        for part in re.findall(r"\*\*+|\*|\?|[^*?]", g):
            out += {"*": "[^/]*", "?": "[^/]"}.get(part, "(?s:.)*" if part.startswith("**") else re.escape(part))
        return re.compile(out)

    got = url_filters.Automaton(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[bool(regex(g).fullmatch(t)) for g in globs] for t in texts]


def test_one_very_long_url():
    """A million bytes, alone and among short ones."""
    globs, began = [r.glob for r in url_filters.RULES], time.time()
    machine, long = url_filters.Automaton(globs), b".x.net/" + b"a/b" * 330_000 + b".exe"
    assert machine.match([long])[0].tolist() == [g == "**.exe" for g in globs] and time.time() - began < 5
    some = [b".example.org/es/x", long, b"", b".x.com/de/1", long[:-1], *(f".h{i}.com/{'p' * i}.zip".encode() for i in range(40))]
    assert (machine.match(some) == np.concatenate([machine.match([x]) for x in some])).all()


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1x?y", "x://example.org", "x://com/fr/", "x://notexample.org/es/", "x://a.net/p/cgi-bin/x", "x://e.com/de/?q", "x://É.com/fr/a", "x://h.net/" + "a" * 5000 + ".zip", "a://b.org://c/"]
    df = ship(spark).createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)] * 2, "page_id long, url string, host int, rule string")
    got = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.example.org", "/en/1x", "example.org/en/1", "block"), 5: ("example.org", "", None, "allow"), 6: ("com", "/fr/", "com/fr/", "allow"), 7: ("notexample.org", "/es/", "org/", "allow"),
        8: ("a.net", "/p/cgi-bi", None, "block"), 9: ("e.com", "/de/", "com/de/", "block"), 10: ("É.com", "/fr/a", "com/fr/", "allow"), 11: ("h.net", "/aaaaaaaa", None, "block"), 12: ("b.org:", "//c/", None, "allow"),
    }
    assert url_filters.judge(df).count() == 2 * len(urls) and url_filters.judge(empty(df)).count() == 0


# -- 3 toxicity


def test_toxicity_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(5)
    text = lambda bad: " ".join([*(f"w{x}" for x in rng.integers(0, 400, 60)), *(["Loathe!", "hateword"] if bad else [])])
    train_y, test_y = rng.random(800) < 0.15, rng.random(300) < 0.15
    column = pa.array([text(y) for y in train_y])
    hashes = toxicity.all_features(column)
    positive = [h for h, y in zip(hashes[:400], train_y, strict=False) if y]
    found, n = np.unique(np.concatenate(positive), return_counts=True)
    v = toxicity.Vocabulary(found[n >= toxicity.LEAST_TEXTS])
    model = toxicity.train(v, [v.places(x)[1] for x in positive], [v.places(x)[1] for x in hashes[400:]], 0.15)
    s = model.scores(pa.array([text(y) for y in test_y]))
    assert (s[test_y][:, None] > s[~test_y][None, :]).mean() > 0.99 and ((s >= 0.5) == test_y).mean() > 0.97
    assert 0 < model.scores(pa.array([None, ""]))[0] < 0.5


def test_toxicity_training_by_plain_loops():
    """Weights against the same descent by loops over texts and features: the corrected risk, its gradient turned round below zero."""
    rng = np.random.default_rng(3)
    n, prior = 12, 0.2
    positive = [np.flatnonzero(rng.random(n) < np.where(np.arange(n) < 4, 0.7, 0.2)) for _ in range(20)]
    unlabelled = [np.flatnonzero(rng.random(n) < 0.2) for _ in range(50)]
    v = toxicity.Vocabulary(np.arange(1, n + 1, dtype=np.uint64))
    model = toxicity.train(v, positive, unlabelled, prior)
    share = lambda texts, f: sum(f in x for x in texts) / len(texts)
    use = [f for f in range(n) if share(positive, f) > toxicity.LEAST_LIFT * share(unlabelled, f)]
    w, b, m1, m2 = dict.fromkeys(use, 0.0), float(np.log(prior / (1 - prior))), dict.fromkeys([*use, "b"], 0.0), dict.fromkeys([*use, "b"], 0.0)
    turned = 0
    for step in range(1, toxicity.STEPS + 1):
        z = lambda x: sum(w[f] for f in x if f in w) + b  # noqa: B023, E731
        minus = lambda x: float(np.log1p(np.exp(z(x))))  # noqa: B023, E731
        toxic = lambda x: 1 / (1 + np.exp(-z(x)))  # noqa: B023, E731
        rest = sum(map(minus, unlabelled)) / len(unlabelled) - prior * sum(map(minus, positive)) / len(positive)
        g = dict.fromkeys(m1, 0.0)
        for texts, is_p in ((positive, True), (unlabelled, False)):
            for x in texts:
                down = (-prior if is_p else 1.0) * toxic(x) / len(texts)
                plus = -prior * (1 - toxic(x)) / len(texts) if is_p else 0.0
                d = plus + down if rest >= 0 else -down
                for f in (*(f for f in x if f in w), "b"):
                    g[f] += d
        turned += rest < 0
        for f in m1:
            m1[f], m2[f] = 0.9 * m1[f] + 0.1 * g[f], 0.999 * m2[f] + 0.001 * g[f] ** 2
        grain = {f: np.sqrt(m2[f] / (1 - 0.999**step)) + 1e-6 for f in m1}
        move = {f: toxicity.RATE * m1[f] / (1 - 0.9**step) / grain[f] for f in m1}
        w = {f: max(w[f] - move[f] - toxicity.RATE * toxicity.SPARSE / grain[f], 0.0) for f in w}
        b -= move["b"]
    got = dict(zip((model.vocabulary.hashes - np.uint64(1)).tolist(), model.weights.tolist(), strict=False))
    assert set(got) == {f for f in w if w[f] > 0} and model.bias == pytest.approx(b, abs=1e-4)
    assert all(got[f] == pytest.approx(w[f], abs=1e-4) for f in got)


def test_toxicity_sample_is_of_different_rows(spark):
    """10,000 equal rows are one of the sample; reruns and other partitions take the same; held-out rows and null ids never."""
    rows = [(i, f"text {i} " + "bad words here " * (i % 5 == 0)) for i in range(300)]
    df = ship(spark).createDataFrame(rows + [(7, "again")] * 10_000 + [(None, "x")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    a, b = (Counter(tuple(r) for r in toxicity.sampled(x, labels).collect()) for x in (df, df.repartition(7)))
    out = {r.doc_id for r in df.select("doc_id").distinct().filter(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).collect()}
    assert a == b and max(a.values()) == 1 and a[0, "again"] == (7 not in out)
    assert {int(t.split()[1]) for k, t in a if t not in ("again", "x")}.isdisjoint(out) and not any(t == "x" for _, t in a)


def test_toxicity_held_out(spark, sf):
    large = os.path.join(os.path.dirname(sf), "sf0.1")
    out = toxicity.op3_toxicity(spark, large).filter("held_out").join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    p, q = out.score[out.toxic == 1].values, out.score[out.toxic == 0].values
    assert (p[:, None] > q[None, :]).mean() + 0.5 * (p[:, None] == q[None, :]).mean() > 0.93


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(awkward, toxicity.learn(awkward, labels), ["doc_id"])
    assert out.count() == len(AWKWARD) and out.filter("score between 0 and 1").count() == len(AWKWARD)
    assert toxicity.score(awkward, toxicity.learn(awkward, empty(labels)), ["doc_id"]).filter("predicted = 1").count() == 0
    assert toxicity.score(empty(awkward), toxicity.learn(empty(awkward), labels), ["doc_id"]).count() == 0


# -- 4 n-gram Jaccard join


def brute_components(rows):
    """Of (id, text): n and the least id that links reach; rows of one id are nodes of their own."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def shingles(t):
        x = SPLIT.findall(low(t))
        return frozenset([tuple(x)] if 0 < len(x) < 5 else [tuple(x[i : i + 5]) for i in range(len(x) - 4)])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    name = lambda i: min((k for k in least[find(i)] if k is not None), default=None)
    return Counter((k, len(sets[i]), name(i)) for i, (k, _) in enumerate(rows))


def near_copies(seed, n, size, edits):
    rng = np.random.default_rng(seed)
    base = [f"b{x}" for x in rng.integers(0, 1000, size)]
    for _ in range(n):
        x = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            x[rng.integers(0, len(x))] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(x)


def test_join_is_exact(spark):
    """Small sets (subsets), large ones (lists), sizes about the boundary, chains, frequent passages, near copies with many edits."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for seed in range(12) for t in near_copies(seed, 10, int(rng.integers(3, 30)), 2)]
    texts += [t for seed in range(20, 24) for t in near_copies(seed, 25, 150, 8)]
    texts += [passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, rng.integers(2, 60))) for _ in range(60)]
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 60, 4)]
    texts += ["one", "One", "one two", "a b c d", "A b c D", "a b c d e", "a b c d e f", None, "", "  "]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_join_awkward(spark, awkward):
    got = Counter(tuple(r) for r in jaccard.join(awkward).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(a, b) for a, b, *_ in AWKWARD])
    assert jaccard.join(empty(awkward)).count() == 0


def test_join_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b):
            assert jaccard.overlap_bound(len(a), jaccard.parity(a), len(b), jaccard.parity(b)) >= both
            assert (100 * both >= 80 * (len(a) + len(b) - both)) == (both >= jaccard.need(len(a), len(b)))
            if both >= jaccard.need(len(a), len(b)):  # some key is shared, whatever the boundary
                for small in (0, 5, 12):
                    order = jaccard.Order(np.zeros(0, np.uint64), np.zeros(0))
                    assert set(jaccard.postings(a, order, small)[0].tolist()) & set(jaccard.postings(b, order, small)[0].tolist()) if max(len(a), len(b)) <= 15 or small < 12 else True
    assert jaccard.boundary({}, 5.0) == 0 and jaccard.boundary({5: 10, 20: 10}, 0.05) >= 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150)] + [(1000, k) for k in range(1001, 1050)]
    got = {r.node: r.component for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[200] == 100 and got[150] == 100 and got[1049] == 1000
    assert jaccard.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 5 media columns


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (17, 64)):
        g, c = rng.integers(0, 256, (h, w), dtype=np.uint8), rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(g)) == g).all()
        assert (media.decode(media.encode_ppm(c)) == c).all() and (media.decode(media.encode_bmp(c)) == c).all()
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2 2 1 255\n7 255\n").tolist() == [[7, 255]] and media.decode(b"P4 3 1\n\xa0").tolist() == [[1, 0, 1]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 6), st.integers(1, 7), st.integers(0, 99))
def test_area_resize_by_overlaps(h, w, height, width, seed):
    """Each new sample against the sum of the old ones, weighed by how much of each is under it."""
    a = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float)
    cover = lambda n, m: np.array([[max(0.0, min((k + 1) * n / m, i + 1) - max(k * n / m, i)) for i in range(n)] for k in range(m)])
    want = cover(h, height) @ a @ cover(w, width).T / (h / height * w / width)
    assert np.allclose(media.area_resize(a, height, width), want)
    tile = np.clip(np.rint(want), 0, 255)
    if (np.abs(want % 1 - 0.5) > 1e-6).all() and (np.abs(np.diff(want)) > 1e-6).all():
        got = np.load(__import__("io").BytesIO(media.tile_of(media.encode_pgm(a), (height, width))[2]))
        assert (got == tile).all()
        bits = [int(want[i, j + 1] > want[i, j]) for i in range(height) for j in range(width - 1)]
        assert media.difference_hash(want) == np.packbits(np.array(bits, np.uint8)).tobytes().hex()


def test_area_resize_is_a_mean():
    a = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.isclose(media.area_resize(a, 4, 3).mean(), a.mean()) and np.allclose(media.area_resize(a, 12, 16)[::2, ::2], a)
    assert media.difference_hash(np.array([[1, 2, 3, 2, 1, 0, 5, 5, 9]])) == "c5"


def test_media_payloads(spark, awkward):
    rows = media.features(media.store_payloads(awkward)).collect()
    assert len(rows) == len(AWKWARD) and media.features(media.store_payloads(empty(awkward))).count() == 0
    want = Counter()
    for i, t, *_ in AWKWARD:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = {}
    for r in rows:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    assert all(r.feature == f"{r.dhash}:{hashlib.sha256(r.tile).hexdigest()[:16]}" for r in rows)
    stored = common.materialize(media.store_payloads(awkward), compression="zstd")
    assert Counter((r.doc_id, r.media_sha256) for r in rows) == Counter((r.doc_id, hashlib.sha256(r.media).hexdigest()) for r in stored.collect())
    tile = media.image_tiles(media.store_payloads(awkward), "doc_id", "media").first()
    assert np.load(__import__("io").BytesIO(tile.tile)).shape == media.TILE


# -- 6 mixing


def fill(sizes, weights, most=3):
    """Share out again what is over a cap, until nothing is."""
    capped: dict = {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, w = sum(sizes.values()) - sum(capped.values()), sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return {**capped, **{s: left * weights[s] / w for s in free}}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_totals(spark):
    rng = np.random.default_rng(2)
    names = ["a", "b", "c", "d", "é", None]
    rows = [(i, " ".join(["x"] * int(n)), names[int(s)]) for i, (n, s) in enumerate(zip(rng.integers(0, 900, 300), rng.choice(6, 300, p=[0.02, 0.5, 0.2, 0.02, 0.06, 0.2]), strict=True))]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    docs, slots = mixing.mix(df)
    got = docs.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = fill(dict(sizes), {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)})
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == 300 and all(abs(taken[s] - want[s]) <= 1 for s in names) and max(want[s] / sizes[s] for s in names) == pytest.approx(3)
    # every slot of a source is used once, and each whole pass takes every block once
    s = slots.toPandas()
    assert not s.duplicated(["idx", "i"]).any() and (s.groupby("idx").i.max() + 1 == s.groupby("idx").size()).all()
    assert (s[s["all"]].groupby(["idx", "block"]).size().groupby("idx").nunique() <= 1).all()
    assert {tuple(r) for r in mixing.mix(df.repartition(7))[0].collect()} == {tuple(r) for r in got}


def test_permutation(spark):
    for n in (1, 2, 3, 7, 30, 101, 1000, 4099):
        p = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()]
        assert sorted(p) == list(range(n)) and (n < 30 or p != sorted(p))
        back = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), back=True).alias("p")).collect()]
        assert [p[k] for k in back] == list(range(n))


def test_mixing_takes_what_the_slots_say(spark):
    """Of each document: its words that lie in the blocks taken, word by word in the order of its source's stream."""
    rng = np.random.default_rng(7)
    rows = [(i % 40, " ".join(["x"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 200, 120), rng.choice(["a", "b"], 120, p=[0.2, 0.8]), strict=True))]
    df = ship(spark).createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs, slots = mixing.mix(df)
    sized = mixing.sizes(df)
    sources = mixing.targets(sized).collect()
    placed = mixing.offsets(sized, mixing.targets(sized), ()).collect()
    stream = {x.idx: np.zeros(x.source_size, np.int64) for x in sources}  # how often each word is taken
    for r in slots.collect():
        assert r.words <= min(64, len(stream[r.idx]) - 64 * r.block)
        stream[r.idx][64 * r.block : 64 * r.block + r.words] += 1
    cover, want = {k: np.zeros(len(x), int) for k, x in stream.items()}, Counter()
    for r in placed:
        for c in range(r.copies):
            at = r.start + c * r.size
            cover[r.idx][at : at + r.size] += 1
            want[r.doc_id, r.size, r.source_size, int(stream[r.idx][at : at + r.size].sum())] += 1
    assert all((x == 1).all() for x in cover.values())  # each word of a stream belongs to one document
    assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in docs.collect()) == want
    assert all(x.max() - x.min() <= 1 and x.max() <= 3 for x in stream.values())


def test_mixing_splits_repeated_rows(spark):
    """100,000 equal rows, a third of all and more, are dealt to many buckets, and each gets its part."""
    df = ship(spark).range(0, 140_000, 1, 8).select(F.when(F.col("id") < 100_000, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 100_000, "a b c").otherwise(F.repeat(F.lit("x "), (F.col("id") % 9).cast("int"))).alias("text"), F.when(F.col("id") % 4 == 0, "s").otherwise("t").alias("source"))
    sized = mixing.sizes(df)
    rows = sized.filter("doc_id = 1").collect()
    assert sum(r.copies for r in rows) == 100_000 and max(r.copies for r in rows) <= mixing.TASK_COPIES
    placed = mixing.offsets(sized, mixing.targets(sized), ()).filter("doc_id = 1")
    assert placed.select("idx", "bucket").distinct().count() >= 0.8 * len(rows)
    got = mixing.mix(df)[0]
    assert got.count() == 140_000 and got.filter("taken > 3 * size").count() == 0
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in by)


def test_mixing_awkward(spark, awkward):
    out = mixing.mix(awkward)[0]
    assert out.count() == len(AWKWARD) and out.filter("taken > 3 * size or size = 0 and taken > 0").count() == 0
    assert mixing.mix(empty(awkward))[0].count() == 0
    assert mixing.mix(awkward.filter("doc_id in (2, 3, 4)"))[0].agg(F.sum("taken")).first()[0] == 0


def test_mixing_is_native(spark, sf, docs):
    plan = mixing.mix(docs)[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


# -- 7 WARC


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8), st.booleans())
def test_archive_round_trip(payloads, with_dictionary):
    dictionary = warc.train([b"some words that come again %d" % i * 20 for i in range(50)], 1024) if with_dictionary else b""
    records = [warc.record(i, "http://h/ \n", p, hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    raw = warc.write_archive(records, dictionary)
    assert raw[:4] == struct.pack("<I", 0x184D2A5D) if dictionary else True
    back = list(warc.read_archive(raw))
    assert back == records and [warc.parse(x)["payload"] for x in back] == payloads


def test_warc_kinds(spark, tmp_path):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "u", big), (5, "u5", big), (3, None, big), (None, "n", big), (7, "u", other), (8, "u", other), (9, "u", None), (10, "u", ""), (5, "again", big), (11, "u", "y" * 1000), (None, "z", "q" * 2000)]
    df = ship(spark).createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit(2).alias("n"))
    p = warc.payloads(df)
    written = common.materialize(warc.archives(warc.with_kinds(p), warc.dictionary_of(p)))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(written).collect())
    want = Counter()
    for i, _, t in rows:
        raw = (t or "").encode()
        refers = 5 if t == big and i != 5 else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert got == want and warc.read_back(warc.archives(warc.with_kinds(warc.payloads(empty(df))), b"")).count() == 0
    files = warc.archive_files(written, f"file://{tmp_path}/out").collect()
    assert sorted(r.name for r in files) == sorted(x.name for x in (tmp_path / "out").iterdir()) and all(list(warc.read_archive(x.read_bytes())) for x in (tmp_path / "out").iterdir())


def test_warc_repeated_rows(spark):
    """12,000 equal payloads: one response, the sample for the dictionary stays small."""
    big = "<p>words " * 200
    df = ship(spark).range(0, 15_000, 1, 6).select("id", F.when(F.col("id") < 12_000, big).otherwise(F.concat(F.lit(big), F.col("id"))).alias("html"))
    df = df.select(F.col("id").alias("page_id"), F.when(F.col("id") < 12_000, "u").otherwise(F.col("id").cast("string")).alias("url"), "html")
    p = warc.payloads(df.unionByName(df.filter("page_id = 11999")))
    kinds = warc.with_kinds(p)
    assert kinds.filter("refers_to IS NOT NULL").count() == 11_999 and kinds.filter("refers_to IS NULL").count() == 3_002
    assert {r.refers_to for r in kinds.filter("refers_to IS NOT NULL").select("refers_to").distinct().collect()} == {11_999}
    assert warc.dictionary_of(p) == warc.dictionary_of(warc.payloads(df.repartition(3).unionByName(df.filter("page_id = 11999"))))


# -- 8 packing


def test_tokens_are_the_librarys():
    """For every code point, alone and in company, and for the special token's string."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY[0]))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c} b  {c}! " for c in points[i : i + 64]) for i in range(0, len(points), 64 * 7)] + ["x<|endoftext|> y", "it's 'S  \n\n 12\t", "\u2028 \u3000a"]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.tokens(text).tolist() == [*e.ids, 1]


def check_pieces(rows, texts):
    """texts: Counter of (doc_id, text)."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    want = Counter()
    for (i, t), times in texts.items():
        want[i, len(packing.tokens(t))] += times
    total = Counter()
    for r in rows:
        total[r.doc_id, r.doc_tokens] += r.length
    assert total == Counter({k: k[1] * v for k, v in want.items()})
    known = defaultdict(list)
    for i, t in texts:
        known[i].append(packing.tokens(t))
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in known[r.doc_id])


def test_packing(spark, docs):
    rows = packing.pack(docs, shard_weight=40_000).collect()
    check_pieces(rows, Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert {tuple(r) for r in packing.pack(docs.repartition(5), shard_weight=40_000).collect()} == {tuple(r) for r in rows}


def test_packing_awkward(spark, awkward):
    check_pieces(packing.pack(awkward).collect(), Counter((a, b) for a, b, *_ in AWKWARD))
    assert packing.pack(empty(awkward)).count() == 0


def test_neighbours_are_bm25s():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, rng.integers(1, 40)).astype("<u4") for _ in range(30)]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])
    idf = {t: np.log1p((30 - n + 0.5) / (n + 0.5)) for t, n in Counter(t for d in docs for t in set(d.tolist())).items()}
    weight = lambda d, t: idf[t] * (f := d.tolist().count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) if t in d else 0.0
    unused = np.ones(30, bool)
    unused[[0, 3, 5]] = False
    terms = set(docs[0].tolist())
    want = {i: sum(weight(docs[i], t) for t in terms) for i in np.flatnonzero(unused)}
    got = index.neighbours(0, unused).tolist()
    assert set(got) == {i for i, s in want.items() if s > 0} and all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))
    assert sorted(packing.order(docs, 64)) == list(range(30))


def test_packing_searches_by_affinity(spark):
    """Documents of a topic meet in a shard at any size of the table; frequencies and the mean length are those of all documents."""
    rng = np.random.default_rng(6)
    words = rng.integers(0, 26, (40, 30, 5)) + 97
    rows = [(i, " ".join(bytes(words[i % 40, j].tolist()).decode() for j in rng.integers(0, 30, 60))) for i in range(800)]
    dealt, many, whole, width = packing.shards(ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(3), 28_000, packing.VOCABULARY)
    where = {r.doc_id: r.shard for r in dealt.collect()}
    topics = [Counter(where[i] for i in range(t, 800, 40)) for t in range(40)]
    assert sum(c.most_common(1)[0][1] for c in topics) >= 0.8 * 800
    assert 8 < len(set(where.values())) <= many and max(Counter(where.values()).values()) <= 80
    docs = [packing.tokens(t) for _, t in rows]
    held = Counter(x for d in docs for x in set(d.tolist()))
    assert whole.docs == 800 and whole.mean == pytest.approx(np.mean([len(d) for d in docs]))
    assert all(whole.idf[t] == pytest.approx(np.log1p((800 - n + 0.5) / (n + 0.5)), abs=1e-5) for t, n in held.items())


def test_packing_asks_with_every_term():
    """The 30th term of a seed finds a document too."""
    seed, far = np.arange(100, 130, dtype="<u4"), np.array([129, 500], "<u4")
    others = [np.array([x, 600], "<u4") for x in range(100, 129)]
    index = packing.Index([seed, far, *others])
    assert set(index.neighbours(0, np.arange(31) > 0).tolist()) == set(range(1, 31))


def test_packing_deals_large_groups():
    dealt = packing.deal([(0, 0, 10), (0, 1, 20), (1, 0, 35), (2, 0, 400), (2, 1, 5)], 40)
    assert [(c, k, s) for c, k, _, s in dealt] == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (2, 0, 10), (2, 1, 1)]
    assert [f for _, _, f, _ in dealt] == [0, 0, 1, 2, 12]


def test_packing_order_is_greedy():
    """Against a plain version: the best unused neighbour of the window's seed, until the window is full."""
    rng = np.random.default_rng(9)
    for window in (32, 64):
        docs = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u4") for _ in range(40)] + [np.array([900 + i], "<u4") for i in range(5)]
        mean, held = np.mean([len(d) for d in docs]), Counter(t for d in docs for t in set(d.tolist()))
        idf = {t: np.log1p((len(docs) - n + 0.5) / (n + 0.5)) for t, n in held.items()}
        weight = lambda d, t: idf[t] * (f := d.tolist().count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
        score = [[sum(weight(y, t) for t in set(x.tolist()) & set(y.tolist())) for y in docs] for x in docs]
        got, at, seed = packing.order(docs, window), 0, None
        left = set(range(len(docs)))
        for d in got:
            near = [score[seed][x] for x in left] if seed is not None else []
            if near and max(near) > 0:
                assert score[seed][d] >= max(near) - 1e-3
                seeds = False
            else:
                assert d == min(left)
                seeds = True
            left.remove(d)
            before, at = at // window, at + len(docs[d])
            if seeds or at // window != before:
                seed = d if at % window else None
        assert not left


def test_packing_spreads_repeated_rows(spark):
    """20,000 equal rows, more than a third of all, go to many shards of about the same size."""
    df = ship(spark).range(0, 26_000, 1, 6).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 20_000, "the same words again and again").otherwise(F.concat(F.lit("other words of "), F.col("id"))).alias("text"))
    dealt, many, _, _ = packing.shards(df, 250_000, packing.VOCABULARY)
    n = [r["count"] for r in dealt.filter("doc_id = 7").groupBy("shard").count().collect()]
    assert sum(n) == 20_000 and len(n) >= 20 and max(n) < 3 * 20_000 / len(n)
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] < 2000
    rows = packing.pack(df, 250_000)
    assert rows.agg(F.sum("length")).first()[0] == sum(len(packing.tokens(r.text)) for r in df.select("text").collect())


# -- 9 HTML


def test_html_articles(spark, sf):
    """Against the articles cut out by pattern: in these pages they are all of the main text."""
    pages = {r.page_id: r.html for r in common.table(spark, sf, "pages").collect()}

    def article(h):
        body = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(?:</article>|\Z)", h, re.S)[1])
        parts = [" ".join(H.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        return "\n".join(x for x in parts if x)

    rows = html_text.op9_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages) and all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


HTML = [
    (None, ""), ("", ""), ("just words, here.", "just words, here."), ("<script>var a = '<p>no</p>'", ""), ("<!-- <p>no</p> ", ""), ("<article><p>One, two.<p>Three &lt;b&gt; &amp;amp; caf&#233;</article", "One, two.\nThree <b> &amp; café"),
    ("<body><div class='cookie-notice'>We use cookies, ok.</div><main><h1>T</h1><form>Name: <input></form><p>A long sentence, with marks. And another one.</p><aside>Side, text.</aside><section id=comments><p>I disagree, strongly.</p></section></main>", "T\nA long sentence, with marks. And another one."),
    ("<div id=wrap><div role=navigation><a href=/>Home</a></div><div><h2>Head</h2><p>First paragraph, long enough to count.</p><p>Second, <a href=x>with a link</a> in it.</p><ul><li>a point, made.</li></ul></div><div class=footer>c 2024, x.</div></div>", "Head\nFirst paragraph, long enough to count.\nSecond, with a link in it.\na point, made."),
    ('<article><p title="a > b">Quoted > sign, kept.</p><p hidden>no</p></article>', "Quoted > sign, kept."), ("<article>" + "<p>x, y.</p>" * 3000 + "</article>", "\n".join(["x, y."] * 3000)), ("<" * 5000 + "p>", None), ("<div>" * 3000 + "deep, down.", "deep, down."),
]


@pytest.mark.parametrize("html,want", HTML)
def test_html_cases(html, want):
    got = html_text.extract(html)
    assert want is None or got == want


BODY = [f"Paragraph {i} of the text, with marks, and enough words to be one." for i in range(10)]
LEAD = "A lead of two sentences, in short. It stands before the body, alone."


def test_html_keeps_content_beside_the_largest():
    """A lead beside the body, and an article in two parts of 80% and 20%."""
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    assert html_text.extract(f"<body><div class=post>{p([LEAD])}<div class=entry>{p(BODY)}</div></div></body>") == "\n".join([LEAD, *BODY])
    for tag in ("div", "article"):
        assert html_text.extract(f"<body><{tag}>{p(BODY[:8])}</{tag}><{tag}>{p(BODY[8:])}</{tag}></body>") == "\n".join(BODY)


def test_html_keeps_short_blocks_beside_content():
    """List items, cells and code without marks, of any length; not so links alone, and what stands apart."""
    p = "".join(f"<p>{t}</p>" for t in BODY)
    short = "<ul><li>Red apples</li><li>Apples of a kind that is longer</li></ul><table><tr><td>One</td></tr></table><div class=code><pre>x = 1</pre></div>"
    page = f"<body><div><a href=/>Home</a></div><div>{p}{short}</div><div><div>Small print</div></div></body>"
    assert html_text.extract(page) == "\n".join([*BODY, "Red apples", "Apples of a kind that is longer", "One", "x = 1"])


def test_html_class_sends_no_whole_text_away():
    p = "".join(f"<p>{t}</p>" for t in BODY)
    assert html_text.extract(f"<body><div class='layout sidebar'>{p}</div><div class=footer>By us, 2024.</div></body>") == "\n".join(BODY)
    assert html_text.extract(f"<body><div>{p}</div><div class=comments>{p}{p}{p}</div></body>") == "\n".join(BODY)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap'\"=&;!- \n", max_size=60))
def test_html_never_fails(text):
    assert isinstance(html_text.extract(text), str)


def test_html_wrappers_keep_their_article():
    """A wrapper that is called after what it doesn't hold, or holds besides, loses nothing; what is in it is judged by itself."""
    p = "".join(f"<p>{t}</p>" for t in BODY)
    for name in ("content no-sidebar", "with-sidebar", "header-fixed", "has-comments", "page legal", "story share", "entry related-story"):
        for inner in (p, f"<article>{p}</article>"):
            assert html_text.extract(f"<body><nav>x, y.</nav><div class='{name}'>{inner}</div><div class=comments>{p}</div><footer>f, g.</footer></body>") == "\n".join(BODY)
    assert html_text.extract(f"<body><form class=layout><h1>T</h1>{p}<input></form></body>") == "\n".join(["T", *BODY])
    names = {"post-comments": True, "comment-body": True, "site-footer": True, "leftSidebar": False, "SidebarWidget": True, "no-ads": False, "related-story": False, "grid x12": False, "": False}
    assert {n: html_text.speaks_against(n) for n in names} == names


def test_html_paths_decide_inside_an_article():
    """A container's own short text and a block of links go, also in a main element; items, cells and headings of content stay."""
    p = "".join(f"<p>{t}</p>" for t in BODY)
    assert html_text.extract(f"<main>{p}<div>Buy now</div><div><a href=x>One</a> <a href=y>Two</a></div><div><h3>More</h3><ul><li><a href=z>Z</a></li></ul></div></main>") == "\n".join(BODY)
    assert html_text.extract(f"<main><h1>T</h1><div>{p}<h2>Kinds</h2><ul><li>Red</li></ul><p><a href=x>All of them</a></p></div></main>") == "\n".join(["T", *BODY, "Kinds", "Red", "All of them"])


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000 + "deep, down.", "<div>" * 50_000 + "</x>" * 50_000 + "a, b.", "<p><table><td>" + "<div>" * 50_000 + "a, b.", "<ul>" + "<li><div>" * 40_000 + "a, b.", "<b>" * 50_000 + "<p>a, b.", "<span>" * 60_000 + "a, b." + "</div>" * 40_000],
)
def test_html_time_is_linear(html):
    began = time.process_time()
    assert html_text.extract(html) in ("deep, down.", "a, b.") and time.process_time() - began < 2


def plain_content(nodes, believed):
    """content_paths() by plain sums. nodes: (path, characters, marks)."""
    mean = lambda k, i: sum(x[k] for x in nodes if x[0] == nodes[i][0]) / sum(x[0] == nodes[i][0] for x in nodes)
    near = {d: np.exp(-0.5 * d * d) for d in range(-3, 4)}

    def smooth(k, i):
        some = [(w, mean(k, i + d)) for d, w in near.items() if 0 <= i + d < len(nodes)]
        return sum(w * v for w, v in some) / sum(w for w, _ in some)

    fused = [(smooth(1, i) * smooth(2, i)) ** 0.5 for i in range(len(nodes))]
    paths = sorted({x[0] for x in nodes})
    value = {p: believed[p] * np.mean([f for f, x in zip(fused, nodes, strict=True) if x[0] == p]) for p in paths}
    weigh = {p: believed[p] * sum(x[1] for x in nodes if x[0] == p) for p in paths}
    total = sum(weigh.values())
    if not total:
        return set()
    typical = sum(value[p] * weigh[p] for p in paths) / total
    spread = (sum(weigh[p] * (value[p] - typical) ** 2 for p in paths) / total) ** 0.5
    return {p: value[p] - 0.5 * max(typical - spread, 0.5 * typical) for p in paths if weigh[p]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([0, 3, 40, 200]), st.integers(0, 6)), min_size=1, max_size=25), st.lists(st.sampled_from([1.0, 0.4, 0.1]), min_size=5, max_size=5))
def test_html_content_paths(nodes, believed):
    got = html_text.content_paths(np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes], float), np.array([x[2] for x in nodes], float), np.array(believed))
    want = plain_content(nodes, believed) or {}
    assert all(got[p] == (want[p] >= 0) for p in want if abs(want[p]) > 1e-9) and not got[[p for p in range(5) if p not in want]].any()


def test_html_paths_are_whole_paths():
    """Numbers for paths: equal where the tags from the root, and what speaks against their elements, are."""
    page = html_text.Page("<div><p>One, a.</p><ul><li>Two</li></ul></div><div><p>Three, b. And more of it, to count.</p><p class=ad>Four</p></div>")
    path, _ = page.paths(np.array([float(len(t)) for t in page.text]))

    def name(e):
        return "" if not e else f"{name(page.parent[e])}/{page.tag[e]}{'!' * (page.hint[e] > 0)}"

    names = [name(e) for e in range(len(page.tag))]
    assert all((path[a] == path[b]) == (names[a] == names[b]) for a in range(len(names)) for b in range(a))


def test_html_table(spark):
    """Nulls, repeated rows, and further columns that are called as the operator's own."""
    rows = [(1, "u", "<p>A, b.</p>", "t", 3), (1, "u", "<p>A, b.</p>", "t", 3), (None, None, None, None, None), (2, None, "", "x", 1)]
    df = ship(spark).createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    assert Counter(tuple(r) for r in html_text.main_text(df, ["page_id", "url"]).collect()) == Counter({(1, "u", "A, b.", 5): 2, (None, None, "", 0): 1, (2, None, "", 0): 1})
    assert html_text.main_text(empty(df), ["page_id"]).count() == 0


# -- 10 quality rules


def plain_measures(t):
    t = t or ""
    x = SPLIT.findall(t)
    lines = [y for y in t.split("\n") if SPLIT.search(y)]
    seen, hit = Counter(tuple(x[i : i + 3]) for i in range(len(x) - 2)), set()
    for i in range(len(x) - 2):
        if seen[tuple(x[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(x), sum(map(len, x)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, docs, awkward):
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs, awkward):
        want = Counter((r.doc_id, *plain_measures(r.text)) for r in df.select("doc_id", "text").collect())
        assert Counter((r.doc_id, *(r[k] for k in keys)) for r in quality.measures(df, ["doc_id"]).collect()) == want


def test_quality_verdicts(spark, docs, awkward):
    """The fences, by numpy over the same groups; sketches are exact for groups this small."""
    rows = quality.with_ratios(quality.measures(docs, ["doc_id", "lang", "source"])).toPandas()
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    ok = rows[~rows.base_failed]
    for r in rows.itertuples():
        group, lang = ok[(ok.lang == r.lang) & (ok.source == r.source)], ok[ok.lang == r.lang]
        kept = not r.base_failed
        if not kept:
            assert not got[r.doc_id].kept
            continue
        for c, levels in quality.RATIOS.items():
            q = None
            for g in (ok, lang, group):
                n, lines = (max(1, np.quantile(g[x], 0.5, method="inverted_cdf")) for x in ("n_words", "n_lines"))
                event = {"symbol_ratio": 1 / n, "dup_line_ratio": 1 / lines, "repeat_ratio": 8 / n, "mean_word": n**-0.5}[c]
                own = np.append(np.quantile(g[c], levels, method="inverted_cdf"), event)
                q = own if q is None else (len(g) * own + quality.SHRINK * q) / (len(g) + quality.SHRINK)
            a, b, event = q
            kept = kept and getattr(r, c) <= b + quality.FENCE * (b - a + event)
            kept = kept and (c != "mean_word" or r.mean_word >= a - quality.FENCE * (b - a + event))
        assert bool(got[r.doc_id].kept) == bool(kept)
    assert quality.judge(awkward).count() == len(AWKWARD) and quality.judge(empty(awkward)).count() == 0


def test_quality_fences_are_their_groups(spark, docs):
    """They differ in every ratio; what is junk in one source is usual in another, and stays there."""
    fences = quality.thresholds(quality.with_ratios(quality.measures(docs, ["doc_id", "lang", "source"]))).toPandas()
    assert all(fences[f"max_{c}"].nunique() > len(fences) // 2 for c in quality.RATIOS)
    text = lambda i, marks: " ".join(f"word{i}x{k}" + ("# $" if k % 3 == 0 and marks else "") for k in range(90))
    rows = [(i, text(i, i >= 400 or i % 40 == 0), "en", "plain" if i < 400 else "tables") for i in range(800)]
    got = quality.judge(ship(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 400, 40))


def test_lists_of_links_in_an_article():
    """Sources are content; menus aren't: they have an element, a role or a class of their own, or come first."""
    text = "<p>Some text, which is long enough, and has marks. It goes on, and on.</p>"
    links = lambda *x: "<ul>" + "".join(f"<li><a href=#>{t}</a></li>" for t in x) + "</ul>"
    ex = html_text.extract
    assert ex(f"<article><h1>Links</h1>{links('First thing', 'Second thing')}</article>") == "Links\nFirst thing\nSecond thing"
    assert ex(f"<article><h1>T</h1>{text}<h2>Sources</h2>{links('One', 'Two')}</article>{links('About')}").endswith("on.\nSources\nOne\nTwo")
    assert ex(f"<article>{links('Home')}<h1>T</h1>{text}<nav>{links('Next')}</nav><div class=related>{links('More')}</div></article>") == "T\nSome text, which is long enough, and has marks. It goes on, and on."
