"""The filter audit, vector codes and line dedup against plain versions, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import audit, line_dedup, vector_codes
from factloom.llm.cuckoo import Cuckoo, Full
from factloom.session import ship

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ENGLISH = "the house and the garden with a river that was there before them and for us all in one of those places " * 6
VARIED = " ".join(f"word{i}" for i in range(150))
TEXTS = [
    (1, ENGLISH, "en"),
    (2, ENGLISH, "fr"),
    (2, ENGLISH, "en"),
    (None, ENGLISH, "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n\x0b\x0c\r ", ""),
    (6, VARIED, "en"),
    (7, VARIED.upper(), "en"),
    (8, VARIED + " $", "fr"),
    (9, VARIED + " É 漢字 🙂", "en"),
    (10, " ".join(f"w{i % 977}" for i in range(60_000)), "en"),
    (None, None, None),
]
LABELS = [(1, 1, 0), (1, None, 1), (2, 0, 1), (4, 1, None), (6, 1, 1), (None, 1, 1), (77, 1, 1)]


# -- 11 filter audit


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for i, t, lang in docs:
        t, words = t or "", SPLIT.findall(t or "")
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least[t] < i,
        }
        good, toxic = (i is not None and any(x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            there = True
            for step, f in enumerate(order, 1):
                row = out[(lang or "", order, step)]
                row[3] += fails[f] and sum(fails.values()) == 1
                row[2] += fails[f] and not there
                if there and fails[f]:
                    there = False
                    row[1] += 1
                    row[4] += good
                    row[5] += toxic
                    shapley[lang or "", f] += 1
                row[0] += there
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_awkward(spark):
    docs = ship(spark).createDataFrame(TEXTS, "doc_id long, text string, lang string").select("*", *(F.lit(7).alias(c) for c in ("part", "fails", "good", "step", "digest", "words")))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").select("*", F.lit("x").alias("part"))
    got = audit.audit(docs, labels).select("part", "filter_order", "step", *audit.COUNTS, "shapley")
    assert Counter(map(tuple, got.collect())) == plain_audit(TEXTS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


# -- 12 vector codes


def plain_codes(x, rounds=vector_codes.ROUNDS):
    """x: integer vectors in the order of their ids. Codes, errors and codebooks of plain rounds."""
    x = x.reshape(len(x), vector_codes.PARTS, -1)
    book = x[: vector_codes.ENTRIES].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(3)
        codes = d.argmin(2)
        if r == rounds:
            return codes, d.min(2).sum(1), book
        for p in range(vector_codes.PARTS):
            for e in set(codes[:, p].tolist()):
                mine = x[codes[:, p] == e, p]
                book[p, e] = mine.sum(0) // len(mine)
    raise AssertionError


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 120), st.integers(1, 4), st.integers(1, 200), st.integers(0, 2**32 - 1))
def test_bounds_skip_but_never_change_a_code(n, dim, spread, seed):
    """Few different integers: ties everywhere."""
    x = np.random.default_rng(seed).integers(-spread, spread + 1, (n, vector_codes.PARTS, dim)).astype(np.int64)
    first = x[: vector_codes.ENTRIES].transpose(1, 0, 2).copy()
    book = vector_codes.Codebooks(first, vector_codes.grouped(first), np.zeros(first.shape[:2]))
    codes, upper, lower, _ = book.assign(x)
    for _ in range(vector_codes.ROUNDS):
        book = book.after(book.sums(x, codes).astype(object))
        book.reassign(x, codes, upper, lower)
        assert (codes == ((x[:, :, None] - book.entries[None]) ** 2).sum(3).argmin(2)).all()
    want = plain_codes(x.reshape(n, -1))
    assert (codes == want[0]).all() and (book.entries == want[2]).all()


def test_most_distances_are_skipped(spark, sf):
    vectors = ship(spark).read.parquet(f"{sf}/embeddings.parquet")
    rows, _, looked = vector_codes.compress(vectors)
    whole = vectors.count() * vector_codes.PARTS * vector_codes.ENTRIES
    assert looked[0] == whole and looked[-1] < 0.6 * whole and rows.count() == vectors.count()


def test_codes_awkward(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in rng.normal(size=11).astype(np.float32)] for _ in range(40)]
    rows = [(i * 3 - 20, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors)]
    rows += [(rows[3][0], vectors[7], 1), (rows[3][0], vectors[7], 1), (None, vectors[5], 2), (None, vectors[6], None)]
    lost = [(-100, None, 1), (-101, [1.0, None] * 5, 1), (-102, [float("nan")] * 11, 1), (-103, [float("inf")] + [0.0] * 10, 1), (-104, [], 1), (500, [1.0] * 10, 1)]
    rows.append((600, [3e38, -3e38, *[0.0] * 9], 9))
    df = ship(spark).createDataFrame(rows + lost, "vec_id long, embedding array<float>, label int").select("*", *(F.lit(1).alias(c) for c in ("code", "id", "dim", "error", "seeds"))).repartition(3)
    got = vector_codes.compress(df)
    ints = lambda v: np.pad(np.clip(np.floor(4096 * np.array(v, np.float32).astype(float)), -vector_codes.bound(11), vector_codes.bound(11)).astype(np.int64), (0, 5))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, ints(r[1]).tolist()))
    first, seen = [], set()
    for r in order:
        if r[0] not in seen:
            seen.add(r[0])
            first.append(r)
    rest = list(order)
    for r in first:
        rest.remove(r)
    x = np.array([ints(r[1]) for r in first + rest])
    codes, errors, book = plain_codes(x)
    want = Counter((r[0], None if r[2] is None else str(r[2]), "".join(f"{c:02x}" for c in code), int(e)) for r, code, e in zip(first + rest, codes, errors, strict=True))
    assert Counter(map(tuple, got[0].select("vec_id", "label", "code", "error").collect())) == want
    assert got[1].digest() == hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
    assert vector_codes.compress(df.limit(0))[0].count() == 0
    few = vector_codes.compress(df.filter("vec_id in (-20, -17)"))[0]
    assert few.count() == 2 and few.filter("error > 0").count() == 0


# -- 13 line dedup


def plain_lines(rows):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows."""
    white = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(white))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= line_dedup.MIN_CHARS:
                holders[key(x)].add(i)
    many = {k: max(v) for k, v in holders.items() if len(v) >= line_dedup.MIN_DOCS}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or many.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


A, B, C = "one line that many documents hold", "Ünïcödé is short 漢字", "a third line, that some documents hold"
LINES = [
    (1, f"{A}\nown words of the first document\n  {B}\t"),
    (1, f"{A}\nown words of the first document\n  {B}\t"),
    (2, f" {A.upper()} \n\n{B}\n{A}"),
    (3, f"{A}\r\n{B}\nshort\n{C}"),
    (4, f"{C}\n\n{C}\n"),
    (5, f"x\n{C.title()}"),
    (6, None),
    (7, ""),
    (8, "\n"),
    (None, f"{A}\n{C}"),
    (9, "\n".join(f"line {i % 5000} of a very long document" for i in range(60_000)) + "\n" + A),
    (10, "éééééééééééééééééééé\néééééééééééééééééée"),
    (11, "éééééééééééééééééééé\néééééééééééééééééée"),
    (12, "éééééééééééééééééééé\néééééééééééééééééée\néééééééééééééééééé"),
]


def kept(docs, state):
    return Counter(map(tuple, line_dedup.without(docs, state.losses()).collect()))


@pytest.fixture(scope="module")
def lines(spark):
    df = ship(spark).createDataFrame(LINES, "doc_id long, text string")
    return df.select("*", *(F.lit(7).alias(c) for c in ("k1", "k2", "refs", "gone", "largest", "kept"))).repartition(3)


def test_lines_awkward(spark, lines, monkeypatch):
    state = line_dedup.Lines(spark).insert(lines)
    assert kept(lines, state) == plain_lines(LINES)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)  # filters that can't be sent
    assert kept(lines, state) == plain_lines(LINES)
    assert line_dedup.without(lines.limit(0), line_dedup.Lines(spark).insert(lines.limit(0)).losses()).count() == 0


def snapshot(state):
    return Counter(map(tuple, state.counts.collect())), {r.shard: sorted(map(sorted, Cuckoo.read(r.cuckoo).table.tolist())) for r in state.filters.collect() if r["keys"]}


def test_lines_come_and_go(spark, lines):
    """Whatever comes and goes, counts, filters and results are those of a state that is made of the documents that are there."""
    part = lambda *ids: lines.filter(F.col("doc_id").isin(*ids))
    rows = lambda *ids: [r for r in LINES if r[0] in ids]
    state = line_dedup.Lines(spark).insert(part(1, 3, 4, 10))
    steps = [
        (state, (1, 3, 4, 10)),
        (more := state.insert(part(2, 5, 9, 11, 12)), (1, 2, 3, 4, 5, 9, 10, 11, 12)),
        (less := more.delete(part(9, 3, 12)), (1, 2, 4, 5, 10, 11)),  # the largest holders go
        (less.insert(part(3, 9, 12)), (1, 2, 3, 4, 5, 9, 10, 11, 12)),
        (less.compacted().delete(part(2, 5, 11)), (1, 4, 10)),
    ]
    for now, there in steps:
        assert kept(part(*there), now) == plain_lines(rows(*there))
        new = line_dedup.Lines(spark).insert(part(*there))
        assert snapshot(now)[0] == snapshot(new)[0]
        held = {k: v for r in now.filters.collect() for k, v in [(r.shard, r["keys"])]}
        assert sum(held.values()) == now.repeated().count() and line_dedup.passing(now.repeated(), now.filters, now.shards).count() == now.repeated().count()
    assert snapshot(steps[3][0]) == snapshot(more)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, min_size=1, max_size=800), st.integers(0, 2**32 - 1))
def test_cuckoo(keys, seed):
    x = np.array(keys, np.uint64)
    f = Cuckoo.sized(len(x))
    try:
        f.add(x)
    except Full:
        return
    assert f.has(x).all()
    gone = np.random.default_rng(seed).random(len(x)) < 0.5
    f.remove(x[gone])
    assert f.has(x[~gone]).all() and (f.table > 0).sum() == (~gone).sum()
    f.add(x[gone])
    assert f.has(x).all()
    f.remove(x)
    assert not f.table.any()


def test_cuckoo_load_and_false_positives():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400_000, dtype=np.uint64)
    f = Cuckoo(np.zeros((1 << 16, 4), np.uint16))
    f.add(x[:245_000])  # 93 % full
    assert f.has(x[:245_000]).all() and f.has(x[245_000:]).mean() < 0.0002
    with pytest.raises(Full):
        f.add(x[245_000:270_000])
