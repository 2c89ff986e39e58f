"""The pipeline's stages against plain versions of what they decide."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from factloom.llm import common, language, mixing, toxicity

from .test_ops import AWKWARD, brute_components, check_pieces, plain_language


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = common.table(spark, sf, "documents"), {}
    out["documents"] = docs
    for name, f in C.STAGES:
        docs = out[name] = common.materialize(f(spark, docs, sf))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "packing"]
    assert all(stages[n].columns == C.COLUMNS for n, _ in C.STAGES[:-1])


def test_language_stage_by_plain_sums(stages):
    """What stays: texts with a trigram, whose best posterior by plain sums is enough, and which fit that language."""
    rows = stages["documents"].orderBy("doc_id").collect()
    model = language.train(stages["documents"])
    names, q = plain_language([(r.text, r.lang) for r in rows if r.lang], [(i, r.text, r.lang, r.source or "") for i, r in enumerate(rows)])
    fits = model.evidence(pa.array([r.text for r in rows], pa.string()))[2] >= model.least
    assert names == model.languages
    want = Counter(r.doc_id for i, r in enumerate(rows) if q[i] is not None and q[i].max() >= language.MIN_POSTERIOR and fits[i, q[i].argmax()])
    assert ids(stages["language_id"]) == want and len(want) >= 0.9 * len(rows)


def test_toxic_go(spark, sf, stages):
    scored = toxicity.score(stages["language_id"], toxicity.learn(stages["language_id"], common.table(spark, sf, "labels")), ["doc_id"])
    assert ids(stages["toxicity"]) == ids(scored.filter("predicted = 0"))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    assert ids(stages["near_duplicates"]) == Counter({k for k, _, name in brute_components(rows) if k == name})


def test_mix_repeats_documents(stages):
    """Each document as often as its words are taken, rounded down or up to whole copies; of each source near its target."""
    numbered = C._numbered(stages["near_duplicates"])
    taken = mixing.mix(numbered, keep=(C._ROW,))[0].collect()
    copies = ids(stages["mixing"])
    assert len({r.doc_id for r in taken}) == len(taken) and set(copies) <= {r.doc_id for r in taken}
    got, target, largest = Counter(), {}, Counter()
    for r in taken:
        n = copies[r.doc_id]
        assert n == 1 if r.size == 0 else r.taken // r.size <= n <= -(-r.taken // r.size) <= 3
        got[r.source] += n * r.size
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert all(abs(got[s] - t) <= 0.15 * t + 3 * largest[s] for s, t in target.items()) and abs(sum(got.values()) - sum(target.values())) <= 0.1 * sum(target.values())


def test_packing_holds_every_copy(stages):
    check_pieces(stages["packing"].collect(), Counter((r.doc_id, r.text) for r in stages["mixing"].collect()))


def test_awkward_tables(spark, sf):
    df = spark.createDataFrame([(*r, None) for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long").withColumn("__extra", F.lit(1))
    for docs in (df, df.limit(0)):
        for _, f in C.STAGES:
            docs = common.materialize(f(spark, docs, sf))
        assert docs.columns[0] == "doc_id"
