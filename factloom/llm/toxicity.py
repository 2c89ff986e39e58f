"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) in numpy.

The classifier is linear over the words that a text has and the stems of its words (hashed, presence only), with few
weights other than 0. It learns from confirmed toxic texts
and from unlabelled text of any kind, by the risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-)),  in which the class prior pi
takes out of the unlabelled text's risk what the toxic texts among it add; where the second term falls below zero, its
gradient is turned round, which keeps the model from learning the confirmed texts by heart.

Training takes a bounded sample (MOST_POSITIVE and MOST_UNLABELLED different rows, those of the least hash of doc_id and
text), whose texts are read whole. Which of their features a weight may be given to is counted in Spark; the driver gets
these, as many as the sample's toxic texts have in common, and, for each text of the sample, which it has. Every text is scored,
whole. Language, source, doc_id and labels are never inputs of a score.

Edge cases: null and empty texts have no words and get the model's bias as their score; without a confirmed toxic text
every score is the prior, 0 where nothing is labelled either; a null doc_id is never learnt from and isn't held out;
repeated rows are scored each, and learnt from once; ties in the order by hash are rows of equal hashes, which are one; an
empty table gives an empty result; further columns are dropped by score(), whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import MARKS, leads, words

#: The leading bytes of words that are features besides the words themselves.
STEMS = (4, 5, 6)
MOST_POSITIVE, MOST_UNLABELLED = 3000, 8000
FOLDS, HELD_OUT = 5, 0
STEPS, RATE, SPARSE, BETA = 300, 0.1, 3e-4, 0.0
#: A feature has to be in so many of the toxic texts, and in their share this many times as often as in unlabelled text's.
LEAST_TEXTS, LEAST_LIFT = 3, 2.0
_LOW = 20  # bits of a feature by which most others are told apart from a vocabulary at once


class Vocabulary:
    """A set of features, 64-bit hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.low = np.zeros(1 << _LOW, bool)
        self.low[self.hashes & np.uint64((1 << _LOW) - 1)] = True

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the found features are here, and where."""
        some = np.flatnonzero(self.low[found & np.uint64((1 << _LOW) - 1)])
        at = np.searchsorted(self.hashes, found[some])
        here = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == found[some]) if len(self.hashes) else np.zeros(0, np.int64)
        return some[here], at[here]


def _every(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and the numbers of their texts: all words, then all stems of each length."""
    w = words(column, fold=True, apart=MARKS)
    of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    yield w.hashes, of
    for k in STEMS:
        hashes, at = leads(w, k)
        yield hashes, of[at]


def all_features(column: pa.Array) -> list[np.ndarray]:
    """The different features of each text."""
    parts = list(_every(column))
    hashes, of = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(of, kind="stable")
    return [np.unique(x) for x in np.split(hashes[order], np.searchsorted(of[order], np.arange(1, len(column))))] if len(column) else []


def known_features(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each text that are in the vocabulary, by their places, one text after the other; where each text's begin."""
    size = np.int64(max(1, len(vocabulary.hashes)))
    every = [np.zeros(0, np.int64)]
    for hashes, of in _every(column):
        here, at = vocabulary.places(hashes)
        every.append(of[here] * size + at)
    both = np.unique(np.concatenate(every))
    return both % size, np.searchsorted(both // size, np.arange(len(column) + 1))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        found, begin = known_features(column, self.vocabulary)
        return 1 / (1 + np.exp(-np.clip(_sums(self.weights[found], begin) + self.bias, -60, 60)))


def train(vocabulary: Vocabulary, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Each text is the array of its features' places in the vocabulary. prior: the share of toxic texts in unlabelled text.
    Weights are never negative, so only features that are more usual in toxic texts can get one."""
    if not positive or not unlabelled:
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(1), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    prior = min(max(prior, 1e-4), 0.9)
    n, size = len(vocabulary.hashes), np.array([len(x) for x in (*positive, *unlabelled)])
    found, of = np.concatenate([*positive, *unlabelled]).astype(np.int64), np.repeat(np.arange(len(size)), size)
    rate = [np.bincount(found[x], minlength=n) / k for x, k in ((of < len(positive), len(positive)), (of >= len(positive), len(unlabelled)))]
    use = np.flatnonzero(rate[0] > LEAST_LIFT * rate[1])
    new = np.full(n, -1)
    new[use] = np.arange(len(use))
    live = new[found] >= 0
    found, of = new[found[live]], of[live]
    begin = np.searchsorted(of, np.arange(len(size) + 1))
    p = np.arange(len(size)) < len(positive)
    share = np.where(p, 1 / len(positive), 1 / len(unlabelled))
    w, b = np.zeros(len(use)), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(_sums(w[found], begin) + b, -60, 60)
        toxic = 1 / (1 + np.exp(-z))
        loss_minus = np.logaddexp(0, z)  # logistic loss of the label -1
        rest = (share * loss_minus)[~p].sum() - prior * (share * loss_minus)[p].sum()
        plus = np.where(p, -prior * share * (1 - toxic), 0.0)
        minus = np.where(p, -prior, 1.0) * share * toxic
        slope = plus + minus if rest >= -BETA else -minus
        g = np.append(np.bincount(found, slope[of], len(use)), slope.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        grain = np.sqrt(m2 / (1 - 0.999**step)) + 1e-6
        move = RATE * (m1 / (1 - 0.9**step)) / grain
        # the proximal step of an L1 penalty; features can speak for toxicity only, so that no length of clean text outweighs them
        w, b = np.maximum(w - move[:-1] - RATE * SPARSE / grain[:-1], 0), b - move[-1]
    kept = w > 0
    return Model(Vocabulary(vocabulary.hashes[use[kept]]), np.append(w[kept], 0.0), float(b))


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic (1: confirmed; 0: of unknown kind), text: the rows that are learnt from, as a table in the shared folder. Equal rows are one."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(fold(docs["doc_id"]) != HELD_OUT)
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h")).distinct()
    confirmed = labels.filter("toxic = 1").select("doc_id").distinct()
    first = lambda k, most, toxic: k.orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(most).select("doc_id", "h", F.lit(toxic).alias("toxic"))
    chosen = first(keyed.join(confirmed, "doc_id", "left_semi"), MOST_POSITIVE, 1).union(first(keyed, MOST_UNLABELLED, 0))
    chosen = chosen.groupBy("doc_id", "h").agg(F.collect_list("toxic").alias("toxic"))  # two of them at most
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"])  # MOST_POSITIVE + MOST_UNLABELLED rows of ids
    found = found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return common.materialize(found.select(F.explode("toxic").alias("toxic"), "text"))


def vocabulary_of(sample: DataFrame) -> Vocabulary:
    """The features that LEAST_TEXTS toxic texts have, and LEAST_LIFT times the share of them that unlabelled texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            toxic = np.array(batch.column("toxic").to_pylist()) == 1
            every = all_features(batch.column("text"))
            found, of = np.concatenate([np.zeros(0, np.uint64), *every]), np.repeat(toxic, [len(x) for x in every])
            u, at = np.unique(found, return_inverse=True)
            n = [np.bincount(at, weight, len(u)).astype(np.int64) for weight in (of, ~of)]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, n)], ["f", "p", "u"])

    size = dict(sample.groupBy("toxic").count().collect())
    counted = sample.mapInArrow(run, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    telling = counted.filter((F.col("p") >= LEAST_TEXTS) & (F.col("p") * size.get(0, 0) > LEAST_LIFT * F.col("u") * size.get(1, 0)))
    return Vocabulary(telling.select("f").toArrow().column("f").to_numpy().view(np.uint64))


def _vectors(sample: DataFrame, vocabulary: Vocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the toxic and of the unlabelled texts, which features of the vocabulary they have, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            found, begin = known_features(batch.column("text"), vocabulary)
            got = [found[a:b].astype(np.int32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(got, pa.binary())], ["toxic", "v"])

    every = sorted((r.toxic, bytes(r.v)) for r in sample.mapInArrow(run, "toxic int, v binary").collect())
    return tuple([np.frombuffer(v, np.int32) for toxic, v in every if toxic == k] for k in (1, 0))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From the rows that aren't held out. The prior is the share of toxic rows among those that are labelled there."""
    known = labels.filter(fold(labels["doc_id"]) != HELD_OUT).select("doc_id", "toxic")
    count = known.agg(F.count("toxic").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    sample = sampled(docs, known)
    vocabulary = vocabulary_of(sample)
    positive, unlabelled = _vectors(sample, vocabulary)
    common.release(sample.sparkSession, [sample.materialized])
    return train(vocabulary, positive, unlabelled, (count["toxic"] or 0) / count["n"] if count["n"] else 0.0)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, score (0 to 1), predicted (1 from 0.5 on)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            s = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return common.pick(docs, *dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
