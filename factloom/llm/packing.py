"""Packing documents into windows of WINDOW tokens by lexical retrieval.

Documents are dealt into shards by what they say: each goes to the nearest of the centres of a bounded sample (cosine of
hashed, idf-weighted terms), small neighbouring groups share a shard, and large ones are cut by the rarest-biased minhash
of their terms, so that near copies stay together; only equal keys beyond a shard's size are cut by a hash, and equal rows
among them are counted off. A shard's size is what its documents weigh: their tokens, and OWN_WEIGHT for each. A shard is
packed alone: its inverted index of token ids, with BM25 weights by document frequencies and mean length of all documents,
returns, for the document that begins a window (the seed), the neighbours that aren't used yet, best first by all terms
of the seed, and these fill the window greedily. A document that doesn't fit is cut, and its rest is the seed of
the next window; where no neighbour shares a term, the next unused document goes in. What is left at a shard's end becomes
sequences of powers of two, so no sequence needs padding.

A task holds one shard at a time. Documents of other shards are no candidates.

Edge cases: null text counts as empty, and gives a document of the end token alone; repeated rows are packed each, like
any others (their pieces can't be told apart by doc_id alone); a null doc_id is packed too; documents longer than a
window run through as many as they need; documents of equal scores follow in the order of key, doc_id and tokens; an
empty table gives an empty result; further columns are dropped, whatever they are called.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 2048
#: What a shard weighs: about 1,000 documents of 500 tokens.
SHARD_WEIGHT, OWN_WEIGHT = 1_000_000, 500
#: Shards that a task packs, one after the other.
TASK_SHARDS = 4
#: BM25.
K1, B = 1.2, 0.75
#: Affinity: documents that centres are made from, centres at most, hashed dimensions, rounds, keys by which large groups are cut.
SAMPLE, MOST_CENTRES, WIDTH, ROUNDS, KEYS = 8192, 2048, 256, 5, 64
END, SPECIAL = 1, "<|endoftext|>"
#: Files of the vocabulary, by their names in public_tokenizers: for the tokenizers library, and the same as ranks.
VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
#: Characters from which a text's ids don't become a list first, which is faster, but takes ten times their memory.
LONG = 1 << 20
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _encoder(names: tuple[str, str]):
    """text -> ids (uint32). The ranks give what the tokenizers library gives, several times as fast (a test holds them
    together for every code point); a text with the special token's string goes to that library."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(names[1]), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = functools.cache(lambda: Tokenizer.from_file(public_tokenizers.path(names[0])))

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) > LONG:
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(fast.encode_ordinary(text), np.uint32)

    encode.size = max(fast.max_token_value, slow().get_vocab_size() - 1, END) + 1
    return encode


def tokens(text: str | None, names: tuple[str, str] = VOCABULARY) -> np.ndarray:
    return np.append(_encoder(names)(text), np.uint32(END)).astype("<u4") if text else np.array([END], "<u4")


@dataclass
class Statistics:
    """Of all documents: their number, their mean length, and each token's idf."""

    docs: int
    mean: float
    idf: np.ndarray


def _idf(docs: int, held: np.ndarray) -> np.ndarray:
    return np.log1p((docs - held + 0.5) / (held + 0.5)).astype(np.float32)


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of each document, document by document: the term, its document, its times; where each document's begin."""
    counted = [np.unique(x, return_counts=True) for x in docs]
    n = [len(c[0]) for c in counted]
    term, times = (np.concatenate([c[i] for c in counted]) for i in (0, 1))
    return term.astype(np.int64), np.repeat(np.arange(len(docs)), n), times.astype(np.float32), np.concatenate([[0], np.cumsum(n)])


#: A term that one in so many of a shard's documents has keeps its list in full: a weight for each document, 0 where it isn't.
FULL_LIST = 8


class Index:
    """An inverted index of some documents: for each token id the list of the documents that have it, with their BM25 weights, by the
    statistics of all documents (else of these). Lists of rare terms are postings, those of frequent ones are kept in full."""

    def __init__(self, docs: list[np.ndarray], whole: Statistics | None = None):
        size = np.array([len(x) for x in docs])
        term, doc, times, self.first = _terms(docs)
        idf, mean = (whole.idf, whole.mean) if whole else (_idf(len(docs), np.bincount(term)), size.mean())
        weight = idf[term] * times * (K1 + 1) / (times + (K1 * (1 - B + B * size / mean)).astype(np.float32)[doc])
        _, self.own, held = np.unique(term, return_inverse=True, return_counts=True)  # each document's terms, by the places of their lists
        frequent = held * FULL_LIST > len(docs)
        self.full = np.cumsum(frequent) - 1
        self.full[~frequent] = -1
        often = frequent[self.own]
        self.lists = np.zeros((int(frequent.sum()), len(docs)), np.float32)
        self.lists[self.full[self.own[often]], doc[often]] = weight[often]
        by_term = np.argsort(self.own[~often], kind="stable")
        self.posting, self.weight = doc[~often][by_term], weight[~often][by_term]
        self.begin = np.searchsorted(self.own[~often][by_term], np.arange(len(held) + 1))
        self.ids = np.arange(len(docs))

    def _drop(self, unused: np.ndarray) -> None:
        """Take the used documents out of all lists."""
        stay = unused[self.ids]
        place = np.cumsum(stay) - 1
        self.ids, self.lists = self.ids[stay], self.lists[:, stay]
        left = stay[self.posting]
        self.begin = np.concatenate([[0], np.cumsum(left)])[self.begin]
        self.posting, self.weight = place[self.posting[left]], self.weight[left]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, the best first: only the lists of the seed's terms are read. Used
        documents stay in the lists until half of them are used."""
        if 2 * np.count_nonzero(unused) < len(self.ids):
            self._drop(unused)
        if not len(self.ids):
            return self.ids
        terms = self.own[self.first[seed] : self.first[seed + 1]]
        full = self.full[terms]
        score = self.lists[full[full >= 0]].sum(0)
        terms = terms[full < 0]
        n = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = score + np.bincount(self.posting[at], self.weight[at], len(self.ids))
        found = np.flatnonzero((score > 0) & unused[self.ids])
        return self.ids[found[np.argsort(-score[found], kind="stable")]]


def order(docs: list[np.ndarray], window: int = WINDOW, whole: Statistics | None = None) -> list[int]:
    """The order in which the documents are laid into windows, one after the other."""
    index, unused, out, at = Index(docs, whole), np.ones(len(docs), bool), [], 0
    ranked: Iterator[int] = iter(())
    others = iter(range(len(docs)))
    for _ in docs:
        d = next((x for x in ranked if unused[x]), None)
        seeds = d is None
        if seeds:  # no neighbour is left that shares a term
            d = next(x for x in others if unused[x])
        unused[d] = False
        out.append(d)
        before, at = at // window, at + len(docs[d])
        if seeds or at // window != before:  # it begins a window, or the rest of one that no neighbour fills
            ranked = iter(index.neighbours(d, unused).tolist() if at % window else ())
    return out


def pieces(lengths: list[int], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents laid one after the other: full windows, then powers of two."""
    total = sum(lengths)
    full, rest = divmod(total, window)
    bounds = [window] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    seq, room = 0, bounds[0] if bounds else 0
    for d, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(room, n - start)
            yield d, start, take, seq, bounds[seq] - room
            start, room = start + take, room - take
            if not room and seq + 1 < len(bounds):
                seq += 1
                room = bounds[seq]


def statistics(coded: DataFrame, size: int) -> Statistics:
    """From the counts that each task has written (see shards()): one for each token of the vocabulary at most."""
    one = coded.filter("held is not null").select(F.explode(F.arrays_zip("at", "held")).alias("x")).select("x.at", "x.held")
    found = one.groupBy("at").agg(F.sum("held").alias("n")).toArrow()
    held = np.zeros(size + 2, np.int64)
    held[found.column("at").to_numpy()] = found.column("n").to_numpy()
    docs, total = held[size:].tolist()
    return Statistics(docs, total / max(1, docs), _idf(docs, held[:size]))


def vectors(docs: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: a unit vector of its idf-weighted terms, hashed to WIDTH dimensions; a key out of KEYS by the
    minhash of its terms, in which rare ones come first more often."""
    term, of, times, first = _terms(docs)
    every = np.random.default_rng(0)
    slot, sign, draw, key = every.integers(0, WIDTH, len(idf)), every.choice([-1.0, 1.0], len(idf)), every.exponential(size=len(idf)), every.integers(0, KEYS, len(idf))
    v = np.bincount(of * WIDTH + slot[term], sign[term] * np.log1p(times) * idf[term], len(docs) * WIDTH).reshape(len(docs), WIDTH)
    turn = np.argsort(draw / np.maximum(idf, 1e-6) ** 2)
    rank = np.empty(len(idf), np.int64)
    rank[turn] = np.arange(len(idf))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32), key[turn[np.minimum.reduceat(rank[term], first[:-1])]]


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(v @ centres.T, 4), axis=1)


def centres(v: np.ndarray, most: int) -> np.ndarray:
    """Spherical k-means, begun at documents spread over the sample; in an order in which neighbours are alike."""
    v = np.unique(v, axis=0)
    if most < 2 or len(v) < 2:
        return v[:1]
    at = v[np.random.default_rng(0).permutation(len(v))[:most]]
    for _ in range(ROUNDS):
        of = nearest(v, at)
        sums = np.zeros_like(at)
        np.add.at(sums, of, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), at)
    left, chain = np.ones(len(at), bool), [0]
    left[0] = False
    while left.any():
        chain.append(int(np.argmax(np.where(left, at @ at[chain[-1]], -2))))
        left[chain[-1]] = False
    return at[chain]


def deal(groups: list[tuple[int, int, int]], shard_weight: int) -> list[tuple[int, int, int, int]]:
    """groups: (centre, key, weight), in order. (centre, key, first shard, shards): centres stay whole while a shard has
    room, larger ones are cut between keys, and a key beyond a shard's size over several shards."""
    most, out, shard, held = shard_weight * 3 // 2, [], 0, 0
    for _, of in itertools.groupby(groups, key=lambda g: g[0]):
        of = list(of)
        whole = sum(n for _, _, n in of)
        for unit in [of] if whole <= most else [[g] for g in of]:
            n = sum(g[2] for g in unit)
            if held and held + n > most:
                shard, held = shard + 1, 0
            spread = max(1, n // shard_weight) if n > most else 1
            out += [(c, k, shard, spread) for c, k, _ in unit]
            shard, held = (shard + spread, 0) if spread > 1 else (shard, held + n)
    return out


def shards(docs: DataFrame, shard_weight: int, names: tuple[str, str]) -> tuple[DataFrame, int, Statistics, str]:
    """doc_id, ids, shard, key; the number of shards; the statistics of all documents; the type of the ids. Texts are encoded once, to a table, which
    gets the counts of each task too."""
    spark = docs.sparkSession
    size = _encoder(names).size
    width = "<u2" if size <= 1 << 16 else "<u4"
    each = np.dtype(width).itemsize

    names_of = ["doc_id", "ids", "at", "held"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 2, np.int64)  # documents with each token; at the end: documents, tokens
        kinds = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in common.pieces(batches, "text"):
            ids = [tokens(x, names).astype(width) for x in batch.column("text").to_pylist()]
            for x in ids:
                held[np.unique(x)] += 1
                held[size:] += 1, len(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), *(pa.nulls(len(ids), k) for k in kinds)], names_of)
        at = np.flatnonzero(held)
        counts = [pa.array([x.tolist()], k) for x, k in zip((at, held[at]), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *counts], names_of)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    written = common.materialize(texts.mapInArrow(encode, "doc_id long, ids binary, at array<int>, held array<long>"))
    whole = statistics(written, size)
    coded = written.filter("ids is not null").select("doc_id", "ids")
    marked = coded.select("*", F.xxhash64("doc_id", "ids").alias("mark"))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "ids"):
            v = vectors([np.frombuffer(x, width) for x in batch.column("ids").to_pylist()], whole.idf)[0]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array([x.tobytes() for x in v], pa.binary())], ["mark", "v"])

    many = min(MOST_CENTRES, -(-(whole.docs * OWN_WEIGHT + round(whole.docs * whole.mean)) // shard_weight))
    at = np.zeros((1, WIDTH), np.float32)
    if many > 1:
        marks = marked.select("mark").distinct().orderBy(F.xxhash64("mark"), "mark").limit(SAMPLE).select(F.col("mark").alias("some"))
        some = marked.join(F.broadcast(marks), F.col("mark") == F.col("some"), "left_semi")  # SAMPLE numbers
        some = some.groupBy("mark").agg(F.first("ids").alias("ids"))  # equal marks have equal ids
        found = sorted((r.mark, bytes(r.v)) for r in some.mapInArrow(vector, "mark long, v binary").collect())  # SAMPLE rows of 1 KB
        at = centres(np.array([np.frombuffer(v, np.float32) for _, v in found], np.float32).reshape(-1, WIDTH), many)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "ids"):
            ids = [np.frombuffer(x, width) for x in batch.column("ids").to_pylist()]
            v, key = vectors(ids, whole.idf)
            seen: Counter[int] = Counter()
            turn = []
            for m in batch.column("mark").to_pylist():  # equal rows are counted off, so that they don't all go to one shard
                turn.append(m + seen[m] & (1 << 62) - 1)
                seen[m] += 1
            weight = pa.array([len(x) + OWN_WEIGHT for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids")), pa.array(nearest(v, at), pa.int32()), pa.array(key, pa.int32()), pa.array(turn, pa.int64()), weight], ["doc_id", "ids", "centre", "key", "turn", "weight"])

    placed = common.materialize(marked.mapInArrow(place, "doc_id long, ids binary, centre int, key int, turn long, weight long"))
    common.release(spark, [written.materialized])
    groups = sorted((r.centre, r.key, r.n) for r in placed.groupBy("centre", "key").agg(F.sum("weight").alias("n")).collect())
    dealt = deal(groups, shard_weight)
    plan = spark.createDataFrame(dealt, "centre int, key int, first long, spread long")
    out = placed.join(F.broadcast(plan), ["centre", "key"])  # at most MOST_CENTRES * KEYS rows
    return out.select("doc_id", "ids", (F.col("first") + F.pmod("turn", "spread")).alias("shard"), "key"), max((f + k for _, _, f, k in dealt), default=0), whole, width


def pack(docs: DataFrame, shard_weight: int = SHARD_WEIGHT, window: int = WINDOW, names: tuple[str, str] = VOCABULARY) -> DataFrame:
    """_OUT, a row for each piece. Documents are shuffled once, to their shards."""
    dealt, many, whole, width = shards(docs, shard_weight, names)
    dealt = dealt.repartition(max(1, -(-many // TASK_SHARDS)), "shard").sortWithinPartitions("shard", "key", "doc_id", F.xxhash64("ids"))
    columns = [x.split()[0] for x in _OUT.split(", ")]

    def packed(shard: int, ids: list, coded: list) -> pa.RecordBatch:
        docs = [np.frombuffer(x, width).astype("<u4") for x in coded]
        laid = order(docs, window, whole)
        rows = []
        for d, start, length, seq, offset in pieces([len(docs[d]) for d in laid], window):
            d = laid[d]
            rows.append((ids[d], start, length, zlib.crc32(docs[d][start : start + length]), len(docs[d]), (shard << 32) + seq, offset))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, coded = None, [], []
        for batch in common.pieces(batches, "ids"):
            for doc_id, code, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "shard")), strict=True):
                if ids and shard != now:
                    yield packed(now, ids, coded)
                    ids, coded = [], []
                now = shard
                ids.append(doc_id)
                coded.append(code)
        if ids:
            yield packed(now, ids, coded)

    return dealt.mapInArrow(run, _OUT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
