"""N-gram Jaccard join: which documents' sets of word shingles are alike, by a size-aware heavy-light join.

Small sets enumerate their subsets of fixed sizes: two sets that are alike share one of as many elements as their
overlap must have. Large sets scan inverted lists: each set enters the lists of its rarest elements only, as many as a
set alike can't miss all of (prefix filter). The boundary between small and large comes from the cost of both, as
measured on all documents. Every candidate pair is then verified on whole sets, so the result is exact.

How groups and frequent shingles stay harmless, without dropping anything:

* Documents with equal sets are one class; classes are joined, not documents.
* The global order of shingles puts those that many documents share last, so a passage of a third of all documents makes no
  list of them. Which these are is counted by one aggregation over all documents (see counted()). The ORDERED most frequent
  get a rank; the order changes the work, never the result.
* A list is joined with its pivot only, the member that can reach most others, so a group of m near copies makes about m
  pairs. What the links of these pairs have put into one component needs no further test; the members outside a
  list's largest component are then tested against all members of other components that size and position in the
  list don't rule out.
* Before whole sets are compared, parities of a bit for each element rule out most pairs that aren't alike, without error.
* Components are found by large-star and small-star steps over tables.

Shingles: SHINGLE words, A-Z lower-cased, 64-bit hashes (see words.py). A text with fewer words is one shingle.

Edge cases: null text counts as empty; an empty set is linked with nothing, so its component is its own doc_id; repeated
rows (also of the same doc_id) are equal sets; rows of one doc_id with different texts are joined each; a null doc_id is
never a component's name unless all in it are null; an empty table gives an empty result; texts are read whole; ties
between pivots go to the lesser node, which changes no result; further columns are dropped, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import all_grams, mix, words

SHINGLE = 5
#: Similarity in hundredths.
ALIKE = 80
#: Shingles whose order is by frequency; of each set's, one in COUNTED is counted, and one counted LEAST_COUNTED times is frequent.
ORDERED, COUNTED, LEAST_COUNTED = 1 << 19, 8, 3
#: Sizes up to which the boundary is looked for; what a visit of a list's further member costs, in postings.
MOST_SMALL, VISIT = 24, 50.0
#: Bits of a Bloom filter for each key, and at most.
BLOOM_PER_KEY, BLOOM_MOST = 12, 1 << 27


def need(n: int | Column, m: int | Column) -> int | Column:
    """The least overlap of sets of n and m elements that are alike: ceil(ALIKE * (n + m) / (100 + ALIKE))."""
    if isinstance(n, Column):
        return F.floor((ALIKE * (n + m) + 99 + ALIKE) / F.lit(100 + ALIKE))
    return -(-ALIKE * (n + m) // (100 + ALIKE))


def least_common(n: int) -> int:
    """The least overlap of a set of n with any that is alike."""
    return -(-ALIKE * n // 100)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    g, at = all_grams(words(column, fold=True), SHINGLE)
    return [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of two mixed hashes, which the order of elements doesn't change."""
    size = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every ^ np.uint64(salt)))])
        out.append(mix(total[begin[1:]] - total[begin[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


@dataclass
class Order:
    """Of shingles: by hash, but those in `frequent` (sorted) last, by their rank."""

    frequent: np.ndarray
    rank: np.ndarray

    def sorted(self, s: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return s
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        late = self.frequent[at] == s
        if not late.any():
            return s
        return np.concatenate([s[~late], s[late][np.argsort(self.rank[at[late]], kind="stable")]])


def subset_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all subsets of s of each size that an overlap may have, and how many elements each leaves out."""
    keys, left = [], []
    n = len(s)
    m = mix(s ^ np.uint64(0xD6E8FEB86659FD93))
    for c in range(least_common(n), n + 1):
        chosen = np.array(list(combinations(range(n), c)))
        keys.append(mix(m[chosen].sum(axis=1, dtype=np.uint64) ^ np.uint64(c)))
        left.append(np.full(len(chosen), n - c))
    return np.concatenate(keys), np.concatenate(left)


def postings(s: np.ndarray, order: Order, small: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of a set, and of each how many of its elements can't be in an overlap that begins there (None: its place)."""
    n = len(s)
    prefix = order.sorted(s)[: n - least_common(n) + 1]
    if n > small:
        return prefix, None
    keys, left = subset_keys(s)
    if n < least_common(small + 1):
        return keys, left
    return np.concatenate([keys, prefix]), np.concatenate([left, np.arange(len(prefix))])  # may be alike to large sets


def boundary(sizes: dict[int, int], visited: float) -> int:
    """The largest size of small sets at the least cost: postings written, and list members visited for each posting of large sets."""
    light = lambda n: sum(comb(n, c) for c in range(least_common(n), n + 1))
    heavy = lambda n: (n - least_common(n) + 1) * (1 + VISIT * visited)
    cost, best, at = 0.0, 0.0, 0
    for n in range(1, MOST_SMALL + 1):
        cost += sizes.get(n, 0) * (light(n) - heavy(n))
        if cost < best:
            best, at = cost, n
    return at


def read_sets(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, n, d1, d2 (the digest), s (the set: sorted 64-bit hashes) for each document. Texts are read and hashed here
    only; all later steps read this table, and those columns of it that they need."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, *map(pa.array, digests(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "d1", "d2", "s"])

    read = common.pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, s binary")
    return common.materialize(read.select(F.monotonically_increasing_id().alias("row"), "*"))


def _different(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """The different sets of a batch (d1, d2, s) but for the empty one, and where each is first."""
    d1, d2 = (batch.column(c).to_numpy() for c in ("d1", "d2"))
    s = batch.column("s")
    first = {(a, b): i for i, (a, b) in reversed([*enumerate(zip(d1.tolist(), d2.tolist(), strict=True))])}
    at = [i for i in sorted(first.values()) if len(s[i].as_buffer())]
    return at, [np.frombuffer(s[i].as_buffer(), np.uint64) for i in at]


def counted(sets: DataFrame, files: int) -> DataFrame:
    """hash and docs, how many of all documents have a shingle and count it: every set counts those whose hash with its own
    digest falls on one of COUNTED, so that each shingle of f documents is counted about f / COUNTED times, whatever its hash and
    the number of tasks. Of those counted less than LEAST_COUNTED times there is one row (hash null), with their number, and how many
    others they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "s"):
            at, some = _different(batch)
            own = batch.column("d1").to_numpy().view(np.uint64)[at]
            some = [s[mix(s ^ d) >> np.uint64(64 - COUNTED.bit_length() + 1) == 0] for s, d in zip(some, own, strict=True)]
            u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["hash", "docs"])

    counts = sets.select("d1", "d2", "s").mapInArrow(run, "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))
    named = F.when(F.col("docs") >= LEAST_COUNTED, F.col("hash")).alias("hash")
    return common.materialize(counts.groupBy(named).agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * (F.col("docs") - 1)).alias("met")), files=files)


def plan(sets: DataFrame, files: int) -> tuple[Order, int]:
    stats = counted(sets, files)
    top = stats.filter("hash is not null").orderBy(F.desc("docs"), "hash").limit(ORDERED).select("hash").toArrow()  # 4 MB at most
    hashes = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    rank = -np.arange(len(hashes))  # the most frequent one last
    rest = stats.filter("hash is null").first()
    sizes = {r.n: r["count"] for r in sets.filter(F.col("n").between(1, MOST_SMALL)).groupBy("n").count().collect()}
    return Order(hashes[order], rank[order]), boundary(sizes, COUNTED * rest["met"] / rest["docs"] if rest else 0.0)


def classes_of(sets: DataFrame, order: Order, small: int, files: int) -> DataFrame:
    """A row for each different set that isn't empty: node, row (one that has it), d1, d2, n, bits (parity), keys, left (see postings)."""
    names = ["row", "d1", "d2", "n", "bits", "keys", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "s"):
            at, some = _different(batch)
            got = [postings(s, order, small) for s in some]
            keys = pa.array([k.view(np.int64) for k, _ in got], pa.list_(pa.int64()))
            left = pa.array([x for _, x in got], pa.list_(pa.int32()))
            own = batch.select(["row", "d1", "d2"]).take(pa.array(at, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in some], pa.int64()), pa.array([parity(s) for s in some], pa.binary()), keys, left], names)

    rows = sets.select("row", "d1", "d2", "s").mapInArrow(run, "row long, d1 long, d2 long, n long, bits binary, keys array<long>, left array<int>")
    one = rows.groupBy("d1", "d2").agg(*(F.first(c).alias(c) for c in ("row", "n", "bits", "keys", "left")))
    return common.materialize(one.coalesce(files).select(F.monotonically_increasing_id().alias("node"), *names))


def parity(s: np.ndarray) -> bytes:
    """Bits, at least as many as elements and a power of two: each is 1 where an odd number of elements falls on it. Two
    sets differ in at least as many elements as their parities differ in bits."""
    log = max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s) >> np.uint64(64 - log)).astype(np.int64), minlength=1 << log) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def overlap_bound(n: int, x: bytes, m: int, y: bytes) -> int:
    """The overlap of sets of n and m elements is at most this, by their parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):  # neighbouring bits together: what a hash with one bit less would have given
        bits = np.unpackbits(b)
        b = np.packbits(bits[::2] ^ bits[1::2])
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


class Bloom:
    """A filter for 64-bit keys, of bounded size; keys that it lets by in error only cost work."""

    def __init__(self, log_bits: int, bits: np.ndarray | None = None):
        self.log, self.bits = log_bits, np.zeros(1 << log_bits >> 3, np.uint8) if bits is None else bits

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for salt in (1, 2, 3):
            yield mix(keys ^ np.uint64(salt * 0x9FB21C651E98DF25 % (1 << 64))) >> np.uint64(64 - self.log)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, count: int) -> Bloom:
        """keys: one long column. The filter's words are put together by an aggregation over them; the driver gets each once."""
        log_bits = max(15, min((BLOOM_PER_KEY * count).bit_length(), BLOOM_MOST.bit_length() - 1))
        (name,) = keys.columns
        empty = cls(log_bits, np.zeros(0, np.uint8))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.sort(np.concatenate([*empty._at(batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64))]))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << log_bits >> 6, "<i8")
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        return cls(log_bits, words.view(np.uint8))


def members_of(classes: DataFrame, files: int) -> DataFrame:
    """key, node, n, left: the postings of the lists that have two members or more. Keys are counted over all classes; a
    filter of the shared keys then spares the other postings the second shuffle."""
    shared = common.materialize(classes.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1").select("key"), files=files)
    bloom = Bloom.of(shared, shared.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, left = batch.column("keys"), batch.column("left")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(lists.offsets.to_numpy())
            at = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            given = np.repeat(left.is_valid().to_numpy(zero_copy_only=False), size)
            at[given] = left.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            here = np.flatnonzero(bloom.has(keys))
            who = pa.array(row[here])
            yield pa.RecordBatch.from_arrays([pa.array(keys[here].view(np.int64)), batch.column("node").take(who), batch.column("n").take(who), pa.array(at[here].astype(np.int64))], ["key", "node", "n", "left"])

    likely = classes.select("node", "n", "keys", "left").mapInArrow(run, "key long, node long, n long, left long")
    return common.materialize(likely.join(shared, "key"), files=files)


def _pairs(a: str, b: str) -> tuple[Column, Column]:
    return F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")


def _may(a: str, b: str) -> Column:
    """Size and position don't rule the pair out, if this key is the first that they share."""
    t = need(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (F.col(f"{a}.n") - F.col(f"{a}.left") >= t) & (F.col(f"{b}.n") - F.col(f"{b}.left") >= t)


def star_pairs(members: DataFrame) -> DataFrame:
    """a, b: each list's members with its pivot, the one with most of its elements still to come."""
    pivot = members.groupBy("key").agg(F.min(F.struct((F.col("left") / F.col("n")).alias("part"), "node", "n", "left")).alias("p")).select("key", "p.node", "p.n", "p.left")
    return members.alias("m").join(pivot.alias("p"), "key").filter((F.col("m.node") != F.col("p.node")) & _may("m", "p")).select(*_pairs("m", "p")).distinct()


def other_pairs(members: DataFrame, components: DataFrame, files: int) -> DataFrame:
    """a, b: of lists that several components share, each member outside the largest of them with those of other components."""
    m = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    m = common.materialize(m, files=files)
    each = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = each.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "component")).alias("largest")).filter("parts > 1").select("key", F.col("largest.component").alias("largest"))
    of = m.join(mixed, "key")
    outside = of.filter("component != largest").alias("x")
    y = of.alias("y")
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    return outside.join(y, "key").filter((F.col("x.component") != F.col("y.component")) & once & _may("x", "y")).select(*_pairs("x", "y")).distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b that parities don't rule out, a few bits in place of whole sets."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "ba", "nb", "bb")), strict=True)
            here = pa.array([overlap_bound(n, x, m, y) >= need(n, m) for n, x, m, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(here), batch.column("b").filter(here)], ["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "na", "ba", "b", "nb", "bb").mapInArrow(run, "a long, b long")


def verified(sets: DataFrame, classes: DataFrame, pairs: DataFrame, files: int) -> DataFrame:
    """The pairs a, b that are alike, by their whole sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = common.materialize(classes.select("node", "row").join(nodes, "node", "left_semi"), files=files)
    bloom = Bloom.of(wanted.select("row"), wanted.count())  # spares the other sets the shuffle

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.has(batch.column("row").to_numpy().view(np.uint64))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                alike.append(len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y)))
            here = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(here), batch.column("b").filter(here)], ["a", "b"])

    some = common.materialize(sets.select("row", "s").mapInArrow(pick, "row long, s binary").join(wanted, "row").select("node", "s"), files=files)
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(some.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.mapInArrow(compare, "a long, b long")


def connected(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (the least node that it is connected with), for nodes that have an edge (a, b: longs). Large-star and small-star steps
    (Kiveris et al., 2014) until nothing changes; each is an aggregation and a join over tables."""
    now = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), files=files)
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = common.materialize(small, files=common.files_for(edges.sparkSession, before[0]))
        after = state(now)
        if tuple(after) == tuple(before):
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    with common.Scratch(docs.sparkSession) as scratch:
        sets = scratch.keep(read_sets(docs))
        files = common.files_for(docs.sparkSession, sets.count())  # tables of a few numbers for each document
        put = lambda df: common.materialize(df, files=files)
        order, small = plan(sets, files)
        classes = classes_of(sets, order, small, files)
        members = members_of(classes, files)
        stars = put(star_pairs(members))
        links = put(verified(sets, classes, put(likely(stars, classes)), files))
        first = put(connected(links, files))
        rest = put(other_pairs(members, first, files).join(stars, ["a", "b"], "left_anti"))
        more = verified(sets, classes, put(likely(rest, classes)), files)
        side = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        merged = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        second = connected(merged, files).select(F.col("node").alias("component"), F.col("component").alias("up"))
        grouped = classes.select("node", "d1", "d2").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
        grouped = grouped.join(second, "component", "left").select("d1", "d2", F.coalesce("up", "component").alias("component"))
        named = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least")).join(grouped, ["d1", "d2"])
        names = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = scratch.keep(put(named.join(names, "component").select("d1", "d2", "component_id")))
    empty = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.filter("n > 0").join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
