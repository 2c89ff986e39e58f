"""Mixing sources to target weights, with DataFrame operations only.

1. Targets. A source's target is its share by weight of all words, at most MOST_TIMES its size; what is over is shared
   again by weight. That is filling with water: every target is min(cap, level * weight), and the level is the largest of
   those that the sources would give, in the order of cap / weight, if all before them were full.
2. Blocks. A source's documents, in an order by hash, are one stream of words, cut into blocks of BLOCK words. Offsets
   are running sums in two steps, over buckets and within them, so that no source is ordered in one task.
3. Draws. The mix has as many slots as the targets want, in output shards of equal size. The slots of each shard draw
   their sources at random by target: the counts of a shard are multinomial. Over all shards a source may be drawn more or less
   often than its target says; slots over it are given, in order, to the sources below theirs, so totals are exact.
4. Permutations. The i-th slot of a source is in its pass i div n over its n blocks, and takes block P(i mod n), where P
   is a pseudorandom permutation of that pass: a Feistel network over two residues with cycle walking. The last
   pass is partial, and its last slots are cut to the words that the target still wants.
5. Slots are joined to the blocks by index, and each document gets the words that were taken of it.

All randomness is xxhash64 of ids and SEED: reruns agree.

Rows that are equal in all that counts are counted, not ordered: however many they are, they are dealt to tasks in chunks.

Edge cases: null text has size 0, and such documents are never taken; a null source is a source of its own, the last; a
repeated row is a document of its own, and so is a null doc_id; an empty table, or one without words, gives rows with
nothing taken; ties in the order by hash are broken by doc_id and size, and the order of equal rows doesn't matter, because
they get values that may be exchanged; texts are read whole; further columns are dropped, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights by the order of source names, repeating; the most times that a source may be taken.
WEIGHTS, MOST_TIMES = (5.0, 2.0, 1.0), 3
BLOCK = 64
SEED = 20240229
#: Slots of an output shard at least, and shards at most.
SHARD_SLOTS, MOST_SHARDS = 4096, 65_536
#: Slots that a task makes of their counts, and equal rows that it counts as one.
TASK_SLOTS, TASK_COPIES = 1 << 18, 4096
_ROUNDS, _WALK = 4, 24


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, keep, size in words, chunk, copies: a row for each TASK_COPIES equal rows at most, so that no row, however
    often it is repeated, is more than a small part of a bucket. The only step that reads texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    read = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), *(docs[c] for c in keep), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"))
    equal = read.groupBy("doc_id", "source", *keep, "size").agg(F.count(F.lit(1)).alias("all"))
    cut = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / TASK_COPIES))))
    return cut.withColumn("copies", F.least(F.lit(TASK_COPIES), F.col("all") - F.col("chunk") * TASK_COPIES)).drop("all")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """A row for each source: idx, source, source_size, weight, target, its blocks n, the whole passes over them, the
    words of the partial pass (rest) and its slots (part), all its slots, where these begin among all (lo), and where the one
    short block, its last, comes in the partial pass (short). Windows over all sources are over this small table only."""
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).withColumn("idx", F.row_number().over(by_name) - 1)
    s = s.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("idx") % len(weights) + 1), "cap": most * F.col("source_size")})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(every) - full("cap")) / (F.sum("weight").over(every) - full("weight")))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
    want = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    s = s.withColumns({"n": F.ceil(F.col("source_size") / BLOCK), "passes": F.floor(want / size), "rest": want % size})
    s = s.withColumn("part", F.when(F.col("rest") > 0, F.least(F.col("n"), F.ceil(F.col("rest") / BLOCK) + 1)).otherwise(F.lit(0)))
    s = s.withColumn("slots", F.col("passes") * F.col("n") + F.col("part"))
    s = s.withColumn("short", F.when(F.col("n") > 0, permuted(F.col("n") - 1, F.col("n"), F.col("idx"), F.col("passes"), F.lit(seed), back=True)))
    return s.withColumn("lo", F.sum("slots").over(Window.orderBy("idx")) - F.col("slots")).drop("cap", "level")


#: What a slot has to know of its source.
_OF_SOURCE = ("slots", "source_size", "n", "passes", "rest", "short")


def draws(spark: SparkSession, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, idx, s (of the source), drawn: the multinomial counts of each output shard; base: the draws of that source in all
    shards before; have: in all shards. Every source with slots has a row."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    per = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    width = max(1, -(-total // 1024))  # a slot's source is found by the range that its number falls in, as an equi-join on parts of the ranges
    ranges = sources.filter("slots > 0").select("idx", "lo", (F.col("lo") + F.col("slots")).alias("hi"), F.struct(*_OF_SOURCE).alias("s"))
    parts = ranges.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slots = spark.range(total).select(F.floor(F.col("id") / per).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("u"))
    hits = slots.withColumn("part", F.floor(F.col("u") / width)).join(parts, "part").filter("u >= lo and u < hi").select("shard", "idx", "s", F.lit(1).alias("k"))
    none = ranges.select(F.lit(0).cast("long").alias("shard"), "idx", "s", F.lit(0).alias("k"))
    counts = hits.unionByName(none).groupBy("shard", "idx", "s").agg(F.sum("k").alias("drawn"))
    of = Window.partitionBy("idx").orderBy("shard")
    whole = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select("*", (F.sum("drawn").over(of) - F.col("drawn")).alias("base"), F.sum("drawn").over(whole).alias("have"))


def exact_slots(drawn: DataFrame) -> DataFrame:
    """shard, idx, s, i: each source's slots are numbered from 0 to its slots - 1, those drawn in excess given to sources in want."""
    slots = F.col("s.slots")
    have = drawn.groupBy("idx", "s", "have").agg(F.lit(0))
    in_order = Window.orderBy("idx")
    over, under = F.greatest(F.col("have") - slots, F.lit(0)), F.greatest(slots - F.col("have"), F.lit(0))
    have = have.select("idx", "s", "have", (F.sum(over).over(in_order) - over).alias("over_from"), (F.sum(under).over(in_order) - under).alias("under_from"))
    tasks = max(1, -(-(drawn.agg(F.sum("drawn")).first()[0] or 0) // TASK_SLOTS))
    rows = drawn.repartition(tasks, "shard", "idx")  # small as it is, it's about to grow to all slots
    end = F.col("base") + F.col("drawn")
    kept = rows.filter((F.col("drawn") > 0) & (F.col("base") < slots)).select("shard", "idx", "s", F.explode(F.sequence("base", F.least(end, slots) - 1)).alias("i"))
    spare = rows.filter((F.col("drawn") > 0) & (end > slots)).join(have.select("idx", "over_from"), "idx")
    spare = spare.select("shard", F.explode(F.sequence(F.greatest(F.col("base"), slots) - slots + F.col("over_from"), end - 1 - slots + F.col("over_from"))).alias("k"))
    want = have.filter(F.col("have") < slots).select("idx", "s", "have", "under_from", F.explode(F.sequence("have", slots - 1)).alias("i"))
    want = want.select("idx", "s", "i", (F.col("i") - F.col("have") + F.col("under_from")).alias("k"))
    return kept.unionByName(spare.join(want, "k").select("shard", "idx", "s", "i"))


def permuted(j: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """P(j), for a permutation P of 0..n-1 that the key chooses, or, back, what P takes to j. Numbers are pairs of residues
    modulo a and b, a * b just above n; in turns each residue is moved by a hash of the other, which can be undone; results
    from n on go round again (fewer than a ones of a * b, so hardly ever twice)."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def once(x: Column) -> Column:
        left, right = F.floor(x / b), x % b
        for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            if r % 2:
                by = F.pmod(F.xxhash64(left, *key, F.lit(r)), b)
                right = F.pmod(right - by if back else right + by, b)
            else:
                by = F.pmod(F.xxhash64(right, *key, F.lit(r)), a)
                left = F.pmod(left - by if back else left + by, a)
        return left * b + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(j), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def taken_blocks(slots: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, idx, i, block, words, all: which block each slot takes, how many of its words from its beginning, and whether in a whole pass."""
    s = F.col("s")
    x = slots.withColumns({"turn": F.floor(F.col("i") / s.n), "j": F.col("i") % s.n})
    x = x.withColumn("block", permuted(F.col("j"), s.n, F.col("idx"), F.col("turn"), F.lit(seed)))
    whole = F.least(F.lit(BLOCK), s.source_size - F.col("block") * BLOCK)
    before = F.col("j") * BLOCK - F.when(F.col("j") > s.short, s.n * BLOCK - s.source_size).otherwise(0)
    cut = F.greatest(F.lit(0), F.least(whole, s.rest - before))
    all_of = F.col("turn") < s.passes
    return x.select("shard", "idx", "i", "block", F.when(all_of, whole).otherwise(cut).alias("words"), all_of.alias("all"))


def offsets(sized: DataFrame, sources: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """sized with idx, source_size, target, bucket and pos (with idx a key for the row), and start, its first word's place in its
    source's stream. As many buckets as rows in each: the running sums over buckets and those within them are of equal length."""
    s = sources.select("idx", F.col("source").alias("s"), "source_size", "target")
    buckets = math.isqrt(sized.count()) + 1
    docs = sized.join(s, sized["source"].eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", *keep, "chunk", F.lit(SEED)), F.lit(buckets)))
    held = F.col("size") * F.col("copies")
    by = Window.partitionBy("idx", "bucket").orderBy(F.xxhash64("doc_id", "chunk", F.lit(SEED)), "doc_id", "size", "chunk", *keep)
    placed = docs.select("*", F.row_number().over(by).alias("pos"), (F.sum(held).over(by.rowsBetween(Window.unboundedPreceding, 0)) - held).alias("within"))
    first = docs.groupBy("idx", "bucket").agg(F.sum(held).alias("words"))
    first = first.select("idx", "bucket", (F.sum("words").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("words")).alias("first"))
    return placed.join(first, ["idx", "bucket"]).withColumn("start", F.col("first") + F.col("within")).drop("first", "within")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, keep, size, source_size, target, taken), and the slots of the mix (shard, idx, i, block, words, all)."""
    spark = docs.sparkSession
    sized = common.materialize(sizes(docs, keep))
    files = common.files_for(spark, sized.count())
    sources = common.materialize(targets(sized, weights, most, seed), files=1)
    slots = taken_blocks(exact_slots(common.materialize(draws(spark, sources, seed), files=files)), seed)
    blocks = slots.groupBy("idx", "block").agg(F.sum(F.col("all").cast("long")).alias("times"), F.sum(F.when(~F.col("all"), F.col("words")).otherwise(F.lit(0))).alias("cut"))
    blocks = common.materialize(blocks, files=files)
    rows = common.materialize(offsets(sized, sources, keep), files=files).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    rows = rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    end = F.col("start") + F.col("size")
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK)))))
    lo, hi = F.greatest("start", F.col("block") * BLOCK) - F.col("block") * BLOCK, F.least(end, (F.col("block") + 1) * BLOCK) - F.col("block") * BLOCK
    got = F.col("times") * (hi - lo) + F.greatest(F.lit(0), F.least(hi, F.col("cut")) - lo)
    columns = ["doc_id", "source", *keep, "size", "source_size", "target"]
    found = parts.join(blocks, ["idx", "block"], "left").groupBy("idx", "bucket", "pos", "copy", *columns).agg(F.sum(F.coalesce(got, F.lit(0))).alias("taken"))
    return found.select(*columns, "taken"), slots


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))[0].drop("source")
