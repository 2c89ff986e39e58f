"""Reversible line dedup: documents come and go, and lines that many documents share stay in one of them only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least MIN_CHARS code points that
MIN_DOCS documents hold are repeated; their lines go, but for those in the largest doc_id that holds the key.

What is kept (Lines), as tables in the shared folder:

* log: exact references, (key, doc_id, how many rows of that doc_id hold the key), a table for each change. A deletion
  appends negative references, so what it takes back is exact.
* counts: for each key the documents that hold it, and the largest. A change counts anew only the keys that it touches.
* filters: a cuckoo filter for each shard of the repeated keys. A key that comes to MIN_DOCS documents is added, one that
  falls below is removed from its filter, nothing is built anew (but when a filter is full).

To find the lines that go, references are first tested against the filters, where they lie; only those that pass, a part
of all, are shuffled to meet the exact counts. The filters are sent to the executors as long as they have FILTER_BYTES
together (some 15 million repeated keys); beyond that all references meet the counts. The result is the same.

A key is a 128-bit hash (XXH3) of its bytes. No key's references ever meet in one task: counts combine on the map side, and
joins are plain ones, whose large partitions adaptive execution can split.

Edge cases: null and empty texts are one empty line; texts of any length are read whole; a key counts a document once,
however often it has it, and a doc_id once, however many rows it has; all rows of the largest doc_id keep their lines;
a row without doc_id holds no key and keeps all its lines; an empty table gives an empty result; further columns are
dropped, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .cuckoo import Cuckoo, Full

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a filter when it is built, and bytes of all filters that may be sent to every executor.
SHARD_KEYS, FILTER_BYTES = 1 << 17, 32 << 20
KEY = ["k1", "k2"]
_WHITE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes within a code point
_FILTERS = "shard int, keys long, cuckoo binary"


def _key(line: bytes) -> bytes | None:
    """The hash of a line's key, of those that are long enough."""
    import xxhash

    key = line.strip(_WHITE)
    if len(key) < MIN_CHARS or not key.isascii() and len(key.translate(None, _INNER)) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # of bytes, lower() knows A-Z only


def references(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, doc_id, refs: how many rows of this doc_id hold the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            ids, found, many = batch.column("doc_id").to_numpy(zero_copy_only=False), [], []
            for raw in batch.column("text").cast(pa.large_binary()).to_pylist():
                keys = {k for line in raw.split(b"\n") if len(line) >= MIN_CHARS and (k := _key(line))}
                found += keys
                many.append(len(keys))
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.repeat(ids, many), pa.int64())], [*KEY, "doc_id"])

    d = docs.filter(docs[doc_col].isNotNull() & docs[text_col].isNotNull()).select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, "k1 long, k2 long, doc_id long").groupBy(*KEY, "doc_id").agg(F.count(F.lit(1)).alias("refs"))


def _counted(refs: DataFrame) -> DataFrame:
    """k1, k2, docs, largest: of references that are in force, one row for each key and doc_id."""
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("largest"))


def _by_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int"))


def _filter_row(shard: int, keys: int, cuckoo: Cuckoo | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([keys], pa.int64()), "cuckoo": pa.array([cuckoo and cuckoo.raw()], pa.binary())})


def _of(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """A row for each shard that has keys (k1, k2, about SHARD_KEYS of them in a shard)."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        room = len(group)
        while True:
            cuckoo = Cuckoo.sized(room)
            try:
                cuckoo.add(_of(group["k1"]))
                return _filter_row(key[0].as_py(), len(group), cuckoo)
            except Full:
                room *= 2

    return _by_shard(repeated.select(*KEY), shards).groupBy("shard").applyInArrow(build, _FILTERS)


def changed_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """filters with the keys (k1, k2) of changes added (comes) or removed. A filter that has become full is null."""

    def change(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        keys, comes = _of(new["k1"]), new["comes"].to_numpy()
        held = old["keys"][0].as_py() if len(old) else 0
        cuckoo = Cuckoo.read(old["cuckoo"][0].as_py()) if len(old) else Cuckoo.sized(len(keys))
        try:
            cuckoo.remove(keys[~comes])
            cuckoo.add(keys[comes])
        except Full:
            cuckoo = None
        return _filter_row(key[0].as_py(), held + int(comes.sum()) - int((~comes).sum()), cuckoo)

    return filters.groupBy("shard").cogroup(_by_shard(changes, shards).groupBy("shard")).applyInArrow(change, _FILTERS)


def passing(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of refs whose key a filter has: every repeated one, and a few others."""
    size = filters.agg(F.coalesce(F.sum(F.length("cuckoo")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return refs
    sent = refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cuckoo) for r in filters.select("shard", "cuckoo").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Cuckoo.read(raw) for k, raw in sent.value.items()}
        for batch in batches:
            keys, shard = batch.column("k1").to_numpy().view(np.uint64), np.mod(batch.column("k2").to_numpy(), shards)
            good = np.zeros(len(keys), bool)
            for k in np.unique(shard).tolist():
                if k in held:
                    at = np.flatnonzero(shard == k)
                    good[at] = held[k].has(keys[at])
            yield batch.filter(pa.array(good))

    return refs.mapInArrow(run, refs.schema)


@dataclass
class Lines:
    """The state; insert() and delete() give the next one, this one stays as it is."""

    spark: SparkSession
    log: list[DataFrame] = field(default_factory=list)
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 1

    def insert(self, docs: DataFrame) -> Lines:
        """docs: doc_id and text, of documents that may be known or new."""
        return self._changed(common.materialize(references(docs)))

    def delete(self, ids: DataFrame) -> Lines:
        """Take back all rows of these doc_ids. Their texts aren't needed: what they held is in the log."""
        gone = self.in_force().join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return self._changed(common.materialize(gone.select(*KEY, "doc_id", (-F.col("refs")).alias("refs"))))

    def in_force(self, keys: DataFrame | None = None) -> DataFrame:
        """The log's references that aren't taken back, of all keys or of some."""
        one = reduce(DataFrame.union, self.log)
        one = one if keys is None else one.join(keys, KEY, "left_semi")
        return one if len(self.log) == 1 else one.groupBy(*KEY, "doc_id").agg(F.sum("refs").alias("refs")).filter("refs > 0")

    def _changed(self, change: DataFrame) -> Lines:
        new = Lines(self.spark, [*self.log, change])
        if self.counts is None:
            new.counts = common.materialize(_counted(change))
            return new._built()
        touched = common.materialize(change.select(*KEY).distinct())
        fresh = common.materialize(_counted(new.in_force(touched)))
        new.counts = common.materialize(self.counts.join(touched, KEY, "left_anti").unionByName(fresh))
        old = self.counts.join(touched, KEY, "left_semi").filter(F.col("docs") >= MIN_DOCS).select(*KEY)
        now = fresh.filter(F.col("docs") >= MIN_DOCS).select(*KEY)
        changes = now.join(old, KEY, "left_anti").withColumn("comes", F.lit(True)).union(old.join(now, KEY, "left_anti").withColumn("comes", F.lit(False)))
        new.shards, new.filters = self.shards, common.materialize(changed_filters(self.filters, changes, self.shards))
        full = new.filters.filter(F.col("cuckoo").isNull() | (F.col("keys") > 4 * SHARD_KEYS)).limit(1).count()
        return new._built() if full else new

    def _built(self) -> Lines:
        """The filters from the exact counts, in as many shards as these keys need."""
        repeated = self.repeated()
        self.shards = max(1, -(-repeated.count() // SHARD_KEYS))
        self.filters = common.materialize(build_filters(repeated, self.shards))
        return self

    def repeated(self) -> DataFrame:
        return self.counts.filter(F.col("docs") >= MIN_DOCS)

    def compacted(self) -> Lines:
        """The same state with one table of references."""
        return Lines(self.spark, [common.materialize(self.in_force())], self.counts, self.filters, self.shards)

    def losses(self) -> DataFrame:
        """doc_id, gone: the keys whose lines it loses. A filter's false positives end at the exact counts."""
        some = passing(self.in_force().select(*KEY, "doc_id"), self.filters, self.shards)
        lost = some.join(common.materialize(self.repeated()), KEY).filter("doc_id < largest")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("gone"))  # at most a document's lines


def without(docs: DataFrame, losses: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the text without the lines that go, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            texts, total, dropped = batch.column("text").cast(pa.large_binary()).to_pylist(), [], []
            for i, gone in enumerate(batch.column("gone").to_pylist()):
                total.append(texts[i].count(b"\n") + 1)
                dropped.append(0)
                if gone:
                    keys = {np.array([g["k1"], g["k2"]], np.int64).tobytes() for g in gone}
                    stay = [x for x in texts[i].split(b"\n") if len(x) < MIN_CHARS or _key(x) not in keys]
                    dropped[i] = total[i] - len(stay)
                    texts[i] = b"\n".join(stay)
            kept = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), kept.cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    d = docs.select(docs[doc_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return d.join(common.materialize(losses), "doc_id", "left").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = without(docs, Lines(spark).insert(docs).losses())
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{common.UPPER}', '{common.LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, coalesce(k.doc_id < c.largest, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY rid
"""
