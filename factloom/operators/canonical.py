"""One canonical id for each unit, decided in the order in which a run's records come.

A record takes, in this order: the id of its own source and source id, if they are known; the id of the one unit whose
fingerprint (photo, price, rooms, place) it shares, if both were posted at different times; the id that holds its signature, if
that id has no record of this source yet; else its own, which then holds the signature if nothing did. What a record
decides is seen by those after it.

The order looks sequential, but little of it is. Whether a fingerprint counts is known beforehand; the first record of a new
fingerprint never goes by a fingerprint; a signature is held by what is known or by the first record that has nothing
better; and of each source only the first such record after that can join. What is left is whether a record that came by id
or fingerprint had brought its source to the signature's id before: that is the only thing that depends on other decisions, always
on earlier ones. So all of it is aggregates and equi-joins, repeated until nothing changes (as often as decisions hang on
one another: two or three times), and no signature's records are ever sorted, or kept, in one task."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ARROW_BYTES, checkpointed

#: Ads in a stretch of their order, about; targets of a block at least; blocks at most, about; targets that are no work for a task yet.
STRETCH, JOINED, BLOCKS, FEW = 200_000, 32, 2_048, 5_000
#: Bytes of ads that are packed at once, about, and of texts that are written at once (or a longer one).
PACKED, WRITTEN = 16 << 20, 8 << 20
#: What the key of a photo begins with.
_PHOTO = "#"


def _known(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of what earlier runs stored: ids by source and source id; by fingerprint; by signature; the sources of these last."""
    earliest = F.struct("first_seen", "listing_id")
    exact = known.groupBy("source", "source_id").agg(F.min("listing_id").alias("exact"))
    marks = known.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min_by(F.struct("listing_id", "posted"), earliest).alias("stored"))
    holders = known.groupBy("signature").agg(F.min_by("listing_id", earliest).alias("claim"))
    k = known.select("signature", "source", F.col("listing_id").alias("claim")).distinct()
    return exact, marks, holders, k.join(holders, ["signature", "claim"], "left_semi").select("signature", "source").distinct()


def _apart(a, b):
    """Both were posted at times that are known, and differ."""
    said = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(said(a) != said(b), F.lit(False))


def _kinds(items: DataFrame, exact: DataFrame, marks: DataFrame) -> DataFrame:
    """items with what is known beforehand: kind (exact, strong, rest), fixed (the id, where it is known), through (the place of the
    record whose id it takes)."""
    firsts = items.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min_by(F.struct("at", "posted"), "at").alias("first"))
    i = items.join(exact, ["source", "source_id"], "left").join(marks, "fingerprint", "left").join(firsts, "fingerprint", "left")
    stored = F.col("stored").isNotNull() & _apart(F.col("posted"), F.col("stored.posted"))
    earlier = F.col("stored").isNull() & (F.col("first.at") < F.col("at")) & _apart(F.col("posted"), F.col("first.posted"))
    earlier = F.coalesce(earlier, F.lit(False))
    kind = F.when(F.col("exact").isNotNull(), "exact").when(stored | earlier, "strong").otherwise("rest")
    fixed = F.coalesce("exact", F.when(stored, F.col("stored.listing_id")))
    return i.select(*items.columns, kind.alias("kind"), fixed.alias("fixed"), F.when(fixed.isNull() & earlier, F.col("first.at")).alias("through"))


def canonical_ids(items: DataFrame, known: DataFrame) -> DataFrame:
    """at, listing_id, canonical_id. items: at (the order, different for each), listing_id, source, source_id, signature, fingerprint and
    posted (may be null). known: listing_id, source, source_id, signature, fingerprint, posted, first_seen."""
    items = items.select("at", "listing_id", "source", "source_id", "signature", "fingerprint", "posted")
    exact, marks, holders, held = _known(known)
    fixed = checkpointed(_kinds(items, exact, marks))
    rest = fixed.filter("kind = 'rest'")
    opened = rest.groupBy("signature").agg(F.min_by(F.struct("at", "listing_id", "source"), "at").alias("o"))
    claims = holders.join(opened, "signature", "full").select(
        "signature",
        F.coalesce("claim", "o.listing_id").alias("claim"),
        F.when(F.col("claim").isNull(), F.col("o.at")).alias("since"),
        F.when(F.col("claim").isNull(), F.col("o.source")).alias("opener"),
    )
    claims = checkpointed(claims)
    later = rest.join(claims, "signature").filter(F.col("since").isNull() | (F.col("at") > F.col("since")))
    first = later.filter(F.col("opener").isNull() | (F.col("source") != F.col("opener"))).groupBy("signature", "source").agg(F.min("at").alias("first"))
    first = checkpointed(first.join(held, ["signature", "source"], "left_anti"))
    others = checkpointed(fixed.filter("kind <> 'rest'").join(claims, "signature", "left").select("at", "signature", "source", "fixed", "through", "claim", "since"))
    through = fixed.filter("through is not null").select(F.col("through").alias("at")).distinct()
    said = fixed.join(through, "at", "left_semi").select("at", F.coalesce("fixed", "listing_id").alias("id"))
    while True:
        ids = others.join(said.select(F.col("at").alias("through"), "id"), "through", "left").withColumn("id", F.coalesce("fixed", "id"))
        came = ids.filter((F.col("id") == F.col("claim")) & (F.col("since").isNull() | (F.col("at") > F.col("since")))).groupBy("signature", "source").agg(F.min("at").alias("came"))
        joins = first.join(came, ["signature", "source"], "left").filter(F.col("came").isNull() | (F.col("came") > F.col("first")))
        joins = joins.join(claims.select("signature", "claim"), "signature").select(F.col("first").alias("at"), F.col("claim").alias("id"))
        decided = checkpointed(ids.select("at", "id").union(joins))
        # of all decisions only those that others go by can change any
        new = checkpointed(fixed.join(through, "at", "left_semi").join(decided, "at", "left").select("at", F.coalesce("id", "listing_id").alias("id")))
        same = new.join(said, ["at", "id"], "left_anti").limit(1).count() == 0
        said = new
        if same:
            return fixed.join(decided, "at", "left").select("at", "listing_id", F.coalesce("id", "listing_id").alias("canonical_id"))


def photos_of(photos) -> object:
    """Photo addresses without their parameters, each once."""
    return F.array_distinct(F.transform(F.filter(photos, lambda u: u.isNotNull() & (u != "")), lambda u: F.substring_index(u, "?", 1)))


def unit_candidates(targets: DataFrame, ads: DataFrame) -> DataFrame:
    """target, record_id, listing_id, evidence (photo, point, facts: which of them agree), for each ad that shares a photo with
    a target, or both point and facts; targets come from ads by their record_id. ads: record_id, listing_id, photos (an array), lat,
    lng, price, beds, baths.

    That is photo, or two of the three, so two equi-joins find all: by photo, and by point and facts together. The kinds that
    agree are read off the pair."""
    facts = F.when(F.col("price").isNotNull() & F.col("beds").isNotNull() & F.col("baths").isNotNull(), F.struct("price", "beds", "baths"))
    a = ads.select("record_id", "listing_id", photos_of(F.col("photos")).alias("photos"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng")).alias("point"), facts.alias("facts"))
    t = a.join(targets.select("record_id").distinct(), "record_id", "left_semi").select(F.col("record_id").alias("target"), F.col("photos").alias("p"), F.col("point").alias("q"), F.col("facts").alias("f"))
    seen = a.select("record_id", F.explode("photos").alias("one"))
    by_photo = t.select("target", F.explode("p").alias("one")).join(seen, "one").select("target", "record_id")
    both = a.filter("point is not null and facts is not null").select("record_id", "point", "facts")
    by_both = t.filter("q is not null and f is not null").select("target", F.col("q").alias("point"), F.col("f").alias("facts")).join(both, ["point", "facts"]).select("target", "record_id")
    pairs = by_photo.union(by_both).distinct().filter("target <> record_id").join(t, "target").join(a, "record_id")
    kinds = F.array_compact(F.array(F.when(F.arrays_overlap("p", "photos"), "photo"), F.when(F.col("q") == F.col("point"), "point"), F.when(F.col("f") == F.col("facts"), "facts")))
    return pairs.select("target", "record_id", "listing_id", kinds.alias("evidence"))


def in_order(candidates: DataFrame) -> DataFrame:
    """Those with most evidence first, then by listing."""
    return candidates.orderBy("target", F.desc(F.size("evidence")), "listing_id", "record_id")


# -- candidates as one text a target ----------------------------------------------------------------------------------------

_KINDS = ("facts", "point", "photo")
#: What is written of a candidate by its set of kinds (facts 1, point 2, photo 4), and how many they are.
_WRITTEN = pa.array([":" + "+".join(x for i, x in reversed(list(enumerate(_KINDS))) if k >> i & 1) + "," for k in range(8)], pa.large_string())
_MANY = np.array([k.bit_count() for k in range(8)], np.uint8)
_NONE, _NOTHING = np.empty(0, np.int64), pa.scalar("", pa.large_string())
#: Bits of monotonically_increasing_id that count within a band of 8 partitions.
_BAND = 36
#: Gaps from here on are written apart.
_FAR = 1 << 16


def _narrow(numbers: np.ndarray) -> tuple[str, bytes]:
    """Numbers from 0 on in as few bytes as they need, all first bytes before all second ones: so they compress best."""
    small = numbers.astype(np.min_scalar_type(int(numbers.max())))
    return small.dtype.str, small.view(np.uint8).reshape(len(small), -1).T.tobytes()


def _wide(kind: str, data: bytes) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel().astype(np.int64)


def _letters(texts: pa.StringArray) -> tuple[tuple[str, bytes], int, bytes]:
    """Lengths, and the bytes: all first ones before all second ones (width of the longest text), unless that takes much more room (0)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    width = int(lengths.max())
    if len(texts) * width > 2 * len(body):
        return _narrow(lengths), 0, body.tobytes()
    square = np.zeros((len(texts), width), np.uint8)
    square[np.arange(width) < lengths[:, None]] = body
    return _narrow(lengths), width, square.T.tobytes()


def _read_letters(lengths: tuple[str, bytes], width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes, body = _wide(*lengths), np.frombuffer(data, np.uint8)
    return sizes, body.reshape(width, -1).T[np.arange(width) < sizes[:, None]] if width else body


def _pack(ads: pa.Table) -> bytes:
    """Ads that hold a key, in their order: a byte or two each where they are many."""
    at, names = ads["at"].to_numpy(), pa.concat_arrays(pc.fill_null(ads["listing_id"], "").chunks)
    gaps = np.diff(at, prepend=0)
    far = np.flatnonzero(gaps >= _FAR)
    apart = far.tolist(), gaps[far].tolist()
    gaps[far] = 0
    said = []
    for c in ("point", "facts"):
        d = pa.concat_arrays(ads[c].chunks).dictionary_encode()
        said.append((_narrow(pc.fill_null(d.indices, -1).to_numpy() + 1), d.dictionary.to_pylist()))
    raw = pickle.dumps((_narrow(gaps), apart, _letters(names), said), pickle.HIGHEST_PROTOCOL)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _places(gaps: tuple[str, bytes], apart: tuple[list[int], list[int]]) -> np.ndarray:
    far = _wide(*gaps)
    far[apart[0]] = apart[1]
    return np.cumsum(far)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key a row (more of them, where its ads are very many): its ads, packed. They come in the order of keys, and then in their own."""
    last, parts, held, rows, size = None, [], 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary()))], ["key", "said"])

    for batch in batches:
        keys = batch["key"].dictionary_encode()
        cuts = np.flatnonzero(np.diff(keys.indices.to_numpy())) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), len(batch)]):
            if lo == hi:
                continue
            key = keys[lo].as_py()
            if parts and (key != last or held >= PACKED):
                rows.append((last, _pack(pa.Table.from_batches(parts))))
                size, parts, held = size + len(rows[-1][1]), [], 0
            last = key
            parts.append(batch.slice(lo, hi - lo))
            held += parts[-1].nbytes
        if size > ARROW_BYTES:
            yield made()
            rows, size = [], 0
    if parts:
        rows.append((last, _pack(pa.Table.from_batches(parts))))
    if rows:
        yield made()


class _Block:
    """The ads that hold any key of a block of targets, in their order, and who among them is a target's candidate."""

    def __init__(self, lists: list[tuple[str, bytes]]):
        keys, ats, sizes, bodies = [], [], [], []
        codes, self.codes = ([], []), ({}, {})
        for key, said in lists:
            gaps, apart, names, columns = pickle.loads(pa.decompress(said[8:], int.from_bytes(said[:8], "little"), "zstd"))
            keys.append(key)
            ats.append(_places(gaps, apart))
            size, body = _read_letters(*names)
            sizes.append(size)
            bodies.append(body)
            for (which, values), known, out in zip(columns, self.codes, codes, strict=True):
                out.append(np.array([-1, *(known.setdefault(v, len(known)) for v in values)], np.int32)[_wide(*which)])
        self.at, one, where = np.unique(np.concatenate([_NONE, *ats]), return_index=True, return_inverse=True)
        ends = pa.py_buffer(np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64))
        self.names = pa.LargeStringArray.from_buffers(len(where), ends, pa.py_buffer(np.concatenate([np.empty(0, np.uint8), *bodies]))).take(pa.array(one))
        self.by_photo = pc.binary_join_element_wise(self.names, _WRITTEN[4], _NOTHING)
        self.point, self.facts = (np.concatenate([_NONE, *c])[one] for c in codes)
        self.by_key: dict[str, list[np.ndarray]] = {}
        for key, rows in zip(keys, np.split(where, np.cumsum([len(x) for x in ats])[:-1]), strict=True):
            self.by_key.setdefault(key, []).append(rows)
        self.photos, self.shared, self.shot = None, _NONE, np.zeros(len(one), bool)

    def _rows(self, keys: list[str]) -> np.ndarray:
        """The ads that hold any of the keys."""
        rows = np.concatenate([_NONE, *(x for k in keys for x in self.by_key.get(k, ()))])
        rows.sort(kind="stable")
        fresh = np.ones(len(rows), bool)
        np.not_equal(rows[1:], rows[:-1], out=fresh[1:])
        return rows[fresh]

    def _found(self, own: list[int], keys: list[str], point: str | None, facts: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Who may be a target's candidates, and their kinds (0: none); those that share a photo come in their order."""
        photos = [k for k in keys if k.startswith(_PHOTO)]
        if photos != self.photos:  # neighbours often share them all
            self.shot[self.shared] = False
            self.photos, self.shared = photos, self._rows(photos)
            self.shot[self.shared] = True
            self.said = self.point[self.shared], self.facts[self.shared]
        p, f = (known.get(v, -2) for known, v in zip(self.codes, (point, facts), strict=True))
        kinds = (self.said[0] == p) * np.uint8(2) + (self.said[1] == f) + np.uint8(4)
        both = self._rows([k for k in keys if not k.startswith(_PHOTO)])
        rows, kinds = np.concatenate([self.shared, both]), np.concatenate([kinds, np.where(self.shot[both], 0, 3).astype(np.uint8)])
        for place in np.searchsorted(self.at, own):
            kinds[rows == place] = 0
        return rows, kinds

    def of(self, own: list[int], faces: list[dict]) -> list[pa.Buffer]:
        """The text of a target's candidates (for each ad with its id), with a comma after each: those with most evidence first."""
        rows, kinds = (np.concatenate(x) for x in zip(*(self._found(own, **face) for face in faces), strict=True))
        alone, more = rows[kinds == 4], np.flatnonzero((kinds & 3) > 0)
        if len(faces) > 1:
            alone.sort()
        more = more[np.lexsort((rows[more], 3 - _MANY[kinds[more]]))]
        said = pc.binary_join_element_wise(self.names.take(pa.array(rows[more])), _WRITTEN.take(pa.array(kinds[more])), _NOTHING)
        return [_joined(said), _joined(self.by_photo.take(pa.array(alone)))]


def _joined(texts: pa.LargeStringArray) -> pa.Buffer:
    """One after the other."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
    return (texts.buffers()[2] or pa.py_buffer(b"")).slice(ends[0], ends[-1] - ends[0])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each target with candidates a row. A block's lists come before its targets."""
    block, lists, index = None, [], None
    for batch in batches:
        targets, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            whose = pa.array(targets, batch.schema.field("target").type)  # noqa: B023
            ends = pa.array(np.cumsum([0, *(sum(x.size for x in text) for text in texts)]), pa.int32())  # noqa: B023
            said = pa.py_buffer(b"".join(x for text in texts for x in text))  # noqa: B023
            return pa.RecordBatch.from_arrays([whose, pa.StringArray.from_buffers(len(whose), ends.buffers()[1], said)], ["target", "ordered"])

        for of, target, key, said, own, faces in zip(*(batch[c].to_pylist() for c in ("block", "target", "key", "said", "own", "faces")), strict=True):
            if of != block:
                block, lists, index = of, [], None
            if key is not None:
                lists.append((key, said))
                continue
            if index is None:
                index, lists = _Block(lists), []
            text = [x for x in index.of(own, faces) if x.size]
            if text:
                text[-1] = text[-1].slice(0, text[-1].size - 1)
                targets.append(target)
                texts.append(text)
                size += sum(x.size for x in text)
            if size >= WRITTEN:
                yield made()
                targets, texts, size = [], [], 0
        if targets:
            yield made()


def _described(ads: DataFrame, n: int) -> DataFrame:
    """at (the place in the order of listings and records), record_id, listing_id, point and facts as texts, keys (of photos, and of point
    and facts together): ads that share a key are each other's candidates."""
    value = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c).cast("double")).cast("string")  # noqa: E731 (-0.0 is 0.0)
    whole = lambda *c: F.concat_ws(" ", *map(value, c))
    given = lambda *c: F.when(F.forall(F.array(*(F.col(x).isNotNull() for x in c)), lambda x: x), whole(*c))
    a = ads.filter("record_id is not null").select("record_id", "listing_id", "photos", "lat", "lng", "price", "beds", "baths")
    a = a.repartitionByRange(max(1, -(-n // STRETCH)), "listing_id", "record_id").sortWithinPartitions("listing_id", "record_id")
    a = a.select(F.monotonically_increasing_id().alias("at"), "record_id", F.col("listing_id").cast("string").alias("listing_id"), photos_of(F.col("photos")).alias("photos"), given("lat", "lng").alias("point"), given("price", "beds", "baths").alias("facts"))
    shots = F.transform(F.coalesce("photos", F.array().cast("array<string>")), lambda u: F.concat(F.lit(_PHOTO), u))
    both = F.concat(F.lit("="), F.concat_ws(" ", "point", "facts"))
    return checkpointed(a.select("at", "record_id", "listing_id", "point", "facts", F.when(F.col("point").isNull() | F.col("facts").isNull(), shots).otherwise(F.array_append(shots, both)).alias("keys")))


def _blocks(targets: DataFrame, a: DataFrame) -> tuple[DataFrame, int]:
    """block, target, own (the places of its ads), faces (their keys, point, facts): targets that share the keys of most targets are
    neighbours in one order, which is cut into blocks; and how many blocks there are, about."""
    t = a.join(targets.select("record_id").distinct(), "record_id", "left_semi").filter(F.size("keys") > 0)
    t = checkpointed(t.groupBy(F.col("record_id").alias("target")).agg(F.collect_list("at").alias("own"), F.collect_list(F.struct("keys", "point", "facts")).alias("faces")))
    n = t.count()
    held = t.select("target", F.explode(F.array_distinct(F.flatten("faces.keys"))).alias("key"))
    shares = held.groupBy("key").agg(F.count("*").alias("n"))
    order = held.join(shares, "key").groupBy("target").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))).alias("order"))
    many = max(1, min(BLOCKS, -(-n // JOINED)))
    t = t.join(order, "target").repartitionByRange(many, "order", "target").select(F.spark_partition_id().alias("block"), "target", "own", "faces")
    return checkpointed(t.coalesce(max(1, n // FEW))), many


def _lists(a: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """block, key, said: to each block the ads that hold one of its keys, packed, a row for each key and band of their order."""
    wanted = blocks.select("block", F.explode(F.flatten("faces.keys")).alias("key")).distinct()
    a = a.select("at", "listing_id", "point", "facts", F.explode("keys").alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    a = a.repartition(max(1, -(-3 * n // STRETCH)), "key", F.shiftright("at", _BAND)).sortWithinPartitions("key", "at")
    return a.mapInArrow(_packed, "key string, said binary").join(wanted, "key").select("block", "key", "said")


def candidate_lines(targets: DataFrame, ads: DataFrame) -> DataFrame:
    """block, key, said: all that is sent to targets to find what unit_candidates finds.

    A target of many candidates has them all in its text, so texts grow with the square of the ads wherever photos repeat. None
    of that is a row or shuffled: a key's ads go, packed, once to each block of targets that holds the key. There are at most
    about BLOCKS of these, so where keys repeat what is sent grows with the ads."""
    n = ads.count()
    a = _described(ads, n)
    return _lists(a, _blocks(targets, a)[0], n)


def ordered_candidates(targets: DataFrame, ads: DataFrame) -> DataFrame:
    """target, ordered: all candidates of a target as `listing:evidence,...`, those with most evidence first, then by listing and record.
    A task writes the texts of a block's targets one by one, from the lists that it got."""
    n = ads.count()
    a = _described(ads, n)
    blocks, many = _blocks(targets, a)
    rows = blocks.unionByName(_lists(a, blocks, n), allowMissingColumns=True)
    rows = rows.repartitionById(many, "block").sortWithinPartitions("block", F.col("key").isNull(), "key", "faces", "target")
    return rows.mapInArrow(_written, f"target {ads.schema['record_id'].dataType.simpleString()}, ordered string")
