"""Which records speak of the same entity: signatures, fingerprints, canonical ids, candidates by k of n kinds of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .places import substring_area


def with_signature(listings: DataFrame) -> DataFrame:
    return listings.withColumn("signature", S.signature(F.col("title"), F.col("rent"), F.col("address")))


def signature_groups(listings: DataFrame) -> DataFrame:
    """Signatures that several sources share, with their members' number and the least id."""
    g = with_signature(listings).groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.min("listing_id").alias("least"))
    return g.filter("sources > 1")


def canonical_ids(listings: DataFrame) -> DataFrame:
    """listing_id, canonical_id. Within a signature, in the order of source and id, the first listing names the group;
    the first of each other source joins it, further ones of a source stay alone: units of one building look alike.

    Both firsts are aggregates, and the join with them is one that Spark can split: no signature is ordered in one task."""
    w = with_signature(listings).select("listing_id", "source", "signature")
    first = w.groupBy("signature", "source").agg(F.min("listing_id").alias("first"))
    lead = first.groupBy("signature").agg(F.min_by("first", "source").alias("lead"))
    joins = first.join(lead, "signature").select(F.col("first").alias("listing_id"), "lead")
    return w.select("listing_id").join(joins, "listing_id", "left").select("listing_id", F.coalesce("lead", "listing_id").alias("canonical_id"))


def resolve_ids(new: DataFrame, known_sources: DataFrame, fingerprints: DataFrame, signatures: DataFrame) -> DataFrame:
    """canonical_id of new records in the order of evidence: the same source and id, then the same unit's fingerprint, then the
    signature of another source, then their own id."""
    out = new.join(known_sources.select("source", "source_id", F.col("listing_id").alias("exact")), ["source", "source_id"], "left")
    out = out.join(fingerprints.select("fingerprint", F.col("listing_id").alias("strong")), "fingerprint", "left")
    sig = signatures.select("signature", F.col("listing_id").alias("alike"), F.col("sources").alias("alike_sources"))
    out = out.join(sig, "signature", "left")
    other = F.when(~F.array_contains("alike_sources", F.col("source")), F.col("alike"))
    return out.withColumn("canonical_id", F.coalesce("exact", "strong", other, "listing_id")).drop("exact", "strong", "alike", "alike_sources")


def unit_fingerprint(photo_url: Column, price: Column, beds: Column, baths: Column, lat: Column, lng: Column) -> Column:
    """Null unless photo and place are known."""
    parts = F.concat_ws("|", F.substring_index(photo_url, "?", 1), price.cast("string"), beds.cast("string"), baths.cast("string"), F.round(lat, 4).cast("string"), F.round(lng, 4).cast("string"))
    return F.when(photo_url.isNotNull() & lat.isNotNull(), F.sha2(parts, 256))


def candidates(listings: DataFrame, k: int = 2) -> DataFrame:
    """a, b, evidence: listings that agree in at least k of: point, (rent, beds, baths), signature.

    Of the listings that share two kinds of evidence, the one of the least id (a) stands for all: each other one (b) is paired
    with it, so a key of m listings gives m - 1 pairs, and what they all share is in these. k = 3 keeps those of them that
    agree in all. No pair is tried without two values in common, and no key is ordered or crossed."""
    l = with_signature(listings).select("listing_id", F.concat_ws("|", F.round("lat", 4), F.round("lng", 4)).alias("point"), F.col("lat").isNotNull().alias("placed"), "rent", "beds", "baths", "signature")
    point = F.when(F.col("placed"), F.col("point"))
    size = F.when(F.col("rent").isNotNull() & F.col("beds").isNotNull() & F.col("baths").isNotNull(), F.concat_ws("|", "rent", "beds", "baths"))
    l = l.select("listing_id", point.alias("point"), size.alias("size"), "signature")
    kinds = ["point", "size", "signature"]
    found = None
    for i, x in enumerate(kinds):
        for y in kinds[i + 1 :]:
            some = l.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            lead = some.groupBy(x, y).agg(F.min(F.struct("listing_id", *kinds)).alias("lead"))
            agree = sum((F.coalesce((F.col(c) == F.col(f"lead.{c}")).cast("int"), F.lit(0)) for c in kinds), F.lit(0))
            pairs = some.join(lead, [x, y]).filter(F.col("listing_id") != F.col("lead.listing_id")).select(F.col("lead.listing_id").alias("a"), F.col("listing_id").alias("b"), agree.alias("evidence"))
            found = pairs if found is None else found.union(pairs)
    return found.distinct().filter(F.col("evidence") >= k)


def area_from_text(texts: DataFrame, keywords: DataFrame, text_col: str, id_col: str, city: str | None = None) -> DataFrame:
    """The first key (by name) with a keyword in a text, as whole words; the city's own name is none. A row for each text that has one.
    Between spaces, runs of words are substrings: texts are passed once by an automaton of all keywords (see substring_area)."""
    key = lambda c: F.array_join(S.words(c), " ")
    apart = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    k = keywords.select(key(F.col("keyword")).alias("said"), "key").filter(F.col("said") != "")
    if city is not None:
        k = k.filter(F.col("said") != key(F.lit(city)))
    k = k.select("key", apart(F.col("said")).alias("keyword"), F.dense_rank().over(Window.orderBy("key")).alias("ordinal"))  # a city file's areas
    t = texts.select(id_col, apart(key(F.col(text_col))).alias("text"))
    return substring_area(t, k, "text", id_col).filter("area_key is not null").select(id_col, "area_key")


def matching_addresses(listings: DataFrame) -> DataFrame:
    """a, b: a listing and another whose address matches its own. Of listings with the same key, and of keys of one street number
    that hold one another, the one of the least id stands for all: each other member is paired with it, and these with each
    other, so a key of m listings gives m - 1 pairs. A listing without an address matches none.

    A key that another holds begins with their number, so it is one of the few parts of that key that do: keys meet by an
    equi-join on these, never by their number alone."""
    l = listings.select("listing_id", S.match_key(F.col("address")).alias("key")).filter("key <> ''")
    keys = l.groupBy("key").agg(F.min("listing_id").alias("least")).withColumn("number", F.element_at(F.split("key", " "), 1))
    members = l.join(keys, "key").filter("listing_id <> least").select(F.col("least").alias("a"), F.col("listing_id").alias("b"))
    begins = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr("key", i, F.length("number")) == F.col("number"))
    parts = F.flatten(F.transform(begins, lambda i: F.transform(F.sequence(F.length("number"), F.length("key") - i + 1), lambda n: F.substr("key", i, n))))
    held = keys.select("key", "number", "least", F.explode(F.array_distinct(parts)).alias("part")).filter("part <> key")
    inner = keys.select(F.col("key").alias("part"), "number", F.col("least").alias("other"))
    held = held.join(inner, ["part", "number"])
    return members.union(held.select(F.least("least", "other"), F.greatest("least", "other")))
