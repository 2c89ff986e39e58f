"""Scalar functions: distance, signatures of entities, addresses, URLs, times, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directions by their letters (in signatures, and in keys for comparing), words that a signature leaves out,
#: street types that end a key, what separates words (in signatures, and in keys).
DIRECTIONALS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
KEY_DIRECTIONALS = {"n": "north", "s": "south", "e": "east", "w": "west"}
STREET_TYPES = ["st", "street", "ave", "avenue", "rd", "road", "dr", "drive", "blvd", "boulevard", "way", "lane", "ln", "court", "ct"]
PLACE_WORDS = ["vancouver", "bc", "ca", "canada"]
STREET_ENDINGS = ["street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "drive", "dr", "lane", "ln", "crescent", "cres", "court", "ct", "place", "pl", "highway", "hwy", "terrace", "ter", "way"]
SIGNATURE_MARKS, KEY_MARKS = r""" ,.;:/\|()[]{}!?#+&*'" """, r""" .,;:()'"/#& """
POSTAL = r"^(\p{L}\d\p{L}\d\p{L}\d|\p{L}\d\p{L}|\d\p{L}\d)$"
EARTH_KM = 6371.0
PRICE_STEP = 25


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column, marks: str) -> Column:
    """Lower-case words between white space and these marks; hyphens and letters of any alphabet stay."""
    spaced = F.translate(F.lower(text), marks.strip(), " " * len(marks.strip()))
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-case words of letters and digits of any alphabet."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def directions(found: Column, names: dict[str, str]) -> Column:
    full = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(full, t), t))


def signature_tokens(text: Column) -> Column:
    keep = directions(tokens(text, SIGNATURE_MARKS), DIRECTIONALS)
    return F.filter(keep, lambda t: ~t.isin(*STREET_TYPES, *PLACE_WORDS) & ~F.replace(t, F.lit("-"), F.lit("")).rlike(POSTAL))


def lenient_int(value: Column) -> Column:
    """The whole part of a number or of a text that is one; 0 for anything else."""
    n = F.try_cast(value.cast("string"), "double") if hasattr(F, "try_cast") else value.cast("string").try_cast("double")
    return F.coalesce(F.when(F.abs(n) < 9e18, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")), F.lit(0).cast("long"))


def price_bucket(price: Column) -> Column:
    """To the nearest step; what is no number is 0."""
    return (F.bround(lenient_int(price) / PRICE_STEP) * PRICE_STEP).cast("long")


def signature(title: Column, price: Column, address: Column) -> Column:
    """Six tokens of the address, or of the title where there is no address, or else `listing`, and the price's bucket."""
    source = F.when(F.trim(address) != "", address).otherwise(title)
    said = F.nullif(F.array_join(F.slice(signature_tokens(source), 1, 6), " "), F.lit(""))
    return F.concat(F.coalesce(said, F.lit("listing")), F.lit("|"), price_bucket(price))


def match_key(address: Column) -> Column:
    """For comparing addresses: directions in full, no street type at the end; empty for none."""
    found = directions(tokens(address, KEY_MARKS), KEY_DIRECTIONALS)
    ended = F.try_element_at(found, F.lit(-1)).isin(*STREET_ENDINGS)
    return F.coalesce(F.array_join(F.when(ended, F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found), " "), F.lit(""))


def canonical_address(*parts: Column) -> Column:
    """Parts squeezed, without stray marks at their ends, joined; empty ones and those that say that nothing is known go."""
    clean = [F.regexp_replace(F.regexp_replace(F.trim(p), r"\s+", " "), r"^[,.;:]+|[,.;:]+$", "") for p in parts]
    return F.concat_ws(", ", *(F.when(~F.lower(p).isin("", "unknown", "n/a", "na", "-"), p) for p in clean))


def slug_text(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+([^?#]*)", 1)
    return F.trim(F.regexp_replace(F.lower(F.try_url_decode(path)), r"[/_-]+", " "))


def content_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def first_number(text: Column) -> Column:
    """The first number in a text, thousands apart or not."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    return F.nullif(found, F.lit("")).cast("double")


def lenient_number(text: Column) -> Column:
    """The number in a text that has exactly one."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).cast("double"))


def feed_time(text: Column) -> Column:
    """RFC 2822 or ISO 8601, else the epoch."""
    iso = F.try_to_timestamp(text)
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-"), iso), mail, F.lit("1970-01-01 00:00:00").cast("timestamp"))


def published_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "M/d/yyyy"))


def relative_time(seconds: Column) -> Column:
    """Seconds as s, m, h, d, months of 30 days or years of 365."""
    out = F
    for most, unit, name in ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"), (30 * 86400, 86400, "d"), (365 * 86400, 30 * 86400, "mo")):
        out = out.when(seconds < most, F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{name} ago")))
    return out.otherwise(F.concat(F.floor(seconds / (365 * 86400)).cast("string"), F.lit("y ago")))


def bounded_text(text: Column, most: int) -> Column:
    """text (cut so that its UTF-8 has `most` bytes at most, never within a character) and whether it was cut."""
    cut = F.octet_length(text) > most
    left = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    whole = F.regexp_replace(left, "\ufffd+$", "")
    return F.struct(F.when(cut, whole).otherwise(text).alias("text"), F.coalesce(cut, F.lit(False)).alias("cut"))


def money_text(n: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(n, 0))


def score_badge(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 50, "mid").otherwise("low")


def gallery_fingerprint(urls: Column) -> Column:
    return F.sha2(F.to_json(F.array_distinct(F.transform(urls, lambda u: F.substring_index(u, "?", 1)))), 256)


#: Kinds of places by their tags, in this order.
PLACE_KINDS = [("grocery", "supermarket"), ("grocery", "grocery"), ("gym", "fitness"), ("transit", "station"), ("park", "park"), ("school", "school"), ("cafe", "cafe")]


def place_kind(tag: Column) -> Column:
    out = F
    for kind, word in PLACE_KINDS:
        out = out.when(F.lower(tag).contains(word), F.lit(kind))
    return out
