"""What users add by hand: listings, and how far they have come with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a listing added by hand, the longest texts, and the stages of a hunt.
TEXTS = ["url", "title", "address", "description", "parking", "furnishing", "available_date"]
AMOUNTS = ["rent", "beds", "baths", "area", "floor", "lease_months", "total_monthly"]
MOST_TITLE, MOST_DESCRIPTION, ID_DIGITS = 300, 10_000, 24
STAGES = ["spotted", "shortlisted", "contacted", "replied", "viewing_booked", "viewed", "applied", "rejected", "removed"]
_URL = r"(?i)^https?://([^/?#@\s]+@)?([^/?#@:\s]+)(:\d+)?([/?#]|$)"


def _faults() -> dict[str, Column]:
    """By field, whether what was entered can't be taken."""
    url = F.trim(F.coalesce("url", F.lit("")))
    iso = F.try_to_date("available_date", "yyyy-MM-dd")
    out = {
        "url": ~url.rlike(_URL) | (F.regexp_extract(url, _URL, 1) != ""),
        "title": (F.coalesce(F.length("title"), F.lit(0)) < 1) | (F.length("title") > MOST_TITLE),
        "description": F.length("description") > MOST_DESCRIPTION,
        "available_date": (F.coalesce("available_date", F.lit("")) != "") & (iso.isNull() | ~F.col("available_date").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    }
    return out | {a: (F.col(a) < 0) | F.isnan(F.col(a).cast("double")) | (F.abs(F.col(a).cast("double")) == float("inf")) for a in AMOUNTS}


def checked(entries: DataFrame) -> DataFrame:
    """entries with errors: the fields that can't be taken, in their order (null counts as not entered, but for url and title)."""
    faults = _faults()
    named = [F.when(F.coalesce(faults[f], F.lit(False)), F.lit(f)) for f in TEXTS + AMOUNTS if f in faults]
    return entries.withColumn("errors", F.array_compact(F.array(*named)))


def records(entries: DataFrame, at: str) -> DataFrame:
    """Source records of the entries without errors, which checked() has seen: an address is one listing, however often it is added."""
    url = F.trim("url")
    payload = F.to_json(F.struct(url.alias("url"), *(F.coalesce(t, F.lit("")).alias(t) for t in TEXTS[1:]), *AMOUNTS), {"ignoreNullFields": "false"})
    key = F.substring(F.sha2(url, 256), 1, ID_DIGITS)
    good = entries.filter(F.size("errors") == 0).select(F.lit("manual").alias("source"), key.alias("source_id"), F.concat(F.lit("manual:"), key).alias("listing_id"), url.alias("url"), payload.alias("payload"))
    return good.withColumns({"content_hash": F.sha2("payload", 256), "fetched_at": F.lit(at).cast("timestamp")})


def _instant(text: Column, zone: Column) -> Column:
    """A time in ISO 8601: with its own offset, or as clocks in zone show it. Null where it is none."""
    own = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    return F.when(own, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.trim(text), F.lit("Z"))), zone))


def progress_checked(updates: DataFrame, listings: DataFrame) -> DataFrame:
    """updates (listing_id, seq, stage, viewing_at: text or empty, zone) with viewing (a timestamp) and outcome: bad_stage, no_listing,
    bad_time, no_time (a viewing is booked for some time), or ok."""
    asked = F.coalesce(F.trim("viewing_at"), F.lit(""))
    known = listings.select("listing_id", F.lit(True).alias("known")).distinct()
    u = updates.join(known, "listing_id", "left").withColumn("viewing", F.when(asked != "", _instant(asked, F.col("zone"))))
    outcome = (
        F.when(~F.coalesce(F.col("stage").isin(STAGES), F.lit(False)), "bad_stage")
        .when(F.col("known").isNull(), "no_listing")
        .when((asked != "") & F.col("viewing").isNull(), "bad_time")
        .when((F.col("stage") == "viewing_booked") & (asked == ""), "no_time")
        .otherwise("ok")
    )
    return u.withColumn("outcome", outcome).drop("known")


def progress(judged: DataFrame) -> DataFrame:
    """listing_id, stage, viewing: what the last update that was taken says of each listing."""
    g = judged.filter("outcome = 'ok'").groupBy("listing_id").agg(F.max_by(F.struct("stage", "viewing"), "seq").alias("x"))
    return g.select("listing_id", "x.stage", "x.viewing")
