"""Queries about saved pages and galleries, profiles and city files, and what reading saved records again would change."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import config
from ..functions import scalar as S
from ..model import RUBRIC
from ..operators import places, rank, report, resolve, review
from ..sources import listings as landing
from ..sources import parsers
from . import sqltext
from .queries import claims, landed, listing, query, table

# -- reading saved records again ----------------------------------------------------------------------------------------------

_RENT = "CASE WHEN listing_id % 5 = 0 THEN '2150.0' WHEN listing_id % 5 = 2 AND source <> 'ads' THEN '1900.0' WHEN listing_id % 5 = 3 AND source = 'broker' THEN '1500.0' END"
_LAT = "CASE WHEN listing_id % 9 <> 0 THEN '43.5' END"


@query(
    "extraction_previews",
    f""", r AS (SELECT concat(source, ':', source_id) AS id, CASE WHEN listing_id % 10 = 7 THEN '1800.0' ELSE {_RENT} END AS rent, {_LAT} AS lat, CASE WHEN listing_id % 4 = 0 THEN {_RENT} WHEN listing_id % 4 = 1 THEN '1.0' END AS was_rent, {_LAT} AS was_lat, listing_id % 6 = 1 AS seen FROM landed),
c AS (SELECT id, seen, concat_ws(';', CASE WHEN lat IS DISTINCT FROM was_lat THEN 'lat' END, CASE WHEN rent IS DISTINCT FROM was_rent THEN concat('rent:', coalesce(was_rent, '-'), '>', coalesce(rent, '-')) END) AS changes FROM r)
SELECT id AS listing_id, changes, CASE WHEN changes = '' THEN 'unchanged' WHEN seen THEN 'repeat' ELSE 'preview' END AS outcome FROM c""",
    "landed",
)
def extraction_previews(spark, d):
    """Landed records read again, against what is known; of each sixth listing the same preview is pending already."""
    n = landed(spark, d).select(F.concat("source", F.lit(":"), "source_id").alias("listing_id"), F.col("listing_id").alias("n"))
    read = landing.to_listings(landed(spark, d).drop("listing_id", "name", "description"), {"ads": landing.CLASSIFIED, "market": landing.MARKET, "broker": landing.BROKER})
    read = read.select("listing_id", F.lit(1).alias("record_id"), "rent", "lat")
    was = read.join(n, "listing_id").select("listing_id", F.explode(F.create_map(F.lit("rent"), F.when(F.col("n") % 4 == 0, F.col("rent").cast("string")).when(F.col("n") % 4 == 1, "1.0"), F.lit("lat"), F.col("lat").cast("string"))).alias("field", "value"))
    log = n.filter("n % 10 = 7").select("listing_id", F.lit("rent").alias("field"), F.lit("1800").alias("value"), F.lit(1).alias("seq"), F.lit(False).alias("clear"))
    none = n.limit(0).select("listing_id", F.lit("").alias("hash"))
    first = review.previews(read, was, log, none, ["rent", "lat"], "r1")
    pending = first.join(n.filter("n % 6 = 1"), "listing_id").select("listing_id", "hash")
    out = review.previews(read, was, log, pending, ["rent", "lat"], "r1")
    told = F.transform("changes", lambda c: F.when(c.field == "lat", "lat").otherwise(F.concat(c.field, F.lit(":"), F.coalesce(c.before, F.lit("-")), F.lit(">"), F.coalesce(c.after, F.lit("-")))))
    return out.select("listing_id", F.array_join(told, ";").alias("changes"), "outcome")


@query("claim_fingerprints", "SELECT listing_id, sha256(concat('[', string_agg(concat('{\"claim_id\":', claim_id, ',\"field\":\"', field, '\",\"value\":', CAST(value AS VARCHAR), '}'), ',' ORDER BY claim_id), ']')) AS fingerprint FROM claims GROUP BY listing_id", "claims")
def claim_fingerprints(spark, d):
    return resolve.fingerprint(claims(spark, d).select("listing_id", "claim_id", "field", "value"))


# -- profiles and city files ------------------------------------------------------------------------------------------------------

#: The stand-in's rubric as a profile's text.
_PROFILE = {
    "city": "T", "rent_max": 3000, "rent_min": 1600, "beds": {"min": 1, "max": 3}, "baths": {"min": 1}, "floor": {"max": 12}, "area_min": 300, "areas": ["harbour", "midtown", "eastside"], "exclude": ["basement", "furnished_only"],
    "require_laundry": True, "require_parking": True, "lease_months_min": 6, "total_monthly_max": 3200, "available_by": "2024-06-30", "unknown_policy": "review", "unverified_penalty": 4,
    "weights": {k: {"rate": v.rate, "cap": v.cap} if hasattr(v, "rate") else v for k, v in RUBRIC.weights.items()}, "area_key_weights": RUBRIC.area_key_weights,
    "landmark": {"name": "Central station", "lat": 43.65, "lng": -79.38, "within_km": 5, "weight": 7},
}


@query("profile_scores", sqltext.over_score("SELECT listing_id, round(score, 6) AS score FROM s"), "listing")
def profile_scores(spark, d):
    """Listings by a profile as it is saved: JSON, read and checked, then scored."""
    return rank.score(listing(spark, d), config.rubric(json.dumps(_PROFILE))).select("listing_id", F.round("score", 6).alias("score"))


_CITY = {"name": "T", "areas": [{"key": "west", "bbox": [43.6, -79.4, 43.65, -79.38], "keywords": ["w. main", "Mill"]}, {"key": "east", "label": "East", "bbox": [43.6, -79.38, 43.7, -79.35], "keywords": ["QUEEN"]}, {"key": "all", "bbox": [43, -80, 44, -79], "keywords": []}]}


@query(
    "city_areas",
    """SELECT listing_id, CASE WHEN listing_id % 4 IN (0, 2) THEN 'west' WHEN listing_id % 4 = 1 THEN 'east' END AS by_words,
  concat_ws(',', CASE WHEN lat >= 43 AND lat <= 44 THEN 'all' END, CASE WHEN lat >= 43.6 AND lat <= 43.7 AND lng >= -79.38 AND lng <= -79.35 THEN 'east' END, CASE WHEN lat >= 43.6 AND lat <= 43.65 AND lng >= -79.4 AND lng <= -79.38 THEN 'west' END) AS by_box FROM listing""",
    "listing",
)
def city_areas(spark, d):
    """A city file's areas: by keywords in addresses, the first in the file's order, and by their boxes (a table of the file's few areas)."""
    _, boxes, words = config.areas(spark, json.dumps(_CITY))
    order = spark.createDataFrame([(i, a["key"]) for i, a in enumerate(_CITY["areas"])], "ordinal int, key string")
    l = listing(spark, d).select("listing_id", "address", "lat", "lng")
    said = places.substring_area(l, words.join(order, "key"), "address", "listing_id").withColumnRenamed("area_key", "by_words")
    held = l.join(F.broadcast(boxes), (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")) & (F.col("lng") >= F.col("west")) & (F.col("lng") <= F.col("east")))
    held = held.groupBy("listing_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("by_box"))
    return said.join(held, "listing_id", "left").select("listing_id", "by_words", F.coalesce("by_box", F.lit("")).alias("by_box"))


# -- pages ----------------------------------------------------------------------------------------------------------------------------


@query(
    "page_states",
    """SELECT listing_id, CASE listing_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE CASE WHEN listing_id % 7 = 0 THEN 'degraded' ELSE 'ok' END END AS liveness,
  CASE listing_id % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'blocked' ELSE CASE WHEN listing_id % 3 = 1 THEN 'failed' WHEN listing_id % 3 = 2 OR listing_id % 2 = 0 THEN 'partial' ELSE 'complete' END END AS status FROM listing""",
    "listing",
)
def page_states(spark, d):
    """Whether a page is still there, is the listing's own, and states all of it."""
    k = F.col("listing_id")
    html = F.when(k % 5 == 0, "<p>This posting has been deleted by its author.</p>").when(k % 5 == 1, "<p>Are you a robot?</p>").otherwise("<script>captcha</script><p>A flat</p>")
    own = F.concat(F.lit("https://www.x.example/d/"), (k + 100_000).cast("string"), F.lit(".html"))
    canonical = F.when(k % 3 == 0, own).when(k % 3 == 1, F.concat(F.lit("https://x.example.org/d/"), (k + 100_000).cast("string")))
    p = listing(spark, d).select("listing_id", html.alias("html"), canonical.alias("canonical"), own.alias("own"), (k % 2 == 0).alias("cut"), F.when(k % 7 != 0, "t").alias("title"))
    state = landing.detail_status(F.col("html"), F.col("canonical"), F.col("own"), F.lit("x.example"), (k + 100_000).cast("string"), F.col("cut"))
    return p.select("listing_id", parsers.liveness(parsers.outcome(F.col("html")), F.col("title"), F.lit(None).cast("double")).alias("liveness"), state["status"].alias("status"))


@query(
    "plain_texts",
    "SELECT listing_id, concat(title, ' & \"more\" <b> ', listing_id) AS text, CASE listing_id % 4 WHEN 0 THEN 'grocery' WHEN 1 THEN 'gym' WHEN 2 THEN 'transit' END AS kind, CASE listing_id % 3 WHEN 0 THEN 'reviews' WHEN 1 THEN 'news' ELSE 'other' END AS topic FROM listing",
    "listing",
)
def plain_texts(spark, d):
    k = F.col("listing_id")
    html = F.concat(F.lit("<p class=x>"), "title", F.lit("</p>\n<i> &amp; &quot;more&quot; &lt;b&gt;&nbsp;</i><br/>"), k.cast("string"))
    tag = F.when(k % 4 == 0, "Supermarket").when(k % 4 == 1, "fitness_centre").when(k % 4 == 2, "subway station").otherwise("well")
    about = F.when(k % 3 == 0, "A Review").when(k % 3 == 1, "Police said")
    return listing(spark, d).select("listing_id", parsers.plain_text(html).alias("text"), S.place_kind(tag).alias("kind"), report.topic(about, F.lit("x")).alias("topic"))


# -- galleries and floor plans -----------------------------------------------------------------------------------------------------------


@query(
    "floor_plans",
    """SELECT page_id, m AS measurements, CASE page_id % 3 WHEN 0 THEN 'bedroom,kitchen' WHEN 1 THEN 'kitchen' ELSE '' END AS rooms, page_id % 5 = 0 OR m >= 2 OR (m = 1 AND page_id % 3 = 0) AS is_plan FROM (SELECT p_partkey AS page_id, CAST(p_partkey % 4 AS INT) AS m FROM part) x""",
)
def floor_plans(spark, d):
    """Whether what was read off an image is a floor plan's: a label, measurements, rooms."""
    k = F.col("p_partkey")
    sizes = F.array_join(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.when(i > 0, F.lit("12' 6\" x 10'")).otherwise("text")), " ; ")
    rooms = F.when(k % 3 == 0, " Bedroom KITCHEN bedroom").when(k % 3 == 1, " kitchen").otherwise("")
    ocr = F.concat(sizes, rooms, F.when(k % 5 == 0, " FLOOR  PLAN").otherwise(""))
    return report.floor_plan(table(spark, d, "part").select(k.alias("page_id"), ocr.alias("ocr"))).select("page_id", "measurements", "rooms", "is_plan")


@query(
    "gallery_states",
    """SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 15 = 0 THEN 'empty' ELSE CASE p_partkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'not_candidate' WHEN 2 THEN 'unavailable' ELSE 'error' END END AS status,
  CAST(p_partkey % 15 AS INT) AS gallery_count, CAST(least(p_partkey % 15, 12) AS BIGINT) AS analyzed, p_partkey % 15 > 12 AS truncated FROM part""",
)
def gallery_states(spark, d):
    """Galleries by what their first photos are."""
    k = F.col("listing_id")
    url = lambda i: F.concat(F.lit("https://p.example/"), k.cast("string"), F.lit("/"), i.cast("string"))
    some = F.when(k % 15 > 0, F.transform(F.sequence(F.lit(1), (k % 15).cast("int")), url)).otherwise(F.array().cast("array<string>"))
    g = table(spark, d, "part").select(F.col("p_partkey").alias("listing_id")).withColumn("photo_urls", some)
    kinds = F.when((k % 4 == 0) & (F.col("at") == 0), "candidate").when((k % 4 <= 1) & (F.col("at") <= 1), "not_candidate").when((k % 4 <= 2) & (F.col("at") <= 2), "unavailable").otherwise("error")
    kinds = F.when((k % 4 == 1) & (F.col("at") == 0), "not_candidate").otherwise(kinds)
    return report.gallery_status(g, report.scanned(g).withColumn("status", kinds)).select("listing_id", "status", "gallery_count", "analyzed", "truncated")


@query(
    "floor_plan_states",
    """WITH a AS (SELECT user_id AS listing_id, event_id AS n, event_type <> 'error' AS usable, concat('g', event_id % 3) AS gallery_hash, event_id % 5 AS p FROM events),
l AS (SELECT listing_id, arg_max({'n': n, 'h': gallery_hash, 'p': p}, CASE WHEN usable THEN n + 1000000000 ELSE n END) AS x, max(n) AS latest FROM a GROUP BY listing_id)
SELECT listing_id, x.h AS gallery_hash, latest > x.n AS newer_outcome, CASE WHEN listing_id % 3 <> 0 THEN x.h <> 'g1' END AS gallery_changed, CASE WHEN listing_id % 3 <> 0 THEN listing_id % 3 = 1 AND x.p <> 2 END AS selection_changed FROM l""",
)
def floor_plan_states(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("usable"), F.concat(F.lit("g"), F.col("event_id") % 3).alias("gallery_hash"), F.array(F.concat(F.lit("p"), F.col("event_id") % 5)).alias("hashes"))
    k = F.col("listing_id")
    decided = a.select("listing_id").distinct().filter(k % 3 != 0).select("listing_id", F.lit("yes").alias("decision"), F.lit("g1").alias("gallery_hash"), F.when(k % 3 == 1, "p2").alias("selected"))
    return report.floor_plan_state(a, decided).select("listing_id", "gallery_hash", "newer_outcome", "gallery_changed", "selection_changed")
