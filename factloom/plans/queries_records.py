"""Queries about records over time: canonical ids, candidates, what users add, runs, profiles and their revisions, feedback, chains of enrichers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import canonical, manual, review
from ..sources import sinks
from . import chain
from .queries import AS_OF, listing, query, scores, table

# -- which records are one unit ---------------------------------------------------------------------------------------------

_UNITS = """SELECT p_partkey AS at, concat('n', p_partkey) AS listing_id, concat('src', p_partkey % 4) AS source, concat('k', p_partkey % 701) AS source_id, concat('sig', p_partkey * 31 % 211) AS signature,
  CASE WHEN p_partkey % 5 < 2 THEN concat('m', p_partkey * 17 % 97) END AS fingerprint, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('day ', p_partkey % 3) END AS posted, p_partkey % 11 AS first_seen FROM part"""


def units(spark, d):
    return spark.sql(_UNITS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


@query("resolved_ids")
def resolved_ids(spark, d):
    """Every record's canonical id, a tenth of the records being known; a test holds it against the loop over the same table."""
    u = units(spark, d)
    return canonical.canonical_ids(u.filter("at % 10 <> 3"), u.filter("at % 10 = 3"))


_ADS = """SELECT p_partkey AS record_id, concat('l', CAST(floor(p_partkey / 2) AS BIGINT)) AS listing_id, p_partkey * 7 % 97 AS one, p_partkey * 11 % 89 AS two, CASE WHEN p_partkey % 9 <> 0 THEN 43 + p_partkey % 13 / CAST(100 AS DOUBLE) END AS lat, CAST(-79 AS DOUBLE) AS lng,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(1000 + p_partkey % 17 * 50 AS DOUBLE) END AS price, CAST(p_size % 4 AS DOUBLE) AS beds, CAST(1 AS DOUBLE) AS baths FROM part"""
_SAME = "CASE WHEN {0} THEN 1 ELSE 0 END"


@query(
    "unit_candidates",
    f"""WITH a AS ({_ADS}), p AS (SELECT t.record_id AS target, b.record_id, b.listing_id, b.one = t.one OR b.one = t.two + 1000 OR b.two = t.two AS photo, coalesce(b.lat = t.lat AND b.lng = t.lng, false) AS point, coalesce(b.price = t.price AND b.beds = t.beds AND b.baths = t.baths, false) AS facts
  FROM a t JOIN a b ON t.record_id % 100 = 0 AND b.record_id <> t.record_id)
SELECT target, string_agg(concat(listing_id, ':', concat_ws('+', CASE WHEN photo THEN 'photo' END, CASE WHEN point THEN 'point' END, CASE WHEN facts THEN 'facts' END)), ',' ORDER BY photo::INT + point::INT + facts::INT DESC, listing_id, record_id) AS ordered
FROM p WHERE photo OR (point AND facts) GROUP BY target""",
)
def unit_candidates(spark, d):
    """For each hundredth ad all others that may be of the same unit, in order; photos are compared without their parameters."""
    ads = spark.sql(_ADS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    shot = lambda c, plus: F.concat(F.lit("https://p.example/"), (F.col(c) + plus).cast("string"), F.lit("?w="), F.col("record_id").cast("string"))
    ads = ads.withColumn("photos", F.array(shot("one", 0), shot("two", 1000)))
    return canonical.ordered_candidates(ads.filter("record_id % 100 = 0"), ads)


# -- what users add -----------------------------------------------------------------------------------------------------------

_ENTRIES = """SELECT c_custkey AS n, CASE c_custkey % 6 WHEN 0 THEN 'ftp://x.example/1' WHEN 1 THEN concat('https://me@x.example/', c_custkey) WHEN 2 THEN ' https://x.example/same ' WHEN 3 THEN concat('http://x.example:80/', c_custkey) ELSE concat('https://x.example/', c_custkey) END AS url,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS title, '' AS address, CASE WHEN c_custkey % 31 = 0 THEN repeat('x', 10001) ELSE 'd' END AS description, CAST(NULL AS STRING) AS parking, '' AS furnishing,
  CASE c_custkey % 8 WHEN 0 THEN '2024-02-30' WHEN 1 THEN 'soon' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE '2024-02-29' END AS available_date,
  CASE WHEN c_custkey % 13 = 0 THEN CAST(-1 AS DOUBLE) WHEN c_custkey % 13 < 5 THEN CAST(1500 AS DOUBLE) END AS rent, CAST(2 AS DOUBLE) AS beds, CAST(NULL AS DOUBLE) AS baths, CAST(600 AS DOUBLE) AS area, CAST(c_custkey % 17 - 1 AS INT) AS floor, CAST(NULL AS DOUBLE) AS lease_months, CAST(NULL AS DOUBLE) AS total_monthly FROM customer"""


@query(
    "manual_listings",
    f"""WITH e AS ({_ENTRIES.replace("STRING", "VARCHAR")}), f AS (SELECT *, concat_ws(',', CASE WHEN n % 6 < 2 THEN 'url' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN length(description) > 10000 THEN 'description' END, CASE WHEN n % 8 < 2 THEN 'available_date' END, CASE WHEN rent < 0 THEN 'rent' END, CASE WHEN floor < 0 THEN 'floor' END) AS errors FROM e)
SELECT n, errors, CASE WHEN errors = '' THEN concat('manual:', left(sha256(trim(url)), 24)) END AS listing_id FROM f""",
)
def manual_listings(spark, d):
    """Entries with what is wrong about them, and the listings of those that can be taken."""
    e = manual.checked(spark.sql(_ENTRIES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer")))
    made = manual.records(e, AS_OF).select(F.col("url").alias("of"), "listing_id").distinct()
    out = e.withColumn("of", F.when(F.size("errors") == 0, F.trim("url"))).join(made, "of", "left")
    return out.select("n", F.array_join("errors", ",").alias("errors"), "listing_id")


_UPDATES = """SELECT user_id AS listing_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'viewing_booked' WHEN 1 THEN 'contacted' WHEN 2 THEN 'lost' WHEN 3 THEN 'applied' ELSE 'viewed' END AS stage,
  CASE event_id % 3 WHEN 0 THEN '2024-03-09T10:30:00' WHEN 1 THEN '2024-07-01T10:30:00+02:00' ELSE CASE WHEN event_id % 2 = 0 THEN '' ELSE 'noon' END END AS viewing_at, CASE WHEN event_id % 2 = 0 THEN 'America/Toronto' ELSE 'America/Vancouver' END AS zone FROM events"""


@query(
    "hunt_progress",
    f"""WITH u AS ({_UPDATES}), k AS (SELECT *, CASE WHEN stage = 'lost' THEN 'bad_stage' WHEN listing_id % 10 = 0 THEN 'no_listing' WHEN viewing_at = 'noon' THEN 'bad_time' WHEN stage = 'viewing_booked' AND viewing_at = '' THEN 'no_time' ELSE 'ok' END AS outcome,
  CASE seq % 3 WHEN 0 THEN CASE WHEN zone = 'America/Toronto' THEN TIMESTAMP '2024-03-09 15:30:00' ELSE TIMESTAMP '2024-03-09 18:30:00' END WHEN 1 THEN TIMESTAMP '2024-07-01 08:30:00' END AS viewing FROM u)
SELECT listing_id, refused, x.s AS stage, x.v AS viewing FROM (SELECT listing_id, count(*) FILTER (WHERE outcome <> 'ok') AS refused, arg_max({{'s': stage, 'v': viewing}}, seq) FILTER (WHERE outcome = 'ok') AS x FROM k GROUP BY listing_id) t""",
)
def hunt_progress(spark, d):
    """How far each listing has come, by the updates that could be taken; viewings are times of the listing's own clocks."""
    u = spark.sql(_UPDATES.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    judged = manual.progress_checked(u, table(spark, d, "events").filter("user_id % 10 <> 0").select(F.col("user_id").alias("listing_id")))
    refused = judged.groupBy("listing_id").agg(F.count_if(F.col("outcome") != "ok").alias("refused"))
    return refused.join(manual.progress(judged), "listing_id", "left").select("listing_id", "refused", "stage", "viewing")


# -- runs, profiles, feedback --------------------------------------------------------------------------------------------------


@query(
    "run_rows",
    "SELECT user_id AS run, min(ts) FILTER (WHERE event_id % 3 = 0) AS started, max(ts) FILTER (WHERE event_id % 3 <> 0) AS finished, arg_max(props, ts) FILTER (WHERE event_id % 3 <> 0) AS counts FROM events GROUP BY user_id",
)
def run_rows(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_id") % 3 == 0, "start").otherwise("finish").alias("kind"), F.col("ts").alias("at"), F.col("props").alias("counts"))
    return review.run_rows(e).select("run", "started", "finished", "counts")


_PROFILE = "concat('{\"rent_max\":', c_custkey % 5, '}')"


@query(
    "profile_writes",
    f"""WITH c AS (SELECT c_custkey AS profile_id, sha256({_PROFILE}) AS now, CASE WHEN c_custkey % 4 = 0 THEN 'v' ELSE 't' END AS city FROM customer),
q AS (SELECT o_orderkey AS seq, o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 10000000 ELSE 0 END AS profile_id, concat('{{"rent_max":', o_orderkey, '}}') AS profile, sha256(concat('{{"rent_max":', CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey % 5 END, '}}')) AS expected FROM orders),
f AS (SELECT q.*, now, city, min(CASE WHEN now = expected AND city = 't' THEN seq END) OVER (PARTITION BY q.profile_id) AS first FROM q LEFT JOIN c USING (profile_id))
SELECT profile_id, seq, CASE WHEN now IS NULL THEN 'unknown' WHEN now <> expected THEN 'conflict' WHEN city <> 't' THEN 'other_city' WHEN seq > first THEN 'conflict' ELSE 'written' END AS outcome, CASE WHEN now = expected AND city = 't' AND seq = first THEN sha256(profile) END AS revision FROM f""",
)
def profile_writes(spark, d):
    """Of the requests that know a profile's current revision, the first is written."""
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.expr(_PROFILE).alias("profile"), F.when(F.col("c_custkey") % 4 == 0, "v").otherwise("t").alias("city"))
    body = lambda n: F.concat(F.lit('{"rent_max":'), n, F.lit("}"))
    o = table(spark, d, "orders")
    who = F.col("o_custkey") + F.when(F.col("o_orderkey") % 17 == 0, 10_000_000).otherwise(0)
    asked = o.select(who.alias("profile_id"), F.sha2(body(F.when(F.col("o_orderkey") % 3 == 0, 9).otherwise(F.col("o_custkey") % 5)), 256).alias("expected"), body(F.col("o_orderkey")).alias("profile"), F.lit("t").alias("city"), F.col("o_orderkey").alias("seq"))
    return review.profile_writes(current, asked)


@query(
    "source_feedback",
    "SELECT user_id AS subject, CAST(event_id % 13 AS VARCHAR) AS url, arg_max(event_type, event_id) AS verdict FROM events WHERE event_id % 4 = user_id % 4 GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'view'",
)
def source_feedback(spark, d):
    """The latest verdict on each source, given on the current report and not taken back (here: by a view)."""
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), (F.col("event_id") % 13).cast("string").alias("url"), (F.col("event_id") % 4).cast("string").alias("key"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("verdict"), F.col("event_id").alias("seq"))
    current = e.select("subject", (F.col("subject") % 4).cast("string").alias("key")).distinct()
    return review.feedback(e, current)


@query(
    "limitations",
    """SELECT listing_id, concat_ws('; ', CASE WHEN listing_id % 5 = 0 THEN 'detail retrieval failed' END, CASE listing_id % 4 WHEN 0 THEN 'no description' WHEN 1 THEN 'description truncated' WHEN 2 THEN 'description may be truncated' END,
  CASE listing_id % 3 WHEN 0 THEN 'no photos' WHEN 1 THEN 'gallery truncated' END) AS cannot_tell FROM listing""",
    "listing",
)
def limitations(spark, d):
    k = F.col("listing_id")
    saved = F.struct(
        F.when(k % 5 == 0, "timeout").otherwise("").alias("detail_error"),
        F.when(k % 4 == 0, "  ").when(k % 4 == 2, F.repeat(F.lit("x"), 2000)).otherwise("said").alias("description"),
        (k % 4 == 1).alias("description_truncated"),
        F.when(k % 3 > 0, F.array(F.lit("https://p"))).alias("photos"),
        (k % 3 == 1).alias("photos_truncated"),
    )
    return listing(spark, d).select("listing_id", F.array_join(review.limitations(saved), "; ").alias("cannot_tell"))


@query(
    "new_listing_notices",
    "SELECT listing_id, max(score) AS score FROM scores WHERE listing_id % 7 = 3 GROUP BY listing_id ORDER BY max(score) DESC, listing_id LIMIT 10",
    "scores",
)
def new_listing_notices(spark, d):
    """The ten best of the new listings: a report of fixed length."""
    s = scores(spark, d)
    return sinks.notices(s, s.filter("listing_id % 7 = 3").select("listing_id"))


@query(
    "calendar_events",
    "SELECT listing_id, md5(concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'BEGIN:VEVENT', concat('UID:', listing_id), 'DTSTART:20240115T' || lpad(CAST(listing_id % 20 AS VARCHAR), 2, '0') || '0000Z', 'DTEND:20240115T' || lpad(CAST(listing_id % 20 + 1 AS VARCHAR), 2, '0') || '0000Z', concat('SUMMARY:', title), 'END:VEVENT', 'END:VCALENDAR')) AS ics FROM listing",
    "listing",
)
def calendar_events(spark, d):
    start = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=F.col("listing_id") % 20)
    return listing(spark, d).select("listing_id", F.md5(sinks.calendar_event(F.col("listing_id").cast("string"), F.col("title"), start)).alias("ics"))


# -- chains of enrichers ------------------------------------------------------------------------------------------------------

#: What stands: beds of a third of the rows, by a user, by a sure source, or by one that is less so.
_STATED = "SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 5 AS DOUBLE) END AS beds, CASE p_partkey % 9 WHEN 0 THEN 'user' WHEN 3 THEN 'source_field' WHEN 6 THEN 'text_rule' END AS beds_origin, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.9e0 ELSE 0.3e0 END END AS beds_confidence, CAST(NULL AS STRING) AS note, CAST(NULL AS STRING) AS note_origin, CAST(NULL AS DOUBLE) AS note_confidence FROM part"


@query(
    "enricher_chain",
    """WITH s AS (SELECT p_partkey AS listing_id, p_size, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 5 AS DOUBLE) END AS held, CASE p_partkey % 9 WHEN 0 THEN 'user' WHEN 3 THEN 'source_field' WHEN 6 THEN 'text_rule' END AS origin, p_partkey % 2 = 0 AS sure FROM part),
b AS (SELECT listing_id, CASE WHEN (held IS NULL OR (origin = 'text_rule' AND NOT sure)) AND listing_id % 4 <> 1 THEN CAST(listing_id % 6 AS DOUBLE) ELSE held END AS beds, CASE WHEN (held IS NULL OR (origin = 'text_rule' AND NOT sure)) AND listing_id % 4 <> 1 THEN 'text_rule' ELSE origin END AS beds_origin FROM s)
SELECT listing_id, beds, beds_origin, CASE WHEN beds IS NOT NULL THEN concat(CAST(beds AS INT), ' beds') END AS note FROM b""",
)
def enricher_chain(spark, d):
    """Two enrichers, given the wrong way round: notes need beds; beds are read where nothing better stands, of three rows in four."""
    rows = spark.sql(_STATED.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    claim = lambda df, field, value: df.select("listing_id", F.lit(field).alias("field"), value.alias("value"), F.lit(0.6).alias("confidence"))
    beds = chain.Enricher("beds", ("beds",), lambda df: claim(df.filter("listing_id % 4 <> 1"), "beds", (F.col("listing_id") % 6).cast("string")))
    note = chain.Enricher("note", ("note",), lambda df: claim(df, "note", F.concat(F.col("beds").cast("int").cast("string"), F.lit(" beds"))), requires=("beds",))
    return chain.run_chain(rows, [note, beds]).select("listing_id", "beds", "beds_origin", "note")


@query(
    "published_and_ages",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2024-03-05' END AS published, CASE WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') WHEN s < 2592000 THEN concat(s // 86400, 'd ago')
  WHEN s < 31536000 THEN concat(s // 2592000, 'mo ago') ELSE concat(s // 31536000, 'y ago') END AS age FROM (SELECT event_id, event_id * event_id * 7 AS s FROM events) x""",
)
def published_and_ages(spark, d):
    k = F.col("event_id")
    said = F.when(k % 4 == 0, "2024-03-05").when(k % 4 == 1, "3/5/2024").when(k % 4 == 2, "2024-13-05").otherwise("")
    return table(spark, d, "events").select("event_id", S.published_date(said).alias("published"), S.relative_time(k * k * 7).alias("age"))
