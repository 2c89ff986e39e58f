"""The queries over the driver's tables, each with the same in ANSI SQL for the oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from ..model import PRECEDENCE, RUBRIC, Range, Rubric
from ..operators import browse, criteria, display, entity, health, rank, report, resolve, review
from ..sources import listings as landing
from ..sources import parsers, sinks
from ..streaming import incremental, leases
from . import sqltext
from .views import REPORTED, table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return f

    return put


def _of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: view(spark, d, name)


listing, claims, records, runs, actions, scores, landed, fetched = map(_of, ("listing", "claims", "records", "runs", "actions", "scores", "landed", "fetched"))
AS_OF = "2024-01-15 00:00:00"
OTHER = replace(RUBRIC, rent_max=2600.0, beds=Range(min=2.0), areas=(), require_parking=False)

# -- claims and facts -------------------------------------------------------------------------------------------------

_PREC = "CASE origin " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRECEDENCE.items()) + " ELSE 0 END"
_HELD = f"row_number() OVER (PARTITION BY listing_id, field ORDER BY {_PREC} DESC, observed_at DESC, claim_id DESC)"


@query("fact_resolution", f"SELECT claim_id, listing_id, field, origin, value FROM (SELECT *, {_HELD} AS r FROM claims) t WHERE r = 1", "claims")
def fact_resolution(spark, d):
    return resolve.resolve(claims(spark, d)).select("claim_id", "listing_id", "field", "origin", "value")


@query(
    "review_scoped_facts",
    f"""SELECT claim_id, listing_id, field, origin, value FROM (SELECT *, {_HELD} AS r FROM claims c
  WHERE CASE WHEN EXISTS (SELECT 1 FROM claims x WHERE x.listing_id = c.listing_id AND x.reviewed) THEN reviewed OR origin IN ('user', 'geo_provider') ELSE TRUE END) t WHERE r = 1""",
    "claims",
)
def review_scoped_facts(spark, d):
    return resolve.resolve_reviewed(claims(spark, d)).select("claim_id", "listing_id", "field", "origin", "value")


@query("user_corrections", "SELECT claim_id, listing_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY observed_at DESC, claim_id DESC) AS r FROM claims WHERE origin = 'user') t WHERE r = 1", "claims")
def user_corrections(spark, d):
    return resolve.resolve(claims(spark, d).filter("origin = 'user'")).select("claim_id", "listing_id", "field", "value")


@query("change_counts", "SELECT listing_id, count(*) AS corrections, count(DISTINCT field) AS fields FROM claims WHERE origin = 'user' GROUP BY listing_id", "claims")
def change_counts(spark, d):
    return resolve.change_counts(claims(spark, d))


@query("retention_newest_nine", "SELECT claim_id, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, claim_id DESC) AS r FROM claims) t WHERE r <= 9", "claims")
def retention_newest_nine(spark, d):
    return resolve.keep_newest(claims(spark, d), "listing_id", 9, F.desc("observed_at"), F.desc("claim_id")).select("claim_id", "listing_id")


_FIELDS = ["rent", "beds", "baths", "area", "floor"]


@query("unpivot_facts", " UNION ALL ".join(f"SELECT listing_id, '{c}' AS field, CAST({c} AS DOUBLE) AS value FROM listing WHERE {c} IS NOT NULL" for c in _FIELDS), "listing")
def unpivot_facts(spark, d):
    return resolve.unpivot(listing(spark, d), _FIELDS).withColumn("value", F.col("value").cast("double"))


@query(
    "pivot_facts",
    f"SELECT listing_id, {', '.join(f'''max(CASE WHEN field = 'f{i}' THEN value END) AS f{i}''' for i in range(4))} FROM (SELECT *, {_HELD} AS r FROM claims) t WHERE r = 1 GROUP BY listing_id",
    "claims",
)
def pivot_facts(spark, d):
    return resolve.pivot(resolve.resolve(claims(spark, d)).select("listing_id", "field", "value"), [f"f{i}" for i in range(4)])


@query(
    "overlay_facts",
    f"""SELECT p.listing_id, coalesce(f.f0, p.rent) AS rent, p.beds FROM listing p LEFT JOIN (SELECT listing_id, max(CASE WHEN field = 'f0' THEN value END) AS f0
  FROM (SELECT *, {_HELD} AS r FROM claims) t WHERE r = 1 GROUP BY listing_id) f ON f.listing_id = p.listing_id""",
    "listing",
    "claims",
)
def overlay_facts(spark, d):
    facts = resolve.resolve(claims(spark, d)).filter("field = 'f0'").select("listing_id", F.lit("rent").alias("field"), F.col("value").cast("string"))
    return resolve.overlay(listing(spark, d).select("listing_id", "rent", "beds"), facts, ["rent"]).withColumn("rent", F.col("rent").cast("double"))


@query(
    "fact_diff",
    """SELECT coalesce(a.listing_id, b.listing_id) AS listing_id, a.price AS before, b.price AS after
FROM (SELECT listing_id, max(price) AS price FROM records WHERE status <> 'F' GROUP BY listing_id) a FULL JOIN (SELECT listing_id, max(price) AS price FROM records WHERE status <> 'P' GROUP BY listing_id) b
  ON a.listing_id = b.listing_id WHERE a.price IS DISTINCT FROM b.price""",
    "records",
)
def fact_diff(spark, d):
    one = lambda s: records(spark, d).filter(F.col("status") != s).groupBy("listing_id").agg(F.max("price").alias("value")).withColumn("field", F.lit("price"))
    return resolve.fact_diff(one("F"), one("P")).drop("field")


@query(
    "best_claim_array",
    f"SELECT listing_id, value AS best FROM (SELECT listing_id, value, row_number() OVER (PARTITION BY listing_id ORDER BY {_PREC} DESC, claim_id) AS r FROM claims WHERE field = 'f1') t WHERE r = 1",
    "claims",
)
def best_claim_array(spark, d):
    return resolve.best_by_precedence(claims(spark, d).filter("field = 'f1'"), "listing_id").select("listing_id", F.col("value").alias("best"))


@query(
    "merge_fields",
    f"""SELECT a.listing_id, a.field, CASE WHEN b.value IS NULL THEN a.value WHEN {_PREC.replace('origin', 'b.origin')} >= {_PREC.replace('origin', 'a.origin')} THEN b.value ELSE a.value END AS value
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY claim_id) AS r FROM claims) x WHERE r = 1) a
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY claim_id) AS r FROM claims) x WHERE r = 2) b ON a.listing_id = b.listing_id AND a.field = b.field""",
    "claims",
)
def merge_fields(spark, d):
    c = claims(spark, d).withColumn("r", F.row_number().over(resolve.Window.partitionBy("listing_id", "field").orderBy("claim_id"))).filter("r <= 2")
    at = lambda k, x: F.max(F.when(F.col("r") == k, F.col(x))).alias(f"{x}{k}")
    g = c.groupBy("listing_id", "field").agg(*(at(k, x) for k in (1, 2) for x in ("value", "origin")))
    return g.select("listing_id", "field", resolve.merge_field(F.col("value1"), F.col("origin1"), F.col("value2"), F.col("origin2")).alias("value"))


@query(
    "idempotent_claims",
    "SELECT a.claim_id FROM claims a WHERE a.claim_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM claims b WHERE b.claim_id % 2 = 1 AND a.listing_id = b.listing_id AND a.field = b.field AND a.origin = b.origin AND a.confidence IS NOT DISTINCT FROM b.confidence)",
    "claims",
)
def idempotent_claims(spark, d):
    c = claims(spark, d).withColumns({"evidence": F.lit(None).cast("string"), "value": F.lit("x"), "pos": F.col("claim_id") % 2})
    return resolve.new_claims(c.filter("pos = 0"), c.filter("pos = 1")).select("claim_id")


# -- records and lookups ----------------------------------------------------------------------------------------------


@query("latest_record", "SELECT listing_id, record_id, status FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY record_id DESC) AS r FROM records) t WHERE r = 1", "records")
def latest_record(spark, d):
    return resolve.latest(records(spark, d), "listing_id", by="record_id").select("listing_id", "record_id", "status")


@query("latest_per_identity", "SELECT listing_id, source, source_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, source, source_id ORDER BY record_id DESC) AS r FROM records) t WHERE r = 1", "records")
def latest_per_identity(spark, d):
    return resolve.latest(records(spark, d), "listing_id", "source", "source_id", by="record_id").select("listing_id", "source", "source_id", "record_id")


@query("seen_horizon", "SELECT source, source_id FROM records GROUP BY source, source_id HAVING max(fetched_at) >= TIMESTAMP '1998-07-01 00:00:00'", "records")
def seen_horizon(spark, d):
    r = records(spark, d)
    return health.seen_recently(r, r, "1998-07-02 00:00:00", 24).select("source", "source_id")


@query("score_default_join", "SELECT l.listing_id, coalesce(s.score, 0.0e0) AS score FROM listing l LEFT JOIN scores s ON s.listing_id = l.listing_id AND s.profile_id = 1", "listing", "scores")
def score_default_join(spark, d):
    return browse.with_score(listing(spark, d).select("listing_id"), scores(spark, d), 1)


@query("semi_starred", "SELECT listing_id FROM listing WHERE listing_id IN (SELECT listing_id FROM actions WHERE kind = 'star')", "listing", "actions")
def semi_starred(spark, d):
    return browse.with_action(listing(spark, d).select("listing_id"), actions(spark, d), "star")


@query("anti_excluded", "SELECT listing_id FROM listing WHERE listing_id NOT IN (SELECT listing_id FROM actions WHERE kind = 'excluded')", "listing", "actions")
def anti_excluded(spark, d):
    return browse.without_actions(listing(spark, d).select("listing_id"), actions(spark, d), "excluded")


@query(
    "action_flags",
    "SELECT listing_id, max(CASE WHEN kind = 'star' THEN 1 ELSE 0 END) = 1 AS star, max(CASE WHEN kind = 'dismiss' THEN 1 ELSE 0 END) = 1 AS dismiss, max(CASE WHEN kind = 'excluded' THEN 1 ELSE 0 END) = 1 AS excluded FROM actions GROUP BY listing_id",
    "actions",
)
def action_flags(spark, d):
    return browse.action_flags(actions(spark, d))


@query(
    "toggled_flags",
    "SELECT listing_id, sum(CASE WHEN kind = 'star' THEN 1 ELSE 0 END) % 2 = 1 AS star, sum(CASE WHEN kind = 'dismiss' THEN 1 ELSE 0 END) % 2 = 1 AS dismiss, sum(CASE WHEN kind = 'excluded' THEN 1 ELSE 0 END) % 2 = 1 AS excluded FROM actions GROUP BY listing_id",
    "actions",
)
def toggled_flags(spark, d):
    return browse.toggled_flags(actions(spark, d))


@query("entity_state", "SELECT listing_id, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen, max_by(status, record_id + epoch(fetched_at) * 1e6) AS status FROM records GROUP BY listing_id", "records")
def entity_state(spark, d):
    return sinks.entity_state(records(spark, d))


@query("upsert_records", "SELECT record_id, price FROM records WHERE status <> 'F' UNION ALL SELECT record_id, CAST(0 AS DOUBLE) AS price FROM records WHERE status = 'F'", "records")
def upsert_records(spark, d):
    r = records(spark, d).select("record_id", "price", "status")
    return browse.upsert(r, r.filter("status = 'F'").withColumn("price", F.lit(0.0)), "record_id").select("record_id", "price")


@query("lookup_chain", "SELECT o.o_orderkey AS record_id, c.c_name AS owner, n.n_name AS place, r.r_name AS area FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def lookup_chain(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return j.select(o["o_orderkey"].alias("record_id"), c["c_name"].alias("owner"), n["n_name"].alias("place"), r["r_name"].alias("area"))


@query("distinct_counts", "SELECT source, count(DISTINCT listing_id) AS listings, count(*) AS records FROM records GROUP BY source", "records")
def distinct_counts(spark, d):
    return records(spark, d).groupBy("source").agg(F.countDistinct("listing_id").alias("listings"), F.count(F.lit(1)).alias("records"))


@query("severity_max", "SELECT user_id AS listing_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def severity_max(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("listing_id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("ok").alias("s"))
    return e.groupBy("listing_id").agg(health.worst(F.col("s")).alias("status"))


@query("bounding_box", "SELECT min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM listing", "listing")
def bounding_box(spark, d):
    return parsers.search_box(listing(spark, d).select(F.col("lng").alias("west"), F.col("lng").alias("east"), F.col("lat").alias("south"), F.col("lat").alias("north")))


@query("search_urls", "SELECT r_name AS region, k AS keyword, concat('https://example.org/', r_name, '/', k) AS url FROM region, (VALUES ('apartments'), ('condos')) v(k)")
def search_urls(spark, d):
    return parsers.search_urls(table(spark, d, "region").select(F.col("r_name").alias("region")), ["apartments", "condos"], "https://example.org/")


@query("source_enablement", "SELECT n_name AS source, CASE WHEN n_regionkey = 0 THEN 'off in profile' WHEN n_nationkey % 3 = 0 THEN 'disabled' WHEN n_nationkey % 5 = 0 THEN 'missing credentials' END AS off FROM nation")
def source_enablement(spark, d):
    n = table(spark, d, "nation")
    catalog = n.select(F.col("n_name").alias("source"), (F.col("n_nationkey") % 3 != 0).alias("enabled"), (F.col("n_nationkey") % 5 == 0).alias("needs_credentials"))
    return parsers.enabled_sources(catalog, n.filter("n_regionkey <> 0").select(F.col("n_name").alias("source")), [])


# -- criteria and ranking ---------------------------------------------------------------------------------------------


@query("criteria_verdict", sqltext.VERDICT, "listing")
def criteria_verdict(spark, d):
    c = criteria.classify(listing(spark, d))
    line = lambda a, f: F.array_join(F.transform(a, f), "|")
    return c.select("listing_id", line("checks", lambda x: F.concat(x.field, F.lit(":"), x.status)).alias("checks"), F.array_join("misses", "|").alias("misses"), F.array_join("unknowns", "|").alias("unknowns"), "status", "evidence_status", "eligible")


@query("verdict_histogram", sqltext.over_verdict("SELECT status, evidence_status, count(*) AS n FROM v GROUP BY status, evidence_status"), "listing")
def verdict_histogram(spark, d):
    return criteria.classify(listing(spark, d)).groupBy("status", "evidence_status").agg(F.count(F.lit(1)).alias("n"))


@query("rubric_score", sqltext.over_score("SELECT listing_id, round(score, 6) AS score FROM s"), "listing")
def rubric_score(spark, d):
    return rank.score(listing(spark, d)).select("listing_id", F.round("score", 6).alias("score"))


@query("ranked_listings", sqltext.over_score("SELECT listing_id, round(score, 6) AS score, place FROM (SELECT listing_id, score, row_number() OVER (ORDER BY score DESC, listing_id) AS place FROM s WHERE eligible) t WHERE place <= 20"), "listing")
def ranked_listings(spark, d):
    top = rank.ranked(rank.score(listing(spark, d)), 20).select("listing_id", "score")
    return rank.with_rank(top, F.desc("score"), F.col("listing_id")).select("listing_id", F.round("score", 6).alias("score"), "place")


@query("category_rollup", sqltext.over_terms("SELECT listing_id, category, round(sum(contribution), 6) AS score, sum(max_possible) AS max_score, round(CASE WHEN sum(max_possible) > 0 THEN least(1e2, greatest(0e0, 1e2 * sum(contribution) / sum(max_possible))) ELSE 0e0 END, 6) AS pct FROM t GROUP BY listing_id, category"), "listing")
def category_rollup(spark, d):
    return rank.category_rollup(rank.score(listing(spark, d))).select("listing_id", "category", F.round("score", 6).alias("score"), "max_score", F.round("pct", 6).alias("pct"))


@query("top_contributors", sqltext.over_terms("SELECT listing_id, place, rule_key, round(contribution, 6) AS contribution FROM (SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY abs(contribution) DESC, i) AS INT) AS place FROM t WHERE contribution <> 0) x WHERE place <= 3"), "listing")
def top_contributors(spark, d):
    return rank.top_contributors(rank.score(listing(spark, d)), 3).withColumn("contribution", F.round("contribution", 6))


@query("rule_rows", sqltext.over_terms("SELECT listing_id, rule_key, round(contribution, 6) AS contribution FROM t"), "listing")
def rule_rows(spark, d):
    return rank.score(listing(spark, d)).select("listing_id", F.explode("breakdown").alias("t")).select("listing_id", "t.rule_key", F.round("t.contribution", 6).alias("contribution"))


_TOLD = "string_agg(CASE WHEN contribution {0} THEN label END, ', ' ORDER BY {1}, label)"


@query(
    "explanation",
    sqltext.over_terms(f"SELECT listing_id, coalesce({_TOLD.format('> 0', '-contribution')}, '') AS helped, coalesce({_TOLD.format('< 0', 'contribution')}, '') AS hurt, coalesce({_TOLD.format('= 0', '1')}, '') AS neutral FROM (SELECT *, {sqltext.LABEL} AS label FROM t) y GROUP BY listing_id"),
    "listing",
)
def explanation(spark, d):
    return rank.explanation(rank.score(listing(spark, d)))


@query(
    "rubric_diff",
    sqltext.over_verdict("SELECT listing_id, CASE WHEN other THEN 'entered' ELSE 'left' END AS change FROM (SELECT listing_id, eligible, (" + sqltext.OTHER_ELIGIBLE + ") AS other FROM v) x WHERE eligible <> other"),
    "listing",
)
def rubric_diff(spark, d):
    return rank.rubric_diff(listing(spark, d), RUBRIC, OTHER)


@query("best_scores", "SELECT listing_id, score FROM (SELECT listing_id, max(score) AS score FROM scores GROUP BY listing_id) t ORDER BY score DESC, listing_id LIMIT 10", "scores")
def best_scores(spark, d):
    return rank.best_per_listing(scores(spark, d), 10)


@query("score_badges", "SELECT listing_id, profile_id, CASE WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'mid' ELSE 'low' END AS badge FROM scores", "scores")
def score_badges(spark, d):
    return scores(spark, d).select("listing_id", "profile_id", S.score_badge(F.col("score")).alias("badge"))


@query("decision_brief", sqltext.over_verdict("SELECT listing_id, CASE WHEN evidence_status = 'miss' THEN 'rule out' WHEN listing_id % 3 = 0 THEN 'refresh first' WHEN evidence_status = 'unverified' THEN 'ask first' ELSE 'worth a visit' END AS headline FROM v"), "listing")
def decision_brief(spark, d):
    c = criteria.classify(listing(spark, d)).withColumn("fetched_at", F.when(F.col("listing_id") % 3 == 0, F.lit("2023-12-01 00:00:00")).otherwise(F.lit("2024-01-14 12:00:00")).cast("timestamp"))
    return browse.decision_brief(c, AS_OF).select("listing_id", "headline")


@query("missing_facts", "SELECT listing_id, concat_ws(',', CASE WHEN rent IS NULL THEN 'rent' END, CASE WHEN beds IS NULL THEN 'bedrooms' END, CASE WHEN floor IS NULL THEN 'floor' END) AS missing FROM listing", "listing")
def missing_facts(spark, d):
    return browse.missing_facts(listing(spark, d), {"rent": "rent", "beds": "bedrooms", "floor": "floor"}).withColumn("missing", F.array_join("missing", ","))


# -- browsing ---------------------------------------------------------------------------------------------------------

_ROWS = "SELECT l.*, coalesce(s.score, 0e0) AS score, CAST(listing_id % 28 AS INT) AS posted FROM listing l LEFT JOIN (SELECT listing_id AS k, score FROM scores WHERE profile_id = 1) s ON s.k = l.listing_id"


def _rows(spark, d):
    return browse.with_score(listing(spark, d), scores(spark, d), 1).withColumn("posted", (F.col("listing_id") % 28).cast("int"))


_FILTER = browse.ListFilter(rent_max=2600.0, beds=2.0, area_min=200.0, score_min=10.0, source="feed_b")


@query("browse_filter", f"SELECT listing_id FROM ({_ROWS}) x WHERE (rent IS NULL OR rent <= 2600) AND (beds IS NULL OR beds >= 2) AND (area IS NULL OR area >= 200) AND score >= 10 AND source = 'feed_b'", "listing", "scores")
def browse_filter(spark, d):
    return _rows(spark, d).filter(_FILTER.predicate()).select("listing_id")


_ORDERS = {
    "score": "score DESC NULLS LAST",
    "rent_asc": "rent ASC NULLS LAST",
    "rent_desc": "rent DESC NULLS LAST",
    "area_desc": "area DESC NULLS LAST",
    "posted_desc": "posted DESC NULLS LAST",
    "posted_asc": "posted ASC NULLS LAST",
    "address": "lower(coalesce(address, '')) ASC",
}


def _sorted(name: str, by: str) -> None:
    @query(f"sort_{name}", f"SELECT listing_id, place FROM (SELECT listing_id, row_number() OVER (ORDER BY {by}, listing_id) AS place FROM ({_ROWS}) x) t WHERE place > 10 AND place <= 46", "listing", "scores")
    def run(spark, d):
        top = browse.page(_rows(spark, d), sort=name, limit=36, offset=10)
        return rank.with_rank(top, *browse.sorts()[name], F.col("listing_id")).select("listing_id", (F.col("place") + 10).alias("place"))


for _name, _by in _ORDERS.items():
    _sorted(_name, _by)


@query("action_order", "SELECT listing_id, action_id, place FROM (SELECT listing_id, action_id, row_number() OVER (PARTITION BY listing_id ORDER BY created_at DESC, action_id DESC) AS place FROM actions) t WHERE place <= 3", "actions")
def action_order(spark, d):
    w = resolve.Window.partitionBy("listing_id").orderBy(F.desc("created_at"), F.desc("action_id"))
    return actions(spark, d).select("listing_id", "action_id", F.row_number().over(w).alias("place")).filter("place <= 3")


# -- entities ---------------------------------------------------------------------------------------------------------


@query("signatures", sqltext.over_signature("SELECT listing_id, signature FROM g"), "listing")
def signatures(spark, d):
    return entity.with_signature(listing(spark, d)).select("listing_id", "signature")


@query("signature_groups", sqltext.over_signature("SELECT signature, count(*) AS n, count(DISTINCT source) AS sources, min(listing_id) AS least FROM g GROUP BY signature HAVING count(DISTINCT source) > 1"), "listing")
def signature_groups(spark, d):
    return entity.signature_groups(listing(spark, d))


@query(
    "canonical_ids",
    sqltext.over_signature("SELECT listing_id, CASE WHEN k = 1 THEN lead ELSE listing_id END AS canonical_id FROM (SELECT listing_id, first_value(listing_id) OVER (PARTITION BY signature ORDER BY source, listing_id) AS lead, row_number() OVER (PARTITION BY signature, source ORDER BY listing_id) AS k FROM g) t"),
    "listing",
)
def canonical_ids(spark, d):
    return entity.canonical_ids(listing(spark, d))


_KINDS_OF = "CASE WHEN lat IS NOT NULL THEN concat(round(lat, 4), '|', round(lng, 4)) END AS point, CASE WHEN rent IS NOT NULL AND beds IS NOT NULL AND baths IS NOT NULL THEN concat(rent, '|', beds, '|', baths) END AS size"
_LEADS = " UNION ".join(f"SELECT min(listing_id) OVER (PARTITION BY {x}, {y}) AS a, listing_id AS b FROM l WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in (("point", "size"), ("point", "signature"), ("size", "signature")))


@query(
    "k_of_n_candidates",
    sqltext.over_signature(
        f", l AS (SELECT listing_id, signature, {_KINDS_OF} FROM g), p AS ({_LEADS}) SELECT p.a, p.b, CASE WHEN x.point = y.point THEN 1 ELSE 0 END + CASE WHEN x.size = y.size THEN 1 ELSE 0 END + CASE WHEN x.signature = y.signature THEN 1 ELSE 0 END AS evidence FROM p JOIN l x ON x.listing_id = p.a JOIN l y ON y.listing_id = p.b WHERE p.a <> p.b"
    ),
    "listing",
)
def k_of_n_candidates(spark, d):
    return entity.candidates(listing(spark, d))


_KEYWORDS = ["quiet", "suite with", "building gym", "lease", "heart of town", "tree-lined street", "part"]


@query(
    "theta_keyword_area",
    "SELECT listing_id, min(n_name) AS area_key FROM (SELECT l.listing_id, n.n_name FROM listing l JOIN nation n ON n_nationkey % 7 <> 6 AND regexp_matches(lower(concat_ws(' ', title, description)), '\\b' || (["
    + ", ".join(f"'{k}'" for k in _KEYWORDS)
    + "])[n_nationkey % 7 + 1] || '\\b')) t GROUP BY listing_id",
    "listing",
)
def theta_keyword_area(spark, d):
    word = F.element_at(F.array(*map(F.lit, _KEYWORDS)), F.col("n_nationkey") % len(_KEYWORDS) + 1)
    keys = table(spark, d, "nation").select(word.alias("keyword"), F.col("n_name").alias("key"))
    return entity.area_from_text(listing(spark, d).withColumn("t", F.concat_ws(" ", "title", "description")), keys, "t", "listing_id", city="Part")


@query("haversine_topk", sqltext.HAVERSINE, "listing")
def haversine_topk(spark, d):
    km = S.haversine_km(F.col("lat"), F.col("lng"), F.lit(43.65), F.lit(-79.38))
    near = listing(spark, d).filter("lat IS NOT NULL").select("source", "listing_id", km.alias("km"))
    w = resolve.Window.partitionBy("source").orderBy(F.round("km", 6), "listing_id")
    return near.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("source", "listing_id", F.round("km", 6).alias("km"), "place")


@query("price_buckets", "SELECT p_partkey AS id, CAST(round(CAST(trunc(p_retailprice) AS BIGINT) / 25.0e0) * 25 AS BIGINT) AS bucket FROM part")
def price_buckets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.price_bucket(F.col("p_retailprice")).alias("bucket"))


@query(
    "canonical_addresses",
    """SELECT listing_id, concat(100 + listing_id % 50, CASE listing_id % 4 WHEN 0 THEN ' W. Main Street' WHEN 1 THEN ' Queen St East, Toronto' WHEN 2 THEN ' Mill Rd., ON M5V 2T6' ELSE ' North Harbour Ave' END, ', ', title) AS address,
  concat(100 + listing_id % 50, CASE listing_id % 4 WHEN 0 THEN ' west main' WHEN 1 THEN ' queen st east toronto' WHEN 2 THEN ' mill rd on m5v 2t6' ELSE ' north harbour' END) AS match_key FROM listing""",
    "listing",
)
def canonical_addresses(spark, d):
    return listing(spark, d).select("listing_id", S.canonical_address(F.col("address"), F.col("title")).alias("address"), S.match_key(F.col("address")).alias("match_key"))


@query("matching_addresses", "SELECT min(listing_id) OVER (PARTITION BY listing_id % 100) AS a, listing_id AS b FROM listing QUALIFY a <> b", "listing")
def matching_addresses(spark, d):
    return entity.matching_addresses(listing(spark, d))


# -- sources' health, increments --------------------------------------------------------------------------------------


@query("baseline_band", sqltext.BANDS, "runs")
def baseline_band(spark, d):
    return health.bands(runs(spark, d))


@query("watermark_decision", sqltext.WATERMARK, "runs")
def watermark_decision(spark, d):
    return health.watermark_decision(runs(spark, d)).select("source", "now", "in_band", "newer", "advance", "alert", "next_watermark")


@query("run_histories", "SELECT source, string_agg(CAST(n AS VARCHAR), ',' ORDER BY day DESC) AS counts, max(newest) AS watermark FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS r FROM runs) t WHERE r <= 30 GROUP BY source", "runs")
def run_histories(spark, d):
    return health.histories(runs(spark, d)).select("source", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"), "watermark")


@query("counts_document", "SELECT CAST(day AS VARCHAR) AS day, '{' || string_agg('\"' || source || '\":' || n, ',' ORDER BY source) || '}' AS doc FROM runs GROUP BY day", "runs")
def counts_document(spark, d):
    return health.counts_document(runs(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("first_arrivals", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) t WHERE r = 1")
def first_arrivals(spark, d):
    # the hash is grouped, not the text: a sort of texts for every row is spared
    return incremental.first_arrivals(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sig")), "sig", "doc_id").select("doc_id")


@query("stateful_dedupe", sqltext.DEDUPE)
def stateful_dedupe(spark, d):
    sig = (F.col("event_id") % 700 + F.floor(F.col("event_id") / 1000)) % 150
    e = table(spark, d, "events").select((F.col("event_id") % 700).alias("id"), sig.alias("sig"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    one = incremental.dedupe(e.filter("at % 3 = 0"))
    two = incremental.dedupe(e.filter("at % 3 <> 0"), incremental.seen_after(one, None, AS_OF))
    both = one.withColumn("run", F.lit(1)).union(two.withColumn("run", F.lit(2)))
    return both.groupBy("run", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("sum_at"))


@query("late_rows", "SELECT event_type, count(*) AS dropped FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def late_rows(spark, d):
    return table(spark, d, "events").filter(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("dropped"))


_KIND = "(['queued', 'claimed', 'failed', 'claimed', 'done'])[CAST(event_id % 5 AS INT) + 1]"


@query(
    "job_states",
    f"""WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT job, CAST(0 AS BIGINT) AS r, 'queued' AS state, CAST(0 AS INT) AS attempts FROM (SELECT DISTINCT job FROM e) j UNION ALL
  SELECT e.job, e.r, CASE WHEN state IN ('succeeded', 'failed', 'cancelled') THEN state WHEN kind = 'claimed' AND state = 'queued' THEN 'running' WHEN kind = 'done' AND state = 'running' THEN 'succeeded'
    WHEN kind = 'failed' AND state = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE state END,
    CASE WHEN state = 'queued' AND kind = 'claimed' THEN attempts + 1 ELSE attempts END FROM s JOIN e ON e.job = s.job AND e.r = s.r + 1)
SELECT job, arg_max(state, r) AS state, arg_max(attempts, r) AS attempts, CASE WHEN arg_max(state, r) = 'queued' AND arg_max(attempts, r) > 0 THEN least(30, CAST(power(2, arg_max(attempts, r)) AS INT)) END AS wait_s FROM s GROUP BY job""",
)
def job_states(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("queued", "claimed", "failed", "claimed", "done"))), (F.col("event_id") % 5 + 1).cast("int"))
    return incremental.job_states(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kinds.alias("kind")))


_CLAIM = "(['queued', 'claimed', 'done', 'claimed', 'failed', 'claimed', 'done'])[CAST(event_id % 7 AS INT) + 1]"
_HELD_S = 43_200


@query(
    "leased_jobs",
    f"""WITH RECURSIVE e AS (SELECT user_id AS job, {_CLAIM} AS kind, concat('w', event_id % 3) AS token, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS r FROM events),
s AS (SELECT job, CAST(0 AS BIGINT) AS r, 'queued' AS state, CAST(0 AS INT) AS attempts, CAST(NULL AS VARCHAR) AS token, CAST(NULL AS BIGINT) AS until FROM (SELECT DISTINCT job FROM e) j UNION ALL
  SELECT job, r, CASE WHEN takes THEN 'running' WHEN held AND kind = 'done' THEN 'succeeded' WHEN held AND kind = 'failed' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE now END,
    CASE WHEN takes THEN attempts + 1 ELSE attempts END, CASE WHEN takes THEN whose WHEN now = 'running' AND NOT (held AND kind IN ('done', 'failed')) THEN token END, CASE WHEN takes THEN ms + {_HELD_S * 1000} WHEN now = 'running' AND NOT (held AND kind IN ('done', 'failed')) THEN until END
  FROM (SELECT *, now = 'queued' AND kind = 'claimed' AS takes, now = 'running' AND whose = token AS held FROM (SELECT e.job, e.r, e.kind, e.ms, e.token AS whose, s.token, s.until, s.attempts,
    CASE WHEN s.state = 'running' AND s.until <= e.ms THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE s.state END AS now FROM s JOIN e ON e.job = s.job AND e.r = s.r + 1) x) y),
l AS (SELECT job, arg_max({{'state': state, 'attempts': attempts, 'until': until}}, r) AS x FROM s GROUP BY job)
SELECT job, CASE WHEN x.state = 'running' AND x.until <= epoch_ms(TIMESTAMP '{AS_OF}') + 1382400000 THEN CASE WHEN x.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE x.state END AS state, x.attempts AS attempts FROM l""",
)
def leased_jobs(spark, d):
    """Jobs whose claims run out after twelve hours, as they stand at the end of the month."""
    kinds = F.element_at(F.array(*map(F.lit, ("queued", "claimed", "done", "claimed", "failed", "claimed", "done"))), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), kinds.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("token"), F.col("ts").cast("timestamp").alias("at"))
    return leases.leased_states(e, "2024-01-31 00:00:00", _HELD_S).select("job", "state", "attempts")


@query("tail_of_state", "SELECT c_custkey AS id FROM customer WHERE DATE '2024-01-01' - CAST(c_custkey % 200 AS INT) >= DATE '2024-01-01' - 90")
def tail_of_state(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 200).cast("int")).cast("string").alias("last_seen"))
    return incremental.forget(s, "2024-01-01 00:00:00").select("id")


@query("union_sources", "SELECT 'customer' AS kind, c_nationkey AS place, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey")
def union_sources(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("place"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("place"))).groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n"))


@query("except_both_ways", "(SELECT c_custkey % 40 AS place, 'only_customers' AS side FROM customer EXCEPT SELECT s_suppkey % 60 + 7, 'only_customers' FROM supplier) UNION ALL (SELECT s_suppkey % 60 + 7, 'only_suppliers' FROM supplier EXCEPT SELECT c_custkey % 40, 'only_suppliers' FROM customer)")
def except_both_ways(spark, d):
    c, s = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("place")), table(spark, d, "supplier").select((F.col("s_suppkey") % 60 + 7).alias("place"))
    return c.subtract(s).withColumn("side", F.lit("only_customers")).unionByName(s.subtract(c).withColumn("side", F.lit("only_suppliers")))


# -- corrections, revisions, jobs, stages -----------------------------------------------------------------------------

_CHECKED_CORRECTIONS = """c AS (SELECT *, CASE WHEN field = 'colour' THEN 'unknown field' WHEN seq % 11 = 7 THEN 'no value' WHEN field IN ('rent', 'floor') THEN CASE seq % 11 WHEN 1 THEN 'negative' WHEN 0 THEN NULL WHEN 8 THEN NULL
    WHEN 2 THEN CASE WHEN field = 'floor' THEN 'not a whole number' END ELSE 'not a number' END
  WHEN field = 'furnishing' AND seq % 11 <> 3 THEN 'not a choice' WHEN field = 'basement' AND seq % 11 <> 4 THEN 'not a choice' WHEN field = 'available_date' AND seq % 11 <> 5 THEN 'not a date' END AS error FROM corrections),
k AS (SELECT *, CASE field WHEN 'colour' THEN NULL WHEN 'basement' THEN 'attributes.basement' WHEN 'available_date' THEN 'attributes.available_date' WHEN 'research_address' THEN 'attributes.research_address' ELSE field END AS stored,
  CASE WHEN error IS NULL THEN CASE field WHEN 'rent' THEN CASE seq % 11 WHEN 0 THEN '1500.0' WHEN 8 THEN '7.0' ELSE '4.5' END WHEN 'floor' THEN CASE seq % 11 WHEN 0 THEN '1500' ELSE '7' END
    WHEN 'furnishing' THEN 'unfurnished' WHEN 'basement' THEN 'true' ELSE trim(value) END END AS parsed FROM c)"""


@query("checked_corrections", f", {_CHECKED_CORRECTIONS} SELECT seq, stored, parsed, error FROM k", "corrections")
def checked_corrections(spark, d):
    return review.checked_corrections(view(spark, d, "corrections")).select("seq", "stored", "parsed", "error")


@query("corrections_in_force", f", {_CHECKED_CORRECTIONS} SELECT listing_id, field, parsed, seq FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY seq DESC) AS r FROM k WHERE clear OR error IS NULL) t WHERE r = 1 AND NOT clear", "corrections")
def corrections_in_force(spark, d):
    return review.corrections(view(spark, d, "corrections"))


_OUTCOMES = """o AS (SELECT q.listing_id, q.revision, q.seq, CASE WHEN q.revision < 0 THEN 'missing' WHEN q.hash = 'old' THEN 'stale' WHEN r.state = 'superseded' THEN 'superseded' WHEN r.state = 'applied' OR (q.seq > 100000000 AND q.revision % 3 = 0) THEN 'repeated' ELSE 'applied' END AS outcome
FROM requests q LEFT JOIN revisions r ON r.revision = q.revision)"""


@query("applied_revisions", f", {_OUTCOMES} SELECT * FROM o", "revisions", "requests")
def applied_revisions(spark, d):
    return review.applied_revisions(view(spark, d, "revisions"), view(spark, d, "requests"))


@query(
    "merged_revisions",
    f""", {_OUTCOMES}, n AS (SELECT listing_id, max(revision) AS force FROM o WHERE outcome = 'applied' GROUP BY listing_id)
SELECT r.listing_id, r.revision, r.hash, CASE WHEN r.revision = force THEN 'applied' WHEN r.revision IN (SELECT revision FROM o WHERE outcome = 'applied') OR (force IS NOT NULL AND state = 'applied') THEN 'superseded' ELSE state END AS state
FROM revisions r LEFT JOIN n ON n.listing_id = r.listing_id""",
    "revisions",
    "requests",
)
def merged_revisions(spark, d):
    r = view(spark, d, "revisions")
    return review.merged_revisions(r, review.applied_revisions(r, view(spark, d, "requests")))


@query("saved_last", "SELECT listing_id, max(revision) AS revision FROM revisions GROUP BY listing_id", "revisions")
def saved_last(spark, d):
    return review.saved_last(view(spark, d, "revisions").withColumn("seq", F.col("revision")))


@query(
    "enqueued_jobs",
    """, q AS (SELECT user_id AS listing_id, event_id AS seq FROM events WHERE event_type = 'purchase'),
a AS (SELECT listing_id, job FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY requested_at DESC, job DESC) AS r FROM jobs WHERE state <> 'failed' AND listing_id % 3 = 0) t WHERE r = 1),
n AS (SELECT listing_id, max(record_id) AS record_id FROM saved GROUP BY listing_id), f AS (SELECT *, min(seq) OVER (PARTITION BY listing_id) AS first FROM q)
SELECT f.listing_id, f.seq, CASE WHEN a.job IS NOT NULL THEN 'joined' WHEN n.record_id IS NULL THEN 'refused' WHEN f.seq = first THEN 'queued' ELSE 'joined' END AS outcome,
  coalesce(a.job, CASE WHEN n.record_id IS NOT NULL THEN concat('job-', f.listing_id, '-', first) END) AS job, n.record_id FROM f LEFT JOIN a ON a.listing_id = f.listing_id LEFT JOIN n ON n.listing_id = f.listing_id""",
    "jobs",
    "saved",
)
def enqueued_jobs(spark, d):
    asked = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("seq"))
    return review.enqueued(asked, view(spark, d, "jobs").filter("listing_id % 3 = 0"), view(spark, d, "saved"))


@query(
    "published_results",
    """SELECT w.job, j.listing_id, CASE WHEN w.token <> 't' OR j.state <> 'running' THEN 'dropped' WHEN w.source_id = 'x' OR s.record_id IS NULL THEN 'identity_mismatch' WHEN n.newest <> j.record_id THEN 'stale_source'
  WHEN status IN ('blocked', 'removed') THEN status WHEN status = 'odd' THEN 'failed' WHEN w.hash = s.hash THEN 'unchanged' ELSE 'published' END AS outcome
FROM returned w JOIN jobs j ON j.job = w.job LEFT JOIN saved s ON s.record_id = j.record_id LEFT JOIN (SELECT listing_id, max(record_id) AS newest FROM saved GROUP BY listing_id) n ON n.listing_id = j.listing_id""",
    "jobs",
    "saved",
    "returned",
)
def published_results(spark, d):
    return review.published(view(spark, d, "returned"), view(spark, d, "jobs"), view(spark, d, "saved"))


@query("persisted_rows", "SELECT record_id AS listing_id, NOT (source = 'src1' AND source_id < 'k3') AS is_new FROM records WHERE NOT (record_id % 2 = 0 AND source = 'src1' AND source_id < 'k3')", "records")
def persisted_rows(spark, d):
    r = records(spark, d)
    known = r.filter("source = 'src1' AND source_id < 'k3'").select("source", "source_id")
    return review.persisted(r.select(F.col("record_id").alias("listing_id"), "source", "source_id", (F.col("record_id") % 2 == 0).alias("discovery_only")), known)


@query("scores_kept", sqltext.over_verdict("SELECT s.* FROM scores s WHERE s.listing_id NOT IN (SELECT listing_id FROM v WHERE NOT eligible)"), "listing", "scores")
def scores_kept(spark, d):
    return review.scores_kept(scores(spark, d), criteria.classify(listing(spark, d)))


_STATES = "CASE WHEN event_type = 'error' THEN concat('e', event_id % 3) WHEN event_id % 4 = 1 THEN 'skipped' WHEN event_id % 4 = 2 THEN 'prefiltered' ELSE 'ok' END"
_SNAPSHOT = f"""p AS (SELECT event_type AS source, {_STATES} AS state FROM events UNION ALL SELECT concat(event_type, '_2'), CASE WHEN event_id % 5 = 0 THEN 'e9' ELSE 'ok' END FROM events),
n AS (SELECT source, count(*) FILTER (state = 'ok') AS persisted, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'prefiltered') AS prefiltered, count(*) FILTER (state LIKE 'e%') AS errors, min(CASE WHEN state LIKE 'e%' THEN state END) AS error FROM p GROUP BY source),
g AS (SELECT *, persisted + skipped + prefiltered AS tracked, CASE WHEN errors = 0 THEN 'ok' WHEN persisted + skipped + prefiltered = 0 THEN 'failed' ELSE 'degraded' END AS status FROM n)"""


def _snapshot(spark, d):
    e = table(spark, d, "events")
    one = e.select(F.col("event_type").alias("source"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id") % 3)).when(F.col("event_id") % 4 == 1, "skipped").when(F.col("event_id") % 4 == 2, "prefiltered").otherwise("ok").alias("state"))
    two = e.select(F.concat("event_type", F.lit("_2")).alias("source"), F.when(F.col("event_id") % 5 == 0, "e9").otherwise("ok").alias("state"))
    return review.snapshots(one.unionByName(two))


@query("source_snapshots", f"WITH {_SNAPSHOT} SELECT * FROM g")
def source_snapshots(spark, d):
    return _snapshot(spark, d)


@query("source_reports", sqltext.WATERMARK.replace("SELECT source, now,", f", {_SNAPSHOT}, w AS (SELECT source, now,").rstrip() + ") SELECT g.source, tracked, status, advance, alert FROM g LEFT JOIN w ON w.source = g.source", "runs")
def source_reports(spark, d):
    return review.source_reports(_snapshot(spark, d), health.watermark_decision(runs(spark, d))).select("source", "tracked", "status", "advance", "alert")


_ROOM = f"(({sqltext.EXTRACTORS['full_unit']}) IS NOT DISTINCT FROM FALSE AND listing_id % 5 <> 0)"
_BEDS = "(CASE listing_id % 12 WHEN 0 THEN beds IS NOT NULL AND beds <> 2 WHEN 6 THEN beds IS NOT NULL AND beds <> 3 WHEN 1 THEN TRUE ELSE FALSE END AND listing_id % 3 <> 0)"


@query("evidence_issues", f"SELECT listing_id, concat_ws(',', CASE WHEN {_ROOM} THEN 'full_unit' END, CASE WHEN {_BEDS} THEN 'beds' END) AS issues FROM listing", "listing")
def evidence_issues(spark, d):
    return _doubts(spark, d).select("listing_id", F.array_join("issues", ",").alias("issues"))


def _doubts(spark, d):
    said = criteria.with_facts(listing(spark, d)).withColumns({"full_unit_origin": F.when(F.col("listing_id") % 5 == 0, "user"), "beds_origin": F.when(F.col("listing_id") % 3 == 0, "user")})
    return review.evidence_issues(said)


@query("doubted_verdicts", sqltext.over_verdict(f"SELECT listing_id, CASE WHEN greatest(s_rent = 'fail', s_beds = 'fail' AND NOT {_BEDS}, " + ", ".join(f"s_{k} = 'fail'" for k in sqltext.CRITERIA if k not in ("rent", "beds")) + f") THEN 'miss' WHEN greatest({_ROOM}, {_BEDS}, " + ", ".join(f"s_{k} = 'unknown'" for k in sqltext.CRITERIA) + ") THEN 'unverified' ELSE status END AS evidence_status FROM v"), "listing")
def doubted_verdicts(spark, d):
    return review.doubted(criteria.classify(_doubts(spark, d))).select("listing_id", "evidence_status")


# -- what is shown ----------------------------------------------------------------------------------------------------


@query(
    "list_rows",
    sqltext.over_verdict(
        """, f AS (SELECT listing_id, max(CASE WHEN kind = 'star' THEN 1 ELSE 0 END) = 1 AS star, max(CASE WHEN kind = 'excluded' THEN 1 ELSE 0 END) = 1 AS excluded FROM actions GROUP BY listing_id)
SELECT v.listing_id, CASE WHEN rent IS NULL THEN 'unknown' ELSE format('{:.2f} {}', rent, currency) END AS rent_text, CASE WHEN rent IS NOT NULL THEN format('${:,}', CAST(rent AS BIGINT)) END AS rent_short, CASE WHEN coalesce(excluded, FALSE) THEN 'excluded' ELSE evidence_status END AS match_status, coalesce(star, FALSE) AS starred, ak AS area_key FROM v LEFT JOIN f ON f.listing_id = v.listing_id"""
    ),
    "listing",
    "actions",
)
def list_rows(spark, d):
    return display.list_rows(criteria.classify(listing(spark, d)), browse.action_flags(actions(spark, d))).select("listing_id", "rent_text", "rent_short", "match_status", "starred", "area_key")


@query("look_ahead", "SELECT listing_id, rent FROM listing WHERE rent IS NOT NULL ORDER BY rent, listing_id LIMIT 37 OFFSET 36", "listing")
def look_ahead(spark, d):
    """The second page, by the last keys of the first."""
    rows = listing(spark, d).filter("rent IS NOT NULL").select("listing_id", "rent")
    first = display.page_after(rows, "rent", "listing_id").collect()
    last = first[display.PAGE - 1] if len(first) > display.PAGE else None
    return display.page_after(rows, "rent", "listing_id", last=last and (last.rent, last.listing_id)) if last else rows.limit(0)


@query("listing_detail", "SELECT l.listing_id, l.title, r.record_id, s.score, f.star FROM listing l JOIN (SELECT listing_id, max(record_id) AS record_id FROM records GROUP BY listing_id) r ON r.listing_id = l.listing_id LEFT JOIN scores s ON s.listing_id = l.listing_id AND s.profile_id = 1 LEFT JOIN (SELECT listing_id, max(CASE WHEN kind = 'star' THEN 1 ELSE 0 END) = 1 AS star FROM actions GROUP BY listing_id) f ON f.listing_id = l.listing_id WHERE l.listing_id = 7", "listing", "records", "scores", "actions")
def listing_detail(spark, d):
    one = display.detail(7, listing(spark, d), records(spark, d), scores(spark, d).filter("profile_id = 1"), browse.action_flags(actions(spark, d)))
    return one.select("listing_id", "title", "record.record_id", "score", "star")


@query("saved_breakdowns", "SELECT listing_id, 'r' AS rule_key, CAST(listing_id AS DOUBLE) / 4 AS contribution FROM listing WHERE listing_id % 3 <> 0 AND listing_id % 2 = 0", "listing")
def saved_breakdowns(spark, d):
    l = listing(spark, d).select("listing_id", F.when(F.col("listing_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('[{"rule_key":"r","contribution":'), (F.col("listing_id") / 4).cast("string"), F.lit("}]"))).alias("breakdown"))
    b = display.breakdowns(l, l.filter("listing_id % 2 = 0"), "array<struct<rule_key:string,contribution:double>>")
    return b.select("listing_id", F.explode("breakdown").alias("t")).select("listing_id", "t.rule_key", "t.contribution")


@query(
    "display_texts",
    """SELECT listing_id, concat('https://maps.example/dir?api=1&origin=', replace(replace(address, ' ', '+'), ',', '%2C'), '&destination=43.65%2C-79.38&travelmode=walking') AS directions,
  CASE listing_id % 4 WHEN 0 THEN '+5' WHEN 1 THEN '-2.5' WHEN 2 THEN '+1.5 per 100, cap 9' ELSE '—' END AS weight,
  CASE listing_id % 5 WHEN 0 THEN 'Unstated' WHEN 1 THEN 'Conflicting evidence' WHEN 2 THEN 'Not applicable' WHEN 3 THEN 'Yes' ELSE 'heat, hot water' END AS fact,
  left(concat('said ', title), 9) AS outside, listing_id % 2 = 0 AS in_city, concat('1|toronto|', lower(title)) AS report_key, listing_id % 3 = 1 AS current FROM listing""",
    "listing",
)
def display_texts(spark, d):
    i = F.col("listing_id")
    number = lambda *cases: F.when(i % 4 == cases[0], cases[1]).cast("double") if len(cases) == 2 else F.when(i % 4 == cases[0], cases[1]).when(i % 4 == cases[2], cases[3]).cast("double")
    saved = F.when(i % 3 == 0, "2024-01-13 00:00:00").when(i % 3 == 1, "2024-01-14 12:00:00").otherwise("2024-01-16 00:00:00").cast("timestamp")
    key = display.report_key(F.col("title"), F.lit(" Toronto "))
    return listing(spark, d).select(
        "listing_id",
        display.directions_url("https://maps.example/dir", F.col("address"), F.lit(43.65), F.lit(-79.38)).alias("directions"),
        display.weight_text(number(0, 5, 1, -2.5), number(2, 1.5), number(2, 9), F.lit("100")).alias("weight"),
        display.fact_text(F.when(i % 5 == 3, "true").when(i % 5 == 4, "heat,hot_water"), F.when(i % 5 == 1, "contradictory").when(i % 5 == 2, "not_applicable")).alias("fact"),
        display.external_text(F.concat(F.lit("<<<begin>>> said\n "), "title", F.lit("[/external text]")), 9).alias("outside"),
        display.holds_run(F.when(i % 2 == 0, "near New  Westminster, BC").otherwise("New of Westminster"), F.lit("new-westminster")).alias("in_city"),
        key.alias("report_key"),
        display.report_current(key, key, saved, AS_OF).alias("current"),
    )


@query(
    "posted_times",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN TIMESTAMP '2024-01-05 06:00:00' WHEN 1 THEN TIMESTAMP '2024-01-14 21:00:00' WHEN 2 THEN TIMESTAMP '2024-01-14 23:30:00' WHEN 3 THEN TIMESTAMP '2023-11-16 00:00:00' WHEN 4 THEN TIMESTAMP '2024-01-01 00:00:00'
  WHEN 5 THEN TIMESTAMP '2023-12-25 00:00:00' WHEN 6 THEN TIMESTAMP '2024-01-10 00:00:00' END AS posted FROM events""",
)
def posted_times(spark, d):
    """As stated, 3 hours, 30 minutes, 2 months and 2 weeks ago, days of last year and of this, and nothing."""
    label = F.element_at(F.array(*map(F.lit, ("x", "3h ago", "<30 mins ago", "2 mo ago", "2 weeks ago", "12/25", "1-10", "soon"))), (F.col("event_id") % 8 + 1).cast("int"))
    posted = F.when(F.col("event_id") % 8 == 0, "2024-01-05T06:00:00Z").otherwise("")
    return table(spark, d, "events").select("event_id", display.posted_at(posted, label, AS_OF).alias("posted"))


@query("merged_patches", "SELECT listing_id, CASE WHEN listing_id % 2 = 0 THEN 'b=' || title || ',c=3' ELSE 'a=1,b=' || title END AS merged FROM listing", "listing")
def merged_patches(spark, d):
    now = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    patch = F.when(F.col("listing_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.col("title"), F.lit("c"), F.lit("3"))).otherwise(F.create_map(F.lit("b"), F.col("title")))
    merged = F.transform(F.array_sort(F.map_entries(display.merge_patch(now, patch))), lambda e: F.concat(e.key, F.lit("="), e.value))
    return listing(spark, d).select("listing_id", F.array_join(merged, ",").alias("merged"))


@query("attribute_categories", "SELECT listing_id, field AS category, confidence AS score, confidence * 100 AS pct FROM claims", "claims")
def attribute_categories(spark, d):
    return display.attribute_categories(claims(spark, d).withColumn("field", F.concat("field", F.lit(".x"))))


@query("photo_candidates", "SELECT min(listing_id) OVER (PARTITION BY listing_id % 37) AS a, listing_id AS b, CAST(1 AS BIGINT) AS photos FROM listing QUALIFY a <> b", "listing")
def photo_candidates(spark, d):
    urls = F.array(F.concat(F.lit("https://x/"), F.col("listing_id") % 37, F.lit("?w="), F.col("listing_id")), F.concat(F.lit("https://own/"), "listing_id"))
    return display.photo_candidates(listing(spark, d).select("listing_id", urls.alias("photo_urls")))


# -- landed records and pages to rows ---------------------------------------------------------------------------------

_KINDS = {"ads": landing.CLASSIFIED, "market": landing.MARKET, "broker": landing.BROKER}
_X = sqltext.EXTRACTORS
_NO_RANGE = "NOT (source = 'ads' AND listing_id % 12 = 1)"
_TEXT_PARKING, _FIELD_PARKING = f"({_X['parking']})", "CASE WHEN listing_id % 7 = 0 THEN 'Included' END"


@query(
    "landed_listings",
    f"""SELECT concat(source, ':', source_id) AS listing_id,
  CASE source WHEN 'ads' THEN concat(name, ' | Site') WHEN 'market' THEN name ELSE CASE WHEN listing_id % 8 <> 0 THEN concat(100 + listing_id % 50, ' Main St') END END AS title,
  CASE WHEN listing_id % 8 <> 0 THEN concat(100 + listing_id % 50, ' Main St') WHEN source = 'ads' THEN 'Downtown' END AS address,
  CASE WHEN listing_id % 5 = 0 THEN 2150e0 WHEN listing_id % 5 = 2 AND source <> 'ads' THEN 1900e0 WHEN listing_id % 5 = 3 AND source = 'broker' THEN 1500e0 END AS rent,
  CASE WHEN {_NO_RANGE} THEN CASE listing_id % 4 WHEN 0 THEN 2e0 WHEN 2 THEN 3e0 END END AS beds,
  CASE WHEN {_NO_RANGE} THEN CASE WHEN listing_id % 6 = 0 AND source = 'ads' THEN 1050e0 WHEN listing_id % 6 = 1 THEN 777e0 END END AS area,
  CASE WHEN source = 'ads' THEN CAST({_X['floor']} AS DOUBLE) END AS floor,
  CASE source WHEN 'ads' THEN {_TEXT_PARKING} WHEN 'market' THEN CASE WHEN {_FIELD_PARKING} <> {_TEXT_PARKING} THEN NULL ELSE coalesce({_FIELD_PARKING}, {_TEXT_PARKING}) END ELSE CASE listing_id % 4 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'Included' END END AS parking,
  CASE WHEN source = 'market' THEN CASE WHEN {_FIELD_PARKING} <> {_TEXT_PARKING} THEN 'contradictory' WHEN coalesce({_FIELD_PARKING}, {_TEXT_PARKING}) IS NULL THEN 'not_stated' ELSE 'observed' END END AS parking_state,
  CASE WHEN source <> 'broker' THEN {_X['furnishing']} END AS furnishing, CASE WHEN source = 'market' THEN {_X['full_unit']} END AS full_unit,
  CASE WHEN listing_id % 9 <> 0 THEN 43.5e0 END AS lat, CASE WHEN listing_id % 5 < 3 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS photos,
  CASE WHEN source = 'ads' AND listing_id % 8 <> 0 THEN 'detail_page' ELSE 'source_field' END AS origin,
  CASE WHEN source = 'broker' THEN CASE WHEN listing_id % 8 <> 0 AND listing_id % 5 IN (0, 2, 3) THEN 'ok' ELSE 'degraded' END WHEN listing_id % 10 = 9 THEN 'failed' WHEN listing_id % 10 = 8 THEN 'degraded' ELSE 'ok' END AS liveness
FROM landed""",
    "landed",
)
def landed_listings(spark, d):
    out = landing.to_listings(landed(spark, d).drop("listing_id", "name", "description"), _KINDS)
    return out.select("listing_id", "title", "address", "rent", "beds", "area", "floor", "parking", "parking_state", "furnishing", "full_unit", "lat", "photos", "origin", "liveness")


@query(
    "landed_scores",
    "SELECT concat(source, ':', source_id) AS listing_id, CASE WHEN rent > 2000 THEN 'miss' WHEN rent IS NULL THEN 'unverified' ELSE 'match' END AS status, CASE WHEN photos THEN 1e2 ELSE 0e0 END AS score FROM (SELECT source, source_id, listing_id % 5 < 3 AS photos, CASE WHEN listing_id % 5 = 0 THEN 2150e0 WHEN listing_id % 5 = 2 AND source <> 'ads' THEN 1900e0 WHEN listing_id % 5 = 3 AND source = 'broker' THEN 1500e0 END AS rent FROM landed) x",
    "landed",
)
def landed_scores(spark, d):
    """From landed payloads to verdicts and scores."""
    out = landing.to_listings(landed(spark, d).drop("listing_id", "name", "description"), _KINDS).withColumn("area_key", F.lit(None).cast("string"))
    return rank.score(out, Rubric(rent_max=2000.0, weights={"photo.present": 2.0})).select("listing_id", "status", "score")


@query("feed_rows", "SELECT page_id, concat(name, ' & more') AS title, CAST(1234500000 + page_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (page_id % 9) AS posted, page_id % 9 < 4 AS dropped FROM fetched UNION ALL SELECT page_id, 'none', NULL, TIMESTAMP '1970-01-01 00:00:00', TRUE FROM fetched", "fetched")
def feed_rows(spark, d):
    return parsers.feed_items(fetched(spark, d).select("page_id", "feed"), "feed", "2024-01-05 00:00:00").select("page_id", "title", "id", "posted", "dropped")


@query("item_list_rows", "SELECT page_id, CAST(0 AS INT) AS ordinal, CAST(1234500000 + page_id AS VARCHAR) AS id, concat(name, ' & more') AS title, CASE page_id % 3 WHEN 1 THEN 1950e0 WHEN 2 THEN 1800.5e0 END AS price, CASE page_id % 2 WHEN 1 THEN 2e0 END AS beds, 700e0 AS area FROM fetched", "fetched")
def item_list_rows(spark, d):
    return parsers.item_lists(fetched(spark, d).select("page_id", "page"), "page").select("page_id", "ordinal", "id", "title", "price", "beds", "area")


@query("detail_nodes", "SELECT page_id, name, '1 Main' AS street FROM fetched", "fetched")
def detail_nodes(spark, d):
    return fetched(spark, d).select("page_id", parsers.detail_node(F.col("page")).alias("n")).select("page_id", "n.name", F.col("n.address.streetAddress").alias("street"))


@query(
    "api_rows",
    "SELECT CAST(page_id AS VARCHAR) AS id, name AS description, CASE page_id % 2 WHEN 0 THEN 2e0 ELSE 3e0 END AS beds, CASE page_id % 3 WHEN 0 THEN 2500e0 WHEN 1 THEN 2600e0 END AS price, concat(page_id, ' BLOOR STREET E, ', CASE page_id % 4 WHEN 1 THEN 'TORONTO (North), Ontario' ELSE 'Toronto' END) AS address, 43.5e0 AS lat, CAST(NULL AS DOUBLE) AS lng, 1 AS parking_spaces FROM fetched WHERE page_id % 4 IN (1, 3)",
    "fetched",
)
def api_rows(spark, d):
    return parsers.api_results(fetched(spark, d).select("answer"), "answer").select("id", "description", "beds", "price", "address", "lat", "lng", "parking_spaces")


@query("card_rows", "SELECT page_id, CAST(0 AS BIGINT) AS ordinal, concat('/c/', page_id) AS url, CASE page_id % 2 WHEN 0 THEN name ELSE name END AS title, concat('$', 1000 + page_id % 100) AS price FROM fetched", "fetched")
def card_rows(spark, d):
    return parsers.cards(fetched(spark, d).select("page_id", "cards"), "card", html_col="cards").select("page_id", "ordinal", "url", "title", "price")


@query(
    "ad_pages",
    f"""SELECT page_id, CASE page_id % 2 WHEN 0 THEN name ELSE 't' END AS title, '2024-01-02T00:00:00Z' AS posted,
  concat(description, ' ', CASE page_id % 5 WHEN 0 THEN 'Address: please contact' WHEN 1 THEN 'Address: 77 Queen Blvd' WHEN 2 THEN '12 Harbour Street near x' ELSE 'bye' END) AS description, '1br' AS source_attributes,
  CASE page_id % 3 WHEN 0 THEN 2150e0 WHEN 2 THEN 900e0 END AS price, CASE WHEN page_id % 4 = 0 THEN '9 King St' WHEN page_id % 5 = 1 THEN '77 Queen Blvd' WHEN page_id % 5 = 2 THEN '12 Harbour Street near x' END AS address,
  43.5e0 AS lat, CASE WHEN page_id % 6 <> 0 THEN -79.25e0 END AS lng, CAST(2 AS INT) AS photos, CASE WHEN page_id % 12 = 1 THEN NULL ELSE coalesce({_X['beds'].replace('listing_id', 'page_id')}, 1e0) END AS beds,
  {_X['parking'].replace('listing_id', 'page_id')} AS parking FROM fetched""",
    "fetched",
)
def ad_pages(spark, d):
    out = landing.classified_details(fetched(spark, d).select("page_id", F.col("ad").alias("html")))
    return out.select("page_id", "title", "posted", "description", "source_attributes", "price", "address", "lat", "lng", F.size("photos").alias("photos"), "beds", "parking")


# -- texts and pages --------------------------------------------------------------------------------------------------


def _extractor(name: str) -> None:
    @query(f"extract_{name}", f"SELECT listing_id, {sqltext.EXTRACTORS[name]} AS value FROM listing", "listing")
    def run(spark, d):
        rows = listing(spark, d)
        read = X.with_facts(rows.select("listing_id", X.listing_text(rows.columns).alias("text")), F.col("text"), name)
        return read.select("listing_id", F.col(f"facts.{name}").alias("value"))


for _name in X.EXTRACTORS:
    _extractor(_name)


@query("page_title_links", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS links, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1] AS first_link FROM pages")
def page_title_links(spark, d):
    return parsers.title_and_links(table(spark, d, "pages"))


@query("page_outcomes", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'removed' WHEN page_id % 5 = 0 THEN 'blocked' ELSE 'ok' END AS outcome FROM pages")
def page_outcomes(spark, d):
    """Pages with notices put before them; some only in a script, where no reader sees them."""
    notice = F.when(F.col("page_id") % 7 == 0, "<p>This posting has been <b>deleted</b></p>").otherwise("") 
    wall = F.when(F.col("page_id") % 5 == 0, "<div>Are you a robot?</div>").when(F.col("page_id") % 3 == 0, "<script>captcha()</script><!-- access denied -->").otherwise("")
    return table(spark, d, "pages").select("page_id", parsers.outcome(F.concat(notice, wall, "html")).alias("outcome"))


@query("redact_counts", sqltext.REDACT)
def redact_counts(spark, d):
    r = parsers.redacted(table(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "email", "phone", "postal", F.md5("text").alias("masked_md5"))


@query("url_slugs", r"SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/]+([^?#]*)', 1)), '[/_-]+', ' ', 'g')) AS slug FROM pages")
def url_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", S.slug_text(F.col("url")).alias("slug"))


_NEXT = "substr(h, 2 * {0} + 1, 1) NOT IN ('8', '9', 'A', 'B')"


@query(
    "bounded_text",
    f"""SELECT doc_id, length(h) > 2000 AS cut, md5(CASE WHEN length(h) <= 2000 THEN text ELSE decode(unhex(left(h, 2 * CASE WHEN {_NEXT.format(1000)} THEN 1000 WHEN {_NEXT.format(999)} THEN 999 WHEN {_NEXT.format(998)} THEN 998 ELSE 997 END))) END) AS text_md5
FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents) x""",
)
def bounded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.bounded_text(F.col("text"), 1000).alias("b")).select("doc_id", "b.cut", F.md5("b.text").alias("text_md5"))


def _results(spark, d):
    return view(spark, d, "results").withColumn("subject", F.col("subject").cast("string"))


@query("research_accepted", "SELECT CAST(subject AS VARCHAR) AS subject, url FROM results WHERE result_id % 9 <> 8 AND result_id % 11 <> 5", "results")
def research_accepted(spark, d):
    """Stale ones go, and those that the user has excluded."""
    r = _results(spark, d)
    return report.accepted(r, "2024-01-15", excluded=r.filter("result_id % 11 = 5")).select("subject", "url")


#: What each sentence of the stand-in results claims: section, scope, theme, polarity; the others are withheld or speak of nothing.
_CLAIMED = {
    "The tower was built in 1998 and has a large lobby.": (5, "building", "building", None, None),
    "Management has been responsive to repairs.": (0, "management", "building", "management responsiveness", "positive"),
    "The property manager is unresponsive.": (5, "management", "building", "management responsiveness", "negative"),
    "A grocery store is close to the entrance.": (4, "groceries", "nearby", "groceries", None),
    "The station is five minutes away.": (4, "services", "nearby", "transit", None),
    "No reported incidents near the park.": (0, "parks", "nearby", "parks", "positive"),
    "Police reported a theft in the lobby.": (0, "safety", "building", "security", "negative"),
    "The elevator was broken for weeks.": (0, "management", "building", "elevators", "negative"),
    "The gym is excellent and clean": (3, "gyms", "nearby", "gym", "positive"),
    "The elevators are reliable and": (0, "management", "building", "elevators", "positive"),
}


def _claimed() -> str:
    """Rows of what the phrases at their places claim. No subject fills a section: it has four results, each with one sentence of a list."""
    rows = []
    for phrases in REPORTED:
        for i, p in enumerate(phrases):
            if p in _CLAIMED:
                values = ", ".join("NULL" if v is None else repr(v) for v in _CLAIMED[p])
                rows.append(f"SELECT {len(phrases)} AS m, {i} AS i, '{p}' AS sentence, {values}")
    return f"""k(m, i, sentence, priority, section, scope, theme, polarity) AS ({' UNION ALL '.join(rows)}),
a AS (SELECT CAST(subject AS VARCHAR) AS subject, result_id, concat('C', row_number() OVER (PARTITION BY subject ORDER BY published_at DESC, title, url)) AS citation FROM results WHERE result_id % 9 <> 8),
c AS (SELECT subject, citation, k.* EXCLUDE (i) FROM a JOIN k ON a.result_id % k.m = k.i)"""


def _over_claims(sql: str) -> str:
    return f", {_claimed()}\n{sql}"


def _claims(spark, d):
    return report.claims(report.accepted(_results(spark, d), "2024-01-15"))


@query("research_claims", _over_claims("SELECT subject, citation, sentence, section, scope, theme, polarity FROM c"), "results")
def research_claims(spark, d):
    return _claims(spark, d).select("subject", "citation", "sentence", "section", "scope", "theme", "polarity")


@query("research_coverage", _over_claims("SELECT subject, section, count(*) AS claims, count(DISTINCT citation) AS sources FROM c GROUP BY subject, section"), "results")
def research_coverage(spark, d):
    return report.coverage(_claims(spark, d))


@query(
    "research_conflicts",
    _over_claims("""SELECT subject, section, theme, string_agg(DISTINCT citation, ',' ORDER BY citation) AS citations FROM c WHERE theme IS NOT NULL AND polarity IS NOT NULL GROUP BY subject, section, theme
  HAVING count(*) FILTER (polarity = 'positive') > 0 AND count(*) FILTER (polarity = 'negative') > 0 AND count(DISTINCT citation) > 1"""),
    "results",
)
def research_conflicts(spark, d):
    return report.conflicts(_claims(spark, d)).select("subject", "section", "theme", F.array_join("citations", ",").alias("citations"))


@query(
    "research_gaps",
    _over_claims("SELECT s.subject, u.section, CASE WHEN n IS NULL THEN 'none' ELSE 'one source' END AS gap FROM (SELECT DISTINCT subject FROM c) s CROSS JOIN (SELECT unnest(['building', 'management', 'services', 'groceries', 'gyms', 'parks', 'safety']) AS section) u LEFT JOIN (SELECT subject, section, count(DISTINCT citation) AS n FROM c GROUP BY subject, section) g ON g.subject = s.subject AND g.section = u.section WHERE n IS NULL OR n = 1"),
    "results",
)
def research_gaps(spark, d):
    return report.gaps(_claims(spark, d))


_NAMES = ["building", "management", "services", "groceries", "gyms", "parks", "safety"]


@query(
    "research_report",
    _over_claims(f""", q AS (SELECT subject, section, theme FROM c WHERE theme IS NOT NULL AND polarity IS NOT NULL GROUP BY ALL
  HAVING count(*) FILTER (polarity = 'positive') > 0 AND count(*) FILTER (polarity = 'negative') > 0 AND count(DISTINCT citation) > 1),
l AS (SELECT c.*, concat('- ', sentence, ' [', citation, ']', CASE WHEN q.theme IS NOT NULL AND polarity IS NOT NULL THEN ' (conflicting)' ELSE '' END) AS line FROM c LEFT JOIN q ON q.subject = c.subject AND q.section = c.section AND q.theme = c.theme),
p AS (SELECT subject, section, concat('## ', section, chr(10), string_agg(line, chr(10) ORDER BY citation, priority DESC, m)) AS text, count(*) AS n, count(DISTINCT citation) AS sources FROM l GROUP BY subject, section),
g AS (SELECT s.subject, string_agg(concat(u.section, CASE WHEN sources IS NULL THEN ' (none)' ELSE ' (one source)' END), ', ' ORDER BY u.section) AS gaps
  FROM (SELECT DISTINCT subject FROM c) s CROSS JOIN (SELECT unnest({_NAMES}) AS section) u LEFT JOIN p ON p.subject = s.subject AND p.section = u.section WHERE sources IS NULL OR sources = 1 GROUP BY s.subject)
SELECT p.subject, concat_ws(chr(10), string_agg(text, chr(10) ORDER BY list_position({_NAMES}, section)), 'Gaps: ' || any_value(gaps)) AS report, CAST(sum(n) AS BIGINT) AS claims FROM p LEFT JOIN g USING (subject) GROUP BY p.subject""").replace("\n, q AS", ", q AS"),
    "results",
)
def research_report(spark, d):
    return report.reports(report.accepted(_results(spark, d), "2024-01-15"))


@query("row_json", "SELECT '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json FROM nation")
def row_json(spark, d):
    return sinks.as_json(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("event_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return incremental.windowed_counts(table(spark, d, "events")).select("event_type", F.col("w.start").alias("hour"), "n")


from . import queries_found, queries_pages, queries_records  # noqa: E402, F401  (their queries register here)
