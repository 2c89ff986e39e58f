"""Queries about what is found: areas and places of listings, points of pages, addresses, results of searches, claims of distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import address, places, research
from ..session import spread
from ..sources import listings
from .queries import AS_OF, listing, query, table

_KEYWORD = "CASE WHEN p_partkey % 7 = 0 THEN concat(100 + p_partkey % 50, ' w') ELSE upper(substr(p_name, 2 + CAST(p_partkey % 3 AS INT), 4 + CAST(p_partkey % 5 AS INT))) END"


@query(
    "substring_area",
    f"""SELECT l.listing_id, arg_min(concat('area', p_partkey % 50), p_partkey) AS area_key FROM listing l LEFT JOIN (SELECT p_partkey, {_KEYWORD} AS keyword, 'x' AS x FROM part WHERE p_partkey % 5 = 2 OR p_partkey % 7 = 0) k
  ON contains(lower(concat_ws(' ', title, address)), lower(k.keyword)) GROUP BY l.listing_id""",
    "listing",
)
def substring_area(spark, d):
    """Keywords within words, by parts' names: all of them one automaton."""
    keyword = F.expr(_KEYWORD)
    k = table(spark, d, "part").filter("p_partkey % 5 = 2 or p_partkey % 7 = 0").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("area"), F.col("p_partkey") % 50).alias("key"), keyword.alias("keyword"))
    texts = listing(spark, d).select("listing_id", F.concat_ws(" ", "title", "address").alias("text"))
    return places.substring_area(texts, k, "text", "listing_id").select("listing_id", "area_key")


_PLACES = """SELECT c_custkey AS ordinal, (['gyms', 'groceries', 'parks', 'shopping', 'services', 'transit'])[CAST(c_custkey % 6 AS INT) + 1] AS category,
  CASE c_custkey % 11 WHEN 0 THEN ' ' WHEN 1 THEN 'Corner Shop' WHEN 2 THEN 'CORNER shop' ELSE concat('Place ', c_custkey % 400) END AS name,
  CAST(43.6 AS DOUBLE) + (c_custkey * 7 % 113) / CAST(1000 AS DOUBLE) AS lat, CAST(-79.4 AS DOUBLE) + (c_custkey * 13 % 71) / CAST(1000 AS DOUBLE) AS lng FROM customer"""
_KM = "2 * 6371.0e0 * asin(least(1.0e0, sqrt(power(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lng - q.lng) / 2), 2))))"


@query(
    "nearest_places",
    f""", p AS (SELECT *, lower(trim(name)) AS fold FROM ({_PLACES}) x WHERE trim(name) <> ''), q AS (SELECT DISTINCT lat, lng FROM listing WHERE lat IS NOT NULL),
m AS (SELECT q.lat, q.lng, category, fold, arg_min(name, ordinal) AS name, min(ordinal) AS ordinal, arg_min({_KM}, ordinal) AS d FROM q JOIN p ON {_KM} <= 1.5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lat, lng, category ORDER BY round(d, 2), ordinal) AS place FROM m)
SELECT listing_id, category, CAST(place AS INT) AS place, name, round(d, 2) AS distance_km FROM listing JOIN r USING (lat, lng) WHERE place <= 5""",
    "listing",
)
def nearest_places(spark, d):
    """The five nearest places of each category within 1.5 km of each listing."""
    found = table(spark, d, "customer")
    category = F.element_at(F.array(*map(F.lit, ("gyms", "groceries", "parks", "shopping", "services", "transit"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, " ").when(k % 11 == 1, "Corner Shop").when(k % 11 == 2, "CORNER shop").otherwise(F.concat(F.lit("Place "), k % 400))
    found = found.select(k.alias("ordinal"), category.alias("category"), name.alias("name"), (F.lit(43.6) + (k * 7 % 113) / F.lit(1000.0)).alias("lat"), (F.lit(-79.4) + (k * 13 % 71) / F.lit(1000.0)).alias("lng"))
    return places.nearest_places(listing(spark, d), found)


#: A page's blocks: a point below others in a list, two of them, one that is out of range before a good one, none.
_BLOCKS = """concat('<p>x</p><script type="application/ld+json">{"zone":{"geo":{"latitude":"', 40 + page_id % 9, '.5","longitude":', CASE page_id % 5 WHEN 0 THEN '-79.25' WHEN 1 THEN '"x"' WHEN 2 THEN '500' ELSE 'null' END,
  '}},"area":[1,{"deep":[{"longitude":-', page_id % 90, ',"latitude":43}]},{"latitude":1,"longitude":2}]}</script>')"""
_PAGE = f"""concat('<html>', CASE page_id % 4 WHEN 0 THEN '<script type="application/ld+json">not json</script>' WHEN 1 THEN '<script type="application/ld+json">{{"latitude":1}}</script>' ELSE '' END,
  CASE WHEN page_id % 3 <> 0 THEN {_BLOCKS} ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '<meta name="geo.position" content="45.25; -75.5">' ELSE '<meta name="geo.position" content="45.25">' END, '</html>')"""


@query(
    "page_points",
    f"""WITH t AS (SELECT page_id, {_PAGE} AS page FROM pages),
b AS (SELECT page_id, unnest(regexp_extract_all(page, '(?s)ld\\+json">(.*?)</script>', 1)) AS j FROM t),
n AS (SELECT page_id, x.id, x.value FROM (SELECT * FROM b WHERE json_valid(j)) v, json_tree(v.j) x WHERE x.type = 'OBJECT' AND json_exists(x.value, '$.latitude') AND json_exists(x.value, '$.longitude')),
c AS (SELECT page_id, id, TRY_CAST(value->>'$.latitude' AS DOUBLE) AS lat, TRY_CAST(value->>'$.longitude' AS DOUBLE) AS lng FROM n),
f AS (SELECT page_id, arg_min({{'lat': lat, 'lng': lng}}, id) AS p FROM c WHERE abs(lat) <= 90 AND abs(lng) <= 180 GROUP BY page_id)
SELECT t.page_id, CASE WHEN p IS NOT NULL THEN p.lat WHEN t.page_id % 2 = 0 THEN 45.25e0 END AS lat, CASE WHEN p IS NOT NULL THEN p.lng WHEN t.page_id % 2 = 0 THEN -75.5e0 END AS lng FROM t LEFT JOIN f USING (page_id)""",
)
def page_points(spark, d):
    """At any depth, the first in the order of the text, the meta tag last."""
    t = table(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("page"))
    return t.select("page_id", places.page_point(F.col("page")).alias("p")).select("page_id", "p.lat", "p.lng")


_MEASURED = "SELECT event_id, user_id AS listing_id, CASE WHEN event_type IN ('view', 'click') THEN 'gym' ELSE 'grocery' END AS attribute, floor(value / 100) AS km, ts FROM events"


@query(
    "geo_claims",
    f"SELECT event_id, listing_id, attribute, km FROM ({_MEASURED}) m WINDOW w AS (PARTITION BY listing_id, attribute ORDER BY ts, event_id) QUALIFY lag(event_id) OVER w IS NULL OR lag(km) OVER w IS DISTINCT FROM km",
)
def geo_claims(spark, d):
    """Measured distances are claimed only when they change."""
    return places.changes_only(_measured(spark, d), ["listing_id", "attribute"], "km", "ts", "event_id").select("event_id", "listing_id", "attribute", "km")


def _measured(spark, d):
    attribute = F.when(F.col("event_type").isin("view", "click"), "gym").otherwise("grocery")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("listing_id"), attribute.alias("attribute"), F.floor(F.col("value") / 100).cast("double").alias("km"), "ts")


@query("geo_latest", f"SELECT listing_id, max_by(km, ts) FILTER (WHERE attribute = 'gym') AS nearest_gym_km, max_by(km, ts) FILTER (WHERE attribute = 'grocery') AS nearest_grocery_km FROM ({_MEASURED}) m GROUP BY listing_id")
def geo_latest(spark, d):
    """The claims in force, a column for each attribute: what the log of changes says is what was measured last."""
    log = places.changes_only(_measured(spark, d), ["listing_id", "attribute"], "km", "ts", "event_id")
    of = lambda a: F.max_by(F.when(F.col("attribute") == a, F.col("km")), F.when(F.col("attribute") == a, F.struct("ts", "event_id")))
    return log.groupBy("listing_id").agg(of("gym").alias("nearest_gym_km"), of("grocery").alias("nearest_grocery_km"))


# -- addresses and results about them -----------------------------------------------------------------------------------------

_FULL = "concat(100 + listing_id % 50, CASE listing_id % 4 WHEN 0 THEN ' West Main Street' WHEN 1 THEN ' Queen Street East' WHEN 2 THEN ' Mill Road' ELSE ' North Harbour Avenue' END)"
_IDENTITY = "concat(100 + listing_id % 50, CASE listing_id % 4 WHEN 0 THEN '|main|street|west' WHEN 1 THEN '|queen|street|east' WHEN 2 THEN '|mill|road|' ELSE '|harbour|avenue|north' END)"
_TOKEN = "concat(100 + listing_id % 50, CASE listing_id % 4 WHEN 0 THEN ' west main' WHEN 1 THEN ' queen east' WHEN 2 THEN ' mill' ELSE ' north harbour' END)"


@query("address_identities", f"SELECT listing_id, {_FULL} AS subject, {_IDENTITY} AS identity, {_TOKEN} AS street FROM listing", "listing")
def address_identities(spark, d):
    """What a listing's address is in full, what tells it from others, and the words that name its street."""
    said = F.concat(F.lit("Flat at "), F.col("address"), F.lit("."))
    own = F.get(F.transform(address.addresses(said), address.identity), F.lit(0))
    return listing(spark, d).select("listing_id", address.subject(said).alias("subject"), own.alias("identity"), address.street_token(F.col("address"), ["toronto", "on"], []).alias("street"))


_SUBJECT = "concat(100 + CAST(floor(p_partkey / 8) AS INT), ' King St. W')"
#: Eight results of each subject, one of each kind; a title of each eleventh part is empty.
_FOUND = f"""SELECT {_SUBJECT} AS subject, 'Toronto' AS city, CAST(p_partkey % 2 AS INT) AS search, CAST(floor(p_partkey % 8 / 2) AS INT) AS place,
  CASE p_partkey % 8 WHEN 4 THEN 'ftp://x.example/4' WHEN 5 THEN concat('https://x.example/', p_partkey - 1 - 4) ELSE concat('https://x.example/', p_partkey) END AS url,
  CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS title,
  CASE p_partkey % 8 WHEN 0 THEN concat('Flats at ', {_SUBJECT}, ', Toronto.') WHEN 1 THEN concat(100 + CAST(floor(p_partkey / 8) AS INT), ' west king street, toronto') WHEN 2 THEN concat({_SUBJECT}, ' and 12 Main Street, Toronto')
    WHEN 6 THEN concat({_SUBJECT}, ' in Ottawa') ELSE concat('Toronto: ', {_SUBJECT}) END AS excerpt,
  CASE p_partkey % 8 WHEN 3 THEN '2020-01-01' WHEN 7 THEN 'last week' ELSE '2023-12-24' END AS published FROM part"""


@query(
    "research_outcomes",
    """SELECT subject, outcome, count(*) AS n FROM (SELECT concat(100 + CAST(floor(p_partkey / 8) AS INT), ' King St. W') AS subject,
  CASE p_partkey % 8 WHEN 4 THEN 'skipped' WHEN 5 THEN 'repeat' WHEN 3 THEN 'stale' WHEN 7 THEN 'stale' ELSE CASE WHEN p_partkey % 11 = 0 THEN 'untitled' WHEN p_partkey % 8 IN (2, 6) THEN 'irrelevant' ELSE 'accepted' END END AS outcome FROM part) t GROUP BY ALL""",
)
def research_outcomes(spark, d):
    found = spark.sql(_FOUND.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    return research.outcomes(found, AS_OF).groupBy("subject", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("research_order", "SELECT subject, string_agg(CAST(result_id AS VARCHAR), ',' ORDER BY published_at DESC, source, title, result_id) AS ordered FROM results GROUP BY subject", "results")
def research_order(spark, d):
    """The results of a subject in the order in which they are shown: a bounded array, no sort of the whole table."""
    from .queries import view

    r = view(spark, d, "results")
    key = F.struct((-F.unix_date("published_at")).alias("newest"), "source", "title", "result_id")
    return r.groupBy("subject").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.result_id.cast("string")), ",").alias("ordered"))


# -- brokers' pages -------------------------------------------------------------------------------------------------------------

_BROKER = """concat('<div id="listingPriceValue">$', 2000 + p_partkey % 900, '/Monthly</div>', CASE WHEN p_partkey % 6 <> 0 THEN concat('<h1 id="listingAddress"><span>', p_partkey % 90 + 1, ' BAY ST</span><span>Toronto</span></h1>') ELSE '' END,
  '<div id="BedroomIcon"><span class="listingCardIconNum">', CASE p_partkey % 3 WHEN 0 THEN '2 + 1' WHEN 1 THEN '3' ELSE 'n/a' END, '</span></div><section id="PropertyDescription"><h2>Listing Description</h2><p>', p_name, ' &amp; more.</p></section>',
  '<div id="propertyDetailsSectionVal_MaintenanceManagementCompany"><span>Company</span><span>', p_brand, '</span></div><img src="https://p.example/', p_partkey, '"><img src="data:x">')"""
_CARDS = """concat('<article class="listingCard"><a class="listingDetailsLink" href="/real-estate/', p_partkey, '/x"><span class="listingCardPrice">$1,', 100 + p_partkey % 900, '/Monthly</span><span class="listingCardAddress">', p_name, ', Toronto</span><span class="listingCardIconNum">', CASE p_partkey % 2 WHEN 0 THEN '2 + 1' ELSE '3' END,
  '</span><span class="listingCardIconNum">1</span><span class="listingCardIconNum">', 500 + p_partkey % 300, '+</span></a>', CASE p_partkey % 4 WHEN 0 THEN concat('<a data-value="', p_partkey, '_43.5_-79.25_1"></a>') WHEN 1 THEN '<a data-value="1_x_500_1"></a>' ELSE '' END, '</article><article class="listingCard"><a class="listingDetailsLink" href="/about">x</a></article>')"""


@query(
    "broker_pages",
    """SELECT p_partkey AS page_id, concat(p_partkey % 90 + 1, ' BAY ST, Toronto') AS address, CAST(2000 + p_partkey % 900 AS DOUBLE) AS price, CASE p_partkey % 3 WHEN 0 THEN 2e0 WHEN 1 THEN 3e0 END AS beds, concat(p_name, ' & more.') AS description, p_brand AS management, concat('https://p.example/', p_partkey) AS photo
FROM part WHERE p_partkey % 6 <> 0""",
)
def broker_pages(spark, d):
    pages = spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(_BROKER).alias("html"))
    return listings.broker_details(pages).select("page_id", "address", "price", "beds", "description", "management", F.array_join("photos", ",").alias("photo"))


@query(
    "broker_cards",
    """SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS id, CAST(1100 + p_partkey % 900 AS DOUBLE) AS price, concat(p_name, ', Toronto') AS address, CASE p_partkey % 2 WHEN 0 THEN 2e0 ELSE 3e0 END AS beds, 1e0 AS baths, CAST(500 + p_partkey % 300 AS DOUBLE) AS area, CASE p_partkey % 4 WHEN 0 THEN 43.5e0 END AS lat, CASE p_partkey % 4 WHEN 0 THEN -79.25e0 END AS lng FROM part""",
)
def broker_cards(spark, d):
    """Icons' numbers and markers of a search page's cards; a card that leads to no listing is none."""
    pages = spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.expr(_CARDS).alias("html"))
    return listings.broker_cards(pages).select("page_id", "id", "price", "address", "beds", "baths", "area", "lat", "lng")
