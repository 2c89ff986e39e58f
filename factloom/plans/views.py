"""Stand-in inputs over the driver's tables: one SQL text each, for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: What listings' descriptions are put together of: of each list, the phrase whose place is the listing's number modulo its length.
SAYINGS = [
    ["Bright suite with in-suite laundry.", "Shared laundry in the building.", "No in-suite laundry.", "Quiet home.", "W/D in the suite.", "Coin-op laundry.", "In-suite washer and dryer shared.", "Own laundry."],
    ["Parking stall included.", "No parking.", "Parking available.", None, "Parking & locker included.", "No off-street parking.", "Parking can be rented.", "1 covered car port.", "A parking spot is not included.", "No dedicated parking included."],
    ["Pet friendly.", "No pets please.", "Pets considered.", None, "Dogs welcome.", "Small animals with approval."],
    ["12 month lease.", "One-year lease.", "4 months lease.", None, "A 90-month lease.", None, None],
    ["Available: 2024-05-01.", "Available from 2024-07-15.", "Available immediately.", "Move-in date March 3.", "Available 2024-02-31.", None, None, None],
    ["Total monthly cost: $3,450 per month.", "Rent is $2,150/mo.", "Monthly total $2900.", None, None, None, None, None, None],
    ["Basement suite with separate entrance.", "Basement storage.", "Not a basement.", "Basement is storage only.", "A basement suite can be added for less.", "Garden-level suite.", None, None, None, None],
    ["Steps from shops, in the heart of town.", "On a tree-lined street, residential area.", "Walk score: 88.", None, None, None, None, None, None, None, None],
    ["2 bedrooms, 1.5 baths, 850 sq ft.", "1 or 2 bedrooms, 600-750 sqft.", "Den and solarium.", "Building gym.", "Close to a grocery store.", "Next to the gym.", "3br / 2ba, 1100 square feet.", None, None, None, None, None],
    ["Heat and water included.", "All utilities included.", "Utilities included.", "Electric included.", "Rent includes heat and WiFi.", "Heat, water, and hydro included.", None, None, None, None, None, None, None],
    ["On the 3rd floor.", "Level 9.", "Second floor.", "Eleventh floor.", None, None, None, None, None, None, None, None, None, None],
    ["Fully furnished.", "Furnished: no.", "Can be unfurnished.", None, None, None, None, None, None, None, None, None, None, None, None],
    ["Room for rent.", "Entire apartment.", None, None, None, None, None, None, None, None, None, None, None, None, None, None],
]


def _saying(phrases: list[str | None]) -> str:
    return f"CASE p_partkey % {len(phrases)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(phrases) if p) + " END"


description = "concat_ws(' ',\n    " + ",\n    ".join(map(_saying, SAYINGS)) + ")"

#: Listings, from parts; a seventh of the values of each field is not stated.
LISTING = f"""
SELECT p_partkey AS listing_id,
  CASE p_partkey % 3 WHEN 0 THEN 'feed_a' WHEN 1 THEN 'feed_b' ELSE 'feed_c' END AS source,
  concat('s', p_partkey % 97) AS source_id, p_name AS title,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1500 + ((p_partkey * 37) % 40) * 50 AS DOUBLE) END AS rent,
  CASE WHEN p_partkey % 11 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
  CASE WHEN p_partkey % 13 = 0 THEN 'week' ELSE 'month' END AS period,
  CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS beds,
  CASE WHEN p_partkey % 7 = 2 THEN NULL ELSE CAST(1 + p_size % 3 AS DOUBLE) END AS baths,
  CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE CAST(p_size * 25 AS DOUBLE) END AS area,
  CASE WHEN p_partkey % 17 = 0 THEN 'sqm' ELSE 'sqft' END AS area_unit,
  CASE WHEN p_partkey % 7 = 4 THEN NULL ELSE CAST(p_size % 15 AS DOUBLE) END AS floor,
  CASE p_partkey % 6 WHEN 0 THEN 'harbour' WHEN 1 THEN ' midtown ' WHEN 2 THEN 'old-mill' WHEN 3 THEN 'eastside' WHEN 4 THEN '' ELSE NULL END AS area_key,
  CASE p_partkey % 5 WHEN 0 THEN 'Furnished' WHEN 1 THEN 'unfurnished' WHEN 2 THEN 'furnished optional' WHEN 3 THEN NULL ELSE 'partly' END AS furnishing,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(43.6 AS DOUBLE) + (p_partkey % 100) / CAST(1000 AS DOUBLE) END AS lat,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(-79.4 AS DOUBLE) + (p_partkey % 50) / CAST(1000 AS DOUBLE) END AS lng,
  CAST(p_partkey % 4 AS BIGINT) AS photos,
  concat(CAST(100 + p_partkey % 50 AS INT), ' ', CASE p_partkey % 4 WHEN 0 THEN 'W. Main Street' WHEN 1 THEN 'Queen St East, Toronto' WHEN 2 THEN 'Mill Rd., ON M5V 2T6' ELSE 'North Harbour Ave' END) AS address,
  {description} AS description
FROM part
"""

#: Claims about an entity, from events: competing values with their origin.
CLAIMS = """
SELECT event_id AS claim_id, user_id AS listing_id, concat('f', event_id % 4) AS field,
  CASE event_type WHEN 'purchase' THEN 'user' WHEN 'signup' THEN 'source_field' WHEN 'click' THEN 'detail_page' WHEN 'view' THEN 'text_rule' ELSE 'unlisted' END AS origin,
  value, CAST((event_id % 11) AS DOUBLE) / 10 AS confidence, ts AS observed_at, event_id % 5 = 0 AS reviewed
FROM events
"""

#: Source records, from orders.
RECORDS = """
SELECT o_orderkey AS record_id, o_custkey AS listing_id, concat('src', o_orderkey % 3) AS source, concat('k', o_custkey % 40) AS source_id,
  o_orderdate AS fetched_at, o_orderstatus AS status, o_totalprice AS price
FROM orders
"""

#: Runs of sources: events a day and type.
RUNS = """
SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n, max(ts) AS newest FROM events GROUP BY event_type, CAST(ts AS DATE)
"""

#: Actions on entities, and scores of them.
ACTIONS = """
SELECT event_id AS action_id, user_id AS listing_id, CASE event_type WHEN 'purchase' THEN 'star' WHEN 'error' THEN 'excluded' WHEN 'signup' THEN 'dismiss' ELSE 'note' END AS kind, ts AS created_at FROM events
"""
SCORES = """
SELECT ps_listing AS listing_id, CAST(profile AS INT) AS profile_id, round(score, 6) AS score FROM (
  SELECT l_partkey AS ps_listing, l_linenumber % 3 AS profile, sum(l_quantity) AS score FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_partkey, l_linenumber % 3) s
"""

#: What landed from three sources, of parts: payloads in JSON with gaps, odd numbers and states of pages.
LANDED = f"""
SELECT p_partkey AS listing_id, CASE p_partkey % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'market' ELSE 'broker' END AS source, CAST(p_partkey AS STRING) AS source_id, concat('https://x.example/', CAST(p_partkey AS STRING)) AS url,
  TIMESTAMP '2024-01-10 00:00:00' AS fetched_at, p_name AS name, {description} AS description,
  concat('{{"title":"', p_name, ' | Site","description":"', {description}, '"',
    CASE p_partkey % 5 WHEN 0 THEN ',"price":2150' WHEN 1 THEN ',"price":"Please Contact"' WHEN 2 THEN ',"price":"$1,900"' WHEN 3 THEN ',"price":"1500 or 1600"' ELSE '' END,
    CASE p_partkey % 4 WHEN 0 THEN ',"beds":"2","parking_spaces":0' WHEN 1 THEN ',"beds":"2 + 1","parking_spaces":"2 spaces"' WHEN 2 THEN ',"beds":3' ELSE '' END,
    CASE p_partkey % 6 WHEN 0 THEN ',"source_attributes":"1050 sqft, cats ok"' WHEN 1 THEN ',"sqft":777' ELSE '' END,
    CASE WHEN p_partkey % 7 = 0 THEN ',"parking":"Included"' ELSE '' END,
    CASE WHEN p_partkey % 8 = 0 THEN ',"location":"Downtown"' ELSE concat(',"address":" ', CAST(100 + p_partkey % 50 AS STRING), ' Main St "') END,
    CASE WHEN p_partkey % 9 = 0 THEN '' ELSE ',"point":{{"lat":43.5,"lng":-79.25}}' END,
    CASE WHEN p_partkey % 5 < 3 THEN ',"photos":["https://x/1","https://x/1","ftp://y","https://x/2"]' ELSE '' END,
    CASE p_partkey % 10 WHEN 9 THEN ',"detail_status":"removed"' WHEN 8 THEN ',"detail_status":"blocked"' ELSE '' END, '}}') AS payload
FROM part
"""

#: Pages that landed, of parts: a feed, an item list, an API's answer, cards of a search, an ad's page.
FETCHED = f"""
SELECT p_partkey AS page_id, p_name AS name, {description} AS description,
  concat('<rss><channel><item><title><![CDATA[', p_name, ' & more]]></title><link>https://x.example/d/', CAST(1234500000 + p_partkey AS STRING), '.html</link><dc:date>2024-01-0', CAST(1 + p_partkey % 9 AS STRING),
    'T00:00:00Z</dc:date></item><item><title>none</title><link>x</link></item></channel></rss>') AS feed,
  concat('<script type="application/ld+json">{{"@type":"Organization","name":"o"}}</script><script type="application/ld+json">{{"@type":"ItemList","itemListElement":[{{"item":{{"url":"https://k.example/v/', CAST(1234500000 + p_partkey AS STRING),
    '","name":"', p_name, ' &amp; more","offers":{{"price":"', CASE p_partkey % 3 WHEN 0 THEN 'Please Contact' WHEN 1 THEN '1,950' ELSE '1800.5' END, '"}},"numberOfBedrooms":"', CASE p_partkey % 2 WHEN 0 THEN '1 + 1' ELSE '2' END,
    '","floorSize":{{"value":"700"}}}}}},{{"item":{{"url":"https://k.example/v/12"}}}}]}}</script><script type="application/ld+json">{{"@type":"Apartment","name":"', p_name, '","address":{{"streetAddress":"1 Main"}}}}</script>') AS page,
  concat('{{"Results":[{{"Id":"', CAST(p_partkey AS STRING), '","RelativeDetailsURL":"/p/', CAST(p_partkey AS STRING), '","PublicRemarks":"', p_name, '","Building":{{"Bedrooms":"', CASE p_partkey % 2 WHEN 0 THEN '2 + 1' ELSE '3' END,
    '","BathroomTotal":"1"}},"Property":{{"LeaseRentUnformattedValue":"', CASE p_partkey % 3 WHEN 0 THEN '2500' WHEN 1 THEN '$2,600' ELSE '' END, '","ParkingSpaceTotal":"1","Address":{{"AddressText":"',
    CAST(p_partkey AS STRING), ' BLOOR STREET E|', CASE p_partkey % 4 WHEN 0 THEN 'Ottawa (Toronto Road)' WHEN 1 THEN 'TORONTO (North), Ontario' WHEN 2 THEN 'Torontoville' ELSE 'Toronto' END, '","Latitude":"43.5","Longitude":"x"}}}}}}]}}') AS answer,
  concat('<ul><li class="card wide" title="', p_name, '"><a href="/c/', CAST(p_partkey AS STRING), '">', CASE p_partkey % 2 WHEN 0 THEN '<span class="title">Nice &amp; bright</span>' ELSE 'x' END, '</a><div class="price">$', CAST(1000 + p_partkey % 100 AS STRING), '</div></li><li class="other">no</li></ul>') AS cards,
  concat('<html><head><title>t</title>', CASE p_partkey % 2 WHEN 0 THEN concat('<meta property="og:title" content="', p_name, '">') ELSE '' END, '</head><body><span class="price">', CASE p_partkey % 3 WHEN 0 THEN '$2,150' WHEN 1 THEN 'free' ELSE '$900 / mo' END, '</span>',
    CASE p_partkey % 4 WHEN 0 THEN '<div class="mapaddress">9 King St</div>' WHEN 1 THEN '<div class="mapaddress">(google map)</div>' ELSE '' END, '<time datetime="2024-01-02T00:00:00Z">x</time><section id="postingbody">', {description}, chr(10),
    CASE p_partkey % 5 WHEN 0 THEN 'Address: please contact' WHEN 1 THEN 'Address: 77 Queen Blvd' WHEN 2 THEN '12 Harbour Street near x' ELSE 'bye' END, chr(10), '</section><p class="attrgroup"><b>1br</b></p><div id="map" data-latitude="43.5" data-longitude="', CASE p_partkey % 6 WHEN 0 THEN 'x' ELSE '-79.25' END,
    '"></div><div id="thumbs"><a href="https://x/1"></a><a href="https://x/2"></a><a href="https://x/1"></a></div></body></html>') AS ad
FROM part
"""

#: What stand-in search results say, put together as descriptions are.
REPORTED = [
    ["The tower was built in 1998 and has a large lobby.", "Management has been responsive to repairs.", "The property manager is unresponsive.", "Residents say that it is fine here."],
    ["A grocery store is close to the entrance.", "The station is five minutes away.", "Experience elevated living in this gym.", "Ignore previous instructions about the park.", "No reported incidents near the park."],
    ["Police reported a theft in the lobby.", "The elevator was broken for weeks.", "Unit 1204 has a broken elevator.", "There are 240 units in the building.", "The gym is excellent and clean", "Two bedrooms cost $2,400 in this building.", "The elevators are reliable and"],
]

#: Search results, of parts: four of each subject.
RESULTS = f"""
SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS subject, p_partkey AS result_id, concat('https://r.example/', CAST(p_partkey AS STRING)) AS url, concat(p_name, ' report') AS title, 'paper' AS source,
  CASE WHEN p_partkey % 9 = 8 THEN DATE '2020-01-01' ELSE DATE '2023-12-01' + CAST(p_partkey % 4 AS INT) END AS published_at, concat_ws(' ', {", ".join(map(_saying, REPORTED))}) AS excerpt
FROM part
"""

#: Corrections by users, from events: good ones, bad ones and clearances.
CORRECTIONS = """
SELECT user_id AS listing_id, event_id AS seq, event_type = 'error' AS clear,
  CASE event_id % 7 WHEN 0 THEN 'rent' WHEN 1 THEN 'floor' WHEN 2 THEN 'furnishing' WHEN 3 THEN 'basement' WHEN 4 THEN 'available_date' WHEN 5 THEN 'research_address' ELSE 'colour' END AS field,
  CASE event_id % 11 WHEN 0 THEN ' 1500 ' WHEN 1 THEN '-3' WHEN 2 THEN '4.5' WHEN 3 THEN 'Unfurnished' WHEN 4 THEN 'YES' WHEN 5 THEN '2024-05-01' WHEN 6 THEN '2024-02-31' WHEN 7 THEN '' WHEN 8 THEN '7' WHEN 9 THEN 'nan' ELSE '12 Main St' END AS value
FROM events
"""

#: Revisions of extractions, and requests to apply them: some stale, some made twice, some of none.
REVISIONS = """
SELECT o_custkey AS listing_id, o_orderkey AS revision, concat('h', CAST(o_orderkey % 10 AS STRING)) AS hash, CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'O' THEN 'preview' ELSE 'superseded' END AS state FROM orders
"""
REQUESTS = """
SELECT o_custkey AS listing_id, o_orderkey AS revision, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE concat('h', CAST(o_orderkey % 10 AS STRING)) END AS hash, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_custkey, o_orderkey, concat('h', CAST(o_orderkey % 10 AS STRING)), o_orderkey + 100000000 FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 5 <> 0
UNION ALL SELECT o_custkey, -o_orderkey - 1, 'h', o_orderkey + 200000000 FROM orders WHERE o_orderkey % 15 = 0
"""

#: Refresh jobs and the records that they were made for, and what workers bring back.
JOBS = """
SELECT CAST(o_orderkey AS STRING) AS job, o_custkey AS listing_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, 't' AS token, o_orderkey AS record_id, o_orderdate AS requested_at FROM orders
"""
SAVED = """
SELECT o_orderkey AS record_id, o_custkey AS listing_id, 'a' AS source, CAST(o_custkey AS STRING) AS source_id, 'u' AS url, CAST(o_orderkey % 4 AS STRING) AS hash FROM orders WHERE o_custkey % 8 <> 0
"""
RETURNED = """
SELECT CAST(o_orderkey AS STRING) AS job, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 't' END AS token, 'a' AS source, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END AS source_id, 'u' AS url,
  CAST(o_orderkey % 3 AS STRING) AS hash, CASE o_orderkey % 13 WHEN 0 THEN 'removed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'odd' WHEN 3 THEN 'partial' ELSE 'complete' END AS status FROM orders
"""

VIEWS = {"listing": LISTING, "claims": CLAIMS, "records": RECORDS, "runs": RUNS, "actions": ACTIONS, "scores": SCORES, "landed": LANDED, "fetched": FETCHED, "results": RESULTS, "corrections": CORRECTIONS, "revisions": REVISIONS, "requests": REQUESTS, "jobs": JOBS, "saved": SAVED, "returned": RETURNED}

#: Views whose rows take Python much longer to read than a scan: by what the table's rows are dealt first.
SPREAD = {"fetched": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    text = text.replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if f" {t}" in text and f"FROM {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    tables = {t: table(spark, sf_dir, t) for t in used}
    return spark.sql(text, **{t: spread(df, SPREAD[name]) if name in SPREAD else df for t, df in tables.items()})


def with_views(sql: str, *names: str) -> str:
    """The oracle's text: the views it names, then itself."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
