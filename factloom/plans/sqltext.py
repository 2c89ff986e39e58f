"""Oracle texts in the dialect of DuckDB, written by hand."""

from __future__ import annotations

from .views import SAYINGS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: What each phrase of the stand-in descriptions states; those that aren't named state nothing.
_STATES: dict[str, dict[str, str]] = {
    "in_suite_laundry": {"Bright suite with in-suite laundry.": "TRUE", "W/D in the suite.": "TRUE", "Own laundry.": "TRUE"},
    "building_laundry": {"Shared laundry in the building.": "TRUE", "Coin-op laundry.": "TRUE"},
    "parking": {
        "Parking stall included.": "'Included'", "No parking.": "'Unavailable'", "Parking available.": "'Available'", "Parking & locker included.": "'Included'", "No off-street parking.": "'Unavailable'",
        "Parking can be rented.": "'Available'", "1 covered car port.": "'Available'", "No dedicated parking included.": "'Unavailable'",
    },
    "pets": {"Pet friendly.": "'friendly'", "No pets please.": "'no_pets'", "Pets considered.": "'conditional'", "Dogs welcome.": "'friendly'", "Small animals with approval.": "'conditional'"},
    "lease_months": {"12 month lease.": "12", "One-year lease.": "12", "4 months lease.": "4"},
    "available_date": {"Available: 2024-05-01.": "DATE '2024-05-01'", "Available from 2024-07-15.": "DATE '2024-07-15'"},
    "available_words": {"Available immediately.": "'Available immediately'", "Move-in date March 3.": "'Move-in date March 3'"},
    "total_monthly": {"Total monthly cost: $3,450 per month.": "3450e0", "Monthly total $2900.": "2900e0"},
    "rent": {"Rent is $2,150/mo.": "2150e0"},
    "basement": {"Basement suite with separate entrance.": "TRUE", "Garden-level suite.": "TRUE"},
    "density": {"Steps from shops, in the heart of town.": "'walkable'", "On a tree-lined street, residential area.": "'sparse'"},
    "walk_score": {"Walk score: 88.": "88"},
    "beds": {"2 bedrooms, 1.5 baths, 850 sq ft.": "2e0", "3br / 2ba, 1100 square feet.": "3e0"},
    "baths": {"2 bedrooms, 1.5 baths, 850 sq ft.": "1.5e0", "3br / 2ba, 1100 square feet.": "2e0"},
    "area_sqft": {"2 bedrooms, 1.5 baths, 850 sq ft.": "850e0", "3br / 2ba, 1100 square feet.": "1100e0"},
    "den": {"Den and solarium.": "TRUE"},
    "gym": {"Building gym.": "TRUE"},
    "gym_near": {"Next to the gym.": "TRUE"},
    "grocery_near": {"Close to a grocery store.": "TRUE"},
    "utilities": {
        "Heat and water included.": "'heat,water'", "All utilities included.": "'all'", "Utilities included.": "'unspecified'", "Electric included.": "'electricity'", "Rent includes heat and WiFi.": "'heat,internet'",
        "Heat, water, and hydro included.": "'heat,water,hydro'",
    },
    "floor": {"On the 3rd floor.": "3", "Level 9.": "9", "Second floor.": "2", "Eleventh floor.": "11"},
    "furnishing": {"Fully furnished.": "'Furnished'", "Furnished: no.": "'Unfurnished'", "Can be unfurnished.": "'Unfurnished'"},
    "full_unit": {"Room for rent.": "FALSE", "Entire apartment.": "TRUE"},
}
_TYPES = {"lease_months": "INT", "walk_score": "INT", "floor": "INT"}


def _stated(states: dict[str, str], kind: str | None) -> str:
    """By the place of the phrase in its list: nothing of the text is read."""
    cases = [f"WHEN listing_id % {len(phrases)} = {i} THEN {states[p]}" for phrases in SAYINGS for i, p in enumerate(phrases) if p in states]
    case = "CASE " + " ".join(cases) + " END"
    return f"CAST({case} AS {kind})" if kind else case


EXTRACTORS = {name: _stated(states, _TYPES.get(name)) for name, states in _STATES.items()}

# -- verdicts: x has the facts, c a status for each criterion, v the verdicts -------------------------------------------

_NUM = "format('{:,}', CAST(round({0}) AS BIGINT))"


def _short(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


_FACTS = "x AS (SELECT *, nullif(trim(area_key), '') AS ak, lower(trim(furnishing)) AS fk, " + ", ".join(f"{sql} AS x_{k}" for k, sql in EXTRACTORS.items()) + " FROM listing)"

#: field: (status, reason of a miss, reason of an unknown), in the order of the checks; basement and furnishing give no unknown reason.
CRITERIA = {
    "rent": ("CASE WHEN rent IS NULL THEN 'unknown' WHEN currency <> 'CAD' OR period <> 'month' THEN 'unknown' WHEN rent < 1600 OR rent > 3000 THEN 'fail' ELSE 'pass' END",
             f"CASE WHEN rent > 3000 THEN concat('rent $', {_NUM.replace('{0}', 'rent')}, ' > max $3,000') WHEN rent < 1600 THEN concat('rent $', {_NUM.replace('{0}', 'rent')}, ' < min $1,600') END", "CASE WHEN rent IS NULL THEN 'rent unstated' END"),
    "beds": ("CASE WHEN beds IS NULL THEN 'unknown' WHEN beds < 1 OR beds > 3 THEN 'fail' ELSE 'pass' END", f"CASE WHEN beds < 1 THEN concat('beds ', {_short('beds')}, ' < min 1') WHEN beds > 3 THEN concat('beds ', {_short('beds')}, ' > max 3') END", "CASE WHEN beds IS NULL THEN 'beds unstated' END"),
    "baths": ("CASE WHEN baths IS NULL THEN 'unknown' WHEN baths < 1 THEN 'fail' ELSE 'pass' END", f"CASE WHEN baths < 1 THEN concat('baths ', {_short('baths')}, ' < min 1') END", "CASE WHEN baths IS NULL THEN 'baths unstated' END"),
    "area": ("CASE WHEN area IS NULL OR area_unit <> 'sqft' THEN 'unknown' WHEN area < 300 THEN 'fail' ELSE 'pass' END", f"CASE WHEN area_unit = 'sqft' AND area < 300 THEN concat('area ', {_NUM.replace('{0}', 'area')}, ' < min 300 sqft') END", "CASE WHEN area IS NULL THEN 'area unstated' WHEN area_unit <> 'sqft' THEN concat('area in ', area_unit, ', profile uses sqft') END"),
    "floor": ("CASE WHEN floor IS NULL THEN 'unknown' WHEN floor > 12 THEN 'fail' ELSE 'pass' END", f"CASE WHEN floor > 12 THEN concat('floor ', {_short('floor')}, ' > max 12') END", "CASE WHEN floor IS NULL THEN 'floor unstated' END"),
    "neighbourhood": ("CASE WHEN ak IS NULL THEN 'unknown' WHEN ak NOT IN ('harbour', 'midtown', 'eastside') THEN 'fail' ELSE 'pass' END", "CASE WHEN ak NOT IN ('harbour', 'midtown', 'eastside') THEN 'area not in allowed list' END", "CASE WHEN ak IS NULL THEN 'area unknown' END"),
    "basement": ("CASE WHEN x_basement THEN 'fail' ELSE 'unknown' END", "CASE WHEN x_basement THEN 'basement unit' END", "NULL"),
    "furnishing": ("CASE WHEN fk IS NULL THEN 'unknown' WHEN contains(fk, 'unfurnished') OR contains(fk, 'optional') THEN 'pass' WHEN contains(fk, 'furnished') THEN 'fail' ELSE 'unknown' END", "CASE WHEN NOT contains(fk, 'unfurnished') AND NOT contains(fk, 'optional') AND contains(fk, 'furnished') THEN 'furnished only' END", "NULL"),
    "in_suite_laundry": ("CASE WHEN x_in_suite_laundry IS NULL THEN 'unknown' ELSE 'pass' END", "NULL", "CASE WHEN x_in_suite_laundry IS NULL THEN 'in-suite laundry unstated' END"),
    "parking": ("CASE WHEN x_parking IS NULL THEN 'unknown' WHEN x_parking = 'Unavailable' THEN 'fail' ELSE 'pass' END", "CASE WHEN x_parking = 'Unavailable' THEN 'parking required' END", "CASE WHEN x_parking IS NULL THEN 'parking unstated' END"),
    "lease_months": ("CASE WHEN x_lease_months IS NULL THEN 'unknown' WHEN x_lease_months < 6 THEN 'fail' ELSE 'pass' END", "CASE WHEN x_lease_months < 6 THEN 'lease months outside requirement' END", "CASE WHEN x_lease_months IS NULL THEN 'lease months unstated' END"),
    "total_monthly": ("CASE WHEN x_total_monthly IS NULL THEN 'unknown' WHEN x_total_monthly > 3200 THEN 'fail' ELSE 'pass' END", "CASE WHEN x_total_monthly > 3200 THEN 'total monthly cost outside requirement' END", "CASE WHEN x_total_monthly IS NULL THEN 'total monthly cost unstated' END"),
    "available_date": ("CASE WHEN x_available_date IS NULL THEN 'unknown' WHEN x_available_date > DATE '2024-06-30' THEN 'fail' ELSE 'pass' END", "CASE WHEN x_available_date > DATE '2024-06-30' THEN 'available after 2024-06-30' END", "CASE WHEN x_available_date IS NULL THEN 'availability date unstated' END"),
}
_ODD = "CASE WHEN rent IS NOT NULL AND (currency <> 'CAD' OR period <> 'month') THEN 'rent currency or period needs verification' END"
_CHECKED = f"""c AS (SELECT *, {', '.join(f"{s} AS s_{k}" for k, (s, _, _) in CRITERIA.items())},
  concat_ws('|', {', '.join(m for _, m, _ in CRITERIA.values())}) AS misses, concat_ws('|', {', '.join(u for _, _, u in CRITERIA.values())}, {_ODD}) AS unknowns FROM x),
w AS (SELECT *, concat_ws('|', {', '.join(f"'{k}:' || s_{k}" for k in CRITERIA)}) AS checks, CASE WHEN misses <> '' THEN 'miss' WHEN unknowns <> '' THEN 'unverified' ELSE 'match' END AS status FROM c),
v AS (SELECT *, CASE WHEN 'fail' IN ({', '.join(f"s_{k}" for k in CRITERIA)}) THEN 'miss' WHEN 'unknown' IN ({', '.join(f"s_{k}" for k in CRITERIA)}) THEN 'unverified' ELSE status END AS evidence_status, status <> 'miss' AS eligible FROM w)
"""


def over_verdict(sql: str) -> str:
    return f", {_FACTS}, {_CHECKED}{sql}"


VERDICT = over_verdict("SELECT listing_id, checks, misses, unknowns, status, evidence_status, eligible FROM v")
#: Eligibility under the other rubric: no failed criterion among those that it keeps.
OTHER_ELIGIBLE = (
    "NOT coalesce(rent < 1600 OR rent > 2600, FALSE) AND NOT coalesce(beds < 2, FALSE) AND s_baths <> 'fail' AND s_area <> 'fail' AND s_floor <> 'fail' AND s_basement <> 'fail' AND s_furnishing <> 'fail'"
    " AND s_lease_months <> 'fail' AND s_total_monthly <> 'fail' AND s_available_date <> 'fail'"
)

# -- scores -------------------------------------------------------------------------------------------------------------


def _km(lat: str, lng: str) -> str:
    half = f"power(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * power(sin(radians({lng} - lng) / 2), 2)"
    return f"2 * 6371e0 * asin(least(1e0, sqrt({half})))"


def _flag(test: str, weight: float) -> str:
    return f"CASE WHEN {test} THEN {weight}e0 * 1e0 * 0.6e0 ELSE 0e0 END"


#: rule: (category, least, most, contribution)
_TERMS = {
    "laundry.in_suite": ("amenities", 0, 12, _flag("x_in_suite_laundry", 12)),
    "laundry.building": ("amenities", 0, 4, _flag("x_building_laundry", 4)),
    "floor.low": ("space", 0, 6, "CASE WHEN coalesce(floor, x_floor) >= 1 THEN 6e0 * greatest(0e0, least(1e0, 1e0 / (1 + (coalesce(floor, x_floor) - 1) / 3e0))) ELSE 0e0 END"),
    "walk.score": ("proximity", 0, 5, "CASE WHEN x_walk_score IS NOT NULL THEN 5e0 * greatest(0e0, least(1e0, CAST(x_walk_score AS DOUBLE))) * 0.6e0 ELSE 0e0 END"),
    "space.den_or_solarium": ("space", 0, 5, _flag("x_den", 5)),
    "amenities.gym_building": ("amenities", 0, 3, _flag("x_gym", 3)),
    "proximity.gym_nearby": ("proximity", 0, 2, _flag("x_gym_near", 2)),
    "proximity.grocery_nearby": ("proximity", 0, 4, _flag("x_grocery_near", 4)),
    "density.walkable": ("proximity", 0, 6, _flag("x_density = 'walkable'", 6)),
    "density.sparse": ("proximity", -3, 0, _flag("x_density = 'sparse'", -3)),
    "parking.available": ("amenities", 0, 8, _flag("x_parking <> 'Unavailable'", 8)),
    "pets.allowed": ("amenities", 0, 5, "CASE x_pets WHEN 'friendly' THEN 5e0 * 1e0 * 0.6e0 WHEN 'conditional' THEN 5e0 * 0.5e0 * 0.6e0 ELSE 0e0 END"),
    "photo.present": ("evidence", 0, 2, "CASE WHEN photos > 0 THEN 2e0 ELSE 0e0 END"),
    "area.over_minimum": ("space", 0, 9, "CASE WHEN area_unit = 'sqft' AND area > 300 THEN greatest(-9e0, least(9e0, (area - 300e0) / 1e2 * 1.5e0)) ELSE 0e0 END"),
    "rent.headroom": ("cost", 0, 6, "CASE WHEN currency = 'CAD' AND rent < 3000 THEN greatest(-6e0, least(6e0, (3000e0 - rent) / 1e2 * 0.5e0)) ELSE 0e0 END"),
    "location.area_key": ("proximity", -4, 6, "CASE ak WHEN 'harbour' THEN 6e0 WHEN 'midtown' THEN 3e0 WHEN 'old-mill' THEN -4e0 ELSE 0e0 END"),
    "landmark.distance": ("proximity", 0, 7, f"7e0 * coalesce(CASE WHEN lat IS NOT NULL THEN greatest(0e0, 1 - {_km('43.65e0', '-79.38e0')} / 5e0) END, 0e0)"),
    "confidence.unverified": ("amenities", -4, 0, "CASE WHEN status = 'unverified' THEN -4e0 ELSE 0e0 END"),
}
#: What the terms are called.
LABEL = "CASE rule_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {
    "laundry.in_suite": "In-suite laundry", "laundry.building": "Building laundry", "floor.low": "Low floor", "walk.score": "Walk score", "space.den_or_solarium": "Den or solarium",
    "amenities.gym_building": "Gym in the building", "proximity.gym_nearby": "Gym nearby", "proximity.grocery_nearby": "Grocery nearby", "density.walkable": "Walkable", "density.sparse": "Sparse",
    "parking.available": "Parking", "pets.allowed": "Pets", "photo.present": "Photos", "area.over_minimum": "Area over the minimum", "rent.headroom": "Rent headroom", "location.area_key": "Area preference",
    "landmark.distance": "Near Central station", "confidence.unverified": "Missing criteria facts",
}.items()) + " END"
_LO, _HI = sum(t[1] for t in _TERMS.values()), sum(t[2] for t in _TERMS.values())


def over_score(sql: str) -> str:
    total = " + ".join(f"({t[3]})" for t in _TERMS.values())
    return over_verdict(f", s AS (SELECT listing_id, eligible, greatest(0e0, least(1e2, 1e2 * (total - {_LO}) / {_HI - _LO}e0)) AS score FROM (SELECT *, {total} AS total FROM v) y)\n{sql}")


def over_terms(sql: str) -> str:
    rows = " UNION ALL ".join(f"SELECT listing_id, {i} AS i, '{k}' AS rule_key, '{t[0]}' AS category, CAST({t[2]} AS DOUBLE) AS max_possible, {t[3]} AS contribution FROM v" for i, (k, t) in enumerate(_TERMS.items()))
    return over_verdict(f", t AS ({rows})\n{sql}")


HAVERSINE = f"""SELECT source, listing_id, km, CAST(place AS INT) AS place FROM (SELECT source, listing_id, round(km, 6) AS km, row_number() OVER (PARTITION BY source ORDER BY round(km, 6), listing_id) AS place
  FROM (SELECT *, {_km('43.65e0', '-79.38e0')} AS km FROM listing WHERE lat IS NOT NULL) x) t WHERE place <= 5"""

# -- signatures: fixed values ---------------------------------------------------------------------------------------------------------


#: Fixed values of the stand-in's signatures.
_FULL = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
_LEFT_OUT = "'st', 'street', 'ave', 'avenue', 'rd', 'road', 'dr', 'drive', 'blvd', 'boulevard', 'way', 'lane', 'ln', 'court', 'ct', 'vancouver', 'bc', 'ca', 'canada'"


def _signed(c: str) -> str:
    expand = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FULL.items()) + " ELSE w END"
    marks = ",.;:/\\|()[]{}!?#+&*'\""
    plain = f"translate(lower({c}), {_q(marks)}, '{' ' * len(marks)}')"
    some = f"list_transform(list_filter(string_split_regex({plain}, '\\s+'), lambda w: w <> ''), lambda w: {expand})"
    return f"nullif(array_to_string(list_slice(list_filter({some}, lambda w: w NOT IN ({_LEFT_OUT}) AND NOT regexp_matches(replace(w, '-', ''), '^([a-z][0-9][a-z]([0-9][a-z][0-9])?|[0-9][a-z][0-9])$')), 1, 6), ' '), '')"


def over_signature(sql: str) -> str:
    name = f"CASE WHEN trim(coalesce(address, '')) <> '' THEN {_signed('address')} ELSE {_signed('title')} END"
    return f", g AS (SELECT *, concat(coalesce({name}, 'listing'), '|', CAST(round_even(coalesce(CAST(trunc(rent) AS BIGINT), 0) / 25.0e0, 0) * 25 AS BIGINT)) AS signature FROM listing)\n{sql}"


# -- health -------------------------------------------------------------------------------------------------------------


def _bands(rows: str) -> str:
    return f"""SELECT source, count(*) AS runs, median(n) AS median,
  CASE WHEN count(*) >= 3 THEN CAST(CASE WHEN median(n) <= 0 THEN 0 ELSE greatest(1, floor(median(n) * 0.6e0)) END AS BIGINT) END AS low,
  CASE WHEN count(*) >= 3 THEN CAST(CASE WHEN median(n) <= 0 THEN 0 ELSE ceil(median(n) * 1.6e0) END AS BIGINT) END AS high FROM ({rows}) q GROUP BY source"""


_PLACED = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS r FROM runs"
BANDS = _bands(f"SELECT * FROM ({_PLACED}) z WHERE r <= 5")
WATERMARK = f""", a AS (SELECT source, n AS now, newest AS candidate FROM ({_PLACED}) z WHERE r = 1), b AS (SELECT * FROM ({_PLACED}) z WHERE r BETWEEN 2 AND 6),
k AS ({_bands('SELECT * FROM b WHERE r <= 6')}), m AS (SELECT source, max(newest) AS watermark FROM b GROUP BY source),
d AS (SELECT a.source, now, low, high, candidate, watermark, low IS NULL OR now BETWEEN low AND high AS in_band, watermark IS NULL OR candidate > watermark AS newer FROM a LEFT JOIN k ON k.source = a.source LEFT JOIN m ON m.source = a.source)
SELECT source, now, in_band, newer, in_band AND newer AS advance, now = 0 AND low > 0 AS alert, CASE WHEN in_band AND newer THEN candidate ELSE watermark END AS next_watermark FROM d"""

#: Row by row: what is accepted holds its signature from then on.
#: Two runs; ids change their signature.
DEDUPE = """WITH e AS (SELECT event_id % 700 AS id, (event_id % 700 + event_id // 1000) % 150 AS sig, event_id AS seq, event_type <> 'error' AS ok, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS run FROM events),
f1 AS (SELECT sig, min(seq) AS since FROM e WHERE run = 1 AND ok GROUP BY sig),
o1 AS (SELECT id, sig, seq, CASE WHEN since IS NULL OR seq < since THEN 'exclude' WHEN seq = since THEN 'accept' ELSE 'repeat' END AS outcome FROM e LEFT JOIN f1 USING (sig) WHERE run = 1),
s AS (SELECT id, arg_max(sig, seq) AS sig FROM o1 WHERE outcome = 'accept' GROUP BY id),
k AS (SELECT e.*, CASE WHEN id IN (SELECT id FROM s) THEN 'refresh' WHEN sig IN (SELECT sig FROM s) THEN 'touch' END AS known FROM e WHERE run = 2),
f2 AS (SELECT sig, min(seq) AS since FROM k WHERE known IS NULL AND ok GROUP BY sig),
o2 AS (SELECT id, sig, seq, coalesce(known, CASE WHEN since IS NULL OR seq < since THEN 'exclude' WHEN seq = since THEN 'accept' ELSE 'repeat' END) AS outcome FROM k LEFT JOIN f2 USING (sig))
SELECT CAST(1 AS INT) AS run, outcome, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_at FROM o1 GROUP BY outcome UNION ALL SELECT CAST(2 AS INT), outcome, count(*), CAST(sum(seq) AS BIGINT) FROM o2 GROUP BY outcome"""


#: What is masked, by label, in this order.
_MASKED = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "phone": "\\+?[0-9]?[ .-]?\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}", "postal": "\\b[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]\\b"}


def _redacted() -> str:
    t, counts = "text", []
    for label, pattern in _MASKED.items():
        counts.append(f"CAST(len(regexp_extract_all({t}, {_q(pattern)})) AS BIGINT) AS {label}")
        t = f"regexp_replace({t}, {_q(pattern)}, '[{label}]', 'g')"
    return f"SELECT doc_id, {', '.join(counts)}, md5({t}) AS masked_md5 FROM documents"


REDACT = _redacted()
