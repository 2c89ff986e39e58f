"""Addresses in texts, chains of enrichers, runs, profiles and feedback."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom import config
from factloom.model import Range, Scaled
from factloom.operators import address, report, review
from factloom.plans import chain


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


PLACES, PREFIXES = ["vancouver", "bc", "burnaby", "v6b"], ["north", "west"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2400 W Boulevard, Vancouver", "2400 west"), ("Wall Centre, Vancouver", "wall centre"), ("4189 Halifax Street, Burnaby", "4189 halifax"), ("Vancouver BC", ""), ("", ""), (None, ""), ("Vancouver House 101", "vancouver house 101"),
        ("12 Main St, North Vancouver", "12 main north"), ("12 E Main St, North Vancouver, BC V7M 1A1", "12 east main"), ("1011-66 Cordova (corner of X & Y)", "1011-66 cordova corner of x y"), ("315 1st Ave East", "315 1st east"),
        ("V6B1A1 12 Main", "v6b1a1 12 main"), ("bc vancouver 12 main", "bc 12 main"),
    ],
)
def test_street_token(spark, text, want):
    assert value(spark, address.street_token(F.lit(text).cast("string"), PLACES, PREFIXES)) == want


def test_addresses(spark):
    ids = lambda t: value(spark, F.transform(address.addresses(F.lit(t)), address.identity))
    assert ids("See 585 Bloor St. E, Toronto, or 12 King's Court.") == ["585|bloor|street|east", "12|king's|court|"]
    assert ids("at 585 East Bloor Street") == ids("585 bloor street EAST") and ids("none here 5") == []
    sub = lambda t: value(spark, address.subject(F.lit(t)))
    assert sub("unit at 100 w 2nd  ave in town") == "100 West 2nd Avenue" and sub("nowhere") is None and sub("12-16 Main Street") is None
    about = lambda *t: value(spark, address.about(F.lit("585 Bloor St E"), F.lit("Toronto"), *map(F.lit, t)))
    assert about("585 Bloor Street East, Toronto", "nice") and not about("585 Bloor Street East", "Toronto is near")
    assert not about("585 Bloor St E, Toronto", "like 12 Main St") and not about("Toronto", "")


def rows(spark):
    return spark.createDataFrame([("a", 2.0, "user", 1.0, None, None, None), ("b", None, None, None, "x", "text_rule", 0.9), ("c", 1.0, "vision", 0.9, None, None, None)], "listing_id string, beds double, beds_origin string, beds_confidence double, note string, note_origin string, note_confidence double")


def claim(field, value):
    return lambda df: df.select("listing_id", F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(0.6).alias("confidence"))


def test_chain(spark):
    e = chain.Enricher("beds", ("beds",), claim("beds", "3"))
    n = chain.Enricher("note", ("note",), claim("note", "y"), requires=("beds",))
    assert [x.name for x in chain.ordered([n, e])] == ["beds", "note"]
    got = {r.listing_id: (r.beds, r.beds_origin, r.note) for r in chain.run_chain(rows(spark), [n, e]).collect()}
    assert got == {"a": (2.0, "user", "y"), "b": (3.0, "text_rule", "x"), "c": (3.0, "text_rule", "y")}
    with pytest.raises(ValueError):
        chain.ordered([chain.Enricher("p", ("p",), claim("p", ""), requires=("q",)), chain.Enricher("q", ("q",), claim("q", ""), requires=("p",))])


def test_chain_costs(spark):
    paid = chain.Enricher("beds", ("beds",), claim("beds", "3"), cost=2.0)
    with pytest.raises(chain.UncappedSpend):
        chain.run_chain(rows(spark), [paid])
    with pytest.raises(chain.SpendDeclined):
        chain.run_chain(rows(spark), [paid], chain.Budget(cap=9.0))
    with pytest.raises(chain.SpendExceeded):
        chain.run_chain(rows(spark), [paid], chain.Budget(cap=3.0, confirm=lambda x: True))
    b = chain.Budget(cap=9.0, confirm=lambda x: x == 4.0)
    assert chain.run_chain(rows(spark), [paid], b).count() == 3 and b.spent == 4.0  # two rows may be enriched


def test_runs_profiles_feedback(spark):
    e = spark.createDataFrame([("r1", "start", "2024-01-01 00:00:00", None), ("r1", "finish", "2024-01-01 00:01:00", "{}"), ("r1", "finish", "2024-01-01 00:02:00", "{1}"), ("r2", "start", "2024-01-02 00:00:00", None)], "run string, kind string, at string, counts string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.run: (r.counts, r.seconds) for r in review.run_rows(e).collect()} == {"r1": ("{1}", 120), "r2": (None, None)}
    now = hashlib.sha256(b"{}").hexdigest()
    current = spark.createDataFrame([("p", "{}", "t")], "profile_id string, profile string, city string")
    asked = spark.createDataFrame([("p", "old", "{1}", "t", 1), ("p", now, "{2}", "v", 2), ("p", now, "{3}", "t", 3), ("p", now, "{4}", "t", 4), ("q", now, "{}", "t", 5)], "profile_id string, expected string, profile string, city string, seq int")
    got = {r.seq: (r.outcome, r.revision) for r in review.profile_writes(current, asked).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "conflict", 2: "other_city", 3: "written", 4: "conflict", 5: "unknown"} and got[3][1] == hashlib.sha256(b"{3}").hexdigest()
    assert [r.seq for r in review.history(asked, "p", 2).collect()] == [4, 3]
    f = spark.createDataFrame([("s", "u1", "k", "bad", 1), ("s", "u1", "k", None, 2), ("s", "u2", "k", "bad", 1), ("s", "u3", "old", "bad", 9)], "subject string, url string, key string, verdict string, seq int")
    assert {(r.url, r.verdict) for r in review.feedback(f, f.filter("key = 'k'")).collect()} == {("u2", "bad")}


def test_profiles():
    r = config.rubric('{"city": "t", "rent_max": 2000, "beds": {"min": 1}, "weights": {"photo.present": 2, "rent.headroom": {"rate": 1, "cap": 5}}, "areas": ["a"], "require_parking": true}')
    assert (r.rent_max, r.beds, r.weights, r.areas, r.require_parking) == (2000.0, Range(min=1.0), {"photo.present": 2.0, "rent.headroom": Scaled(1.0, 5.0)}, ("a",), True)
    for text, at in (("[", "<root>"), ("[]", "<root>"), ('{"rent_max": "x"}', "rent_max"), ('{"beds": {"most": 1}}', "beds"), ('{"weights": {"a": {"rate": 1}}}', "weights.a.cap"), ('{"rentmax": 1}', "rentmax")):
        with pytest.raises(ValueError, match=f"at {at}"):
            config.rubric(text)
    assert config.weights_of_answers({"gym": "nice", "pets": "indifferent", "quiet": "avoid"}, {"gym": "g", "pets": "p", "quiet": "q"}) == {"g": 6.0, "q": -8.0}
    assert config.consistent('{"city": "T ", "area_key_weights": {"x": 1, "y": 2}}', "t", {"x"}) == ["no area y"]
    with pytest.raises(ValueError):
        config.consistent('{"city": "u"}', "t", set())


def test_areas(spark):
    name, boxes, words = config.areas(spark, '{"name": "T", "areas": [{"key": "a", "bbox": [1, 2, 3, 4], "keywords": ["liberty village", " "]}]}')
    assert name == "T" and tuple(boxes.first()) == ("a", "a", 2.0, 1.0, 4.0, 3.0) and [tuple(r) for r in words.collect()] == [("liberty village", "a")]
    with pytest.raises(ValueError, match="areas.0.bbox"):
        config.areas(spark, '{"name": "T", "areas": [{"key": "a", "bbox": [3, 2, 1, 4]}]}')


def test_galleries(spark):
    g = spark.createDataFrame([("a", ["https://1", "https://1", "http://2", "https://3"]), ("b", []), ("c", ["https://4"]), ("d", ["https://5"])], "listing_id string, photo_urls array<string>")
    one = spark.createDataFrame([("a", "https://3"), ("c", "https://9")], "listing_id string, selected string")
    assert {(r.listing_id, r.at, r.photo) for r in report.scanned(g, one).collect()} == {("a", 0, "https://3"), ("d", 0, "https://5")}
    assert report.scanned(g, most=1).count() == 3
    p = spark.createDataFrame([("a", "https://1", "not_candidate"), ("a", "https://3", "candidate"), ("c", "https://4", "unavailable")], "listing_id string, photo string, status string")
    assert {r.listing_id: (r.status, r.truncated) for r in report.gallery_status(g, p).collect()} == {"a": ("candidate", True), "b": ("empty", False), "c": ("unavailable", False), "d": ("error", True)}
    an = spark.createDataFrame([("a", 1, True, "h1", ["p1"]), ("a", 2, False, "h2", []), ("b", 1, False, "h", ["p"])], "listing_id string, at int, usable boolean, gallery_hash string, hashes array<string>")
    de = spark.createDataFrame([("a", "yes", "h1", "p1"), ("b", "no", "old", "gone"), ("z", "no", "h", None)], "listing_id string, decision string, gallery_hash string, selected string")
    got = {r.listing_id: (r.gallery_hash, r.newer_outcome, r.gallery_changed, r.selection_changed) for r in report.floor_plan_state(an, de).collect()}
    assert got == {"a": ("h1", True, False, False), "b": ("h", False, True, True), "z": (None, None, True, False)}
