"""Where a listing is: its area by keywords, the places near it, the point that its page gives."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import parsers

#: How far a place may be, and how many of a category are named.
NEAR_KM, PER_CATEGORY = 1.5, 5
#: Bytes of keywords that are sent to every executor as one automaton.
AUTOMATON_BYTES = 8 << 20


# -- areas by keywords ----------------------------------------------------------------------------------------------------


def _least_said(words: dict[str, int]):
    """An Arrow function from texts to the least number of a word in each, by an Aho-Corasick automaton of all words: a text is
    passed once, whatever their number. It is built once in each Python worker."""
    built: list = []

    def automaton():
        if not built:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, n in words.items():
                a.add_word(w, n)
            a.make_automaton()
            built.append(a)
        return built[0]

    def run(texts: pa.Array) -> pa.Array:
        a = automaton() if words else None
        return pa.array([min((n for _, n in a.iter(t)), default=None) if t and a else None for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")


def substring_area(texts: DataFrame, keywords: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """texts with area_key: of the areas with a keyword that is anywhere in the text (whatever the case), the one that comes
    first in the city's file. keywords: ordinal (of the area in the file), key, keyword. An empty keyword is in every text but an
    empty one; null texts are empty.

    Up to AUTOMATON_BYTES of keywords are one automaton; beyond that, texts meet keywords by an equi-join on the keyword's
    first GRAM characters, and what meets is tested."""
    k = keywords.filter(F.col("keyword").isNotNull()).groupBy(F.lower("keyword").alias("keyword")).agg(F.min(F.struct("ordinal", "key")).alias("area")).select("keyword", "area.*")
    t = F.lower(F.coalesce(texts[text_col], F.lit("")))
    always = k.filter("keyword = ''").first()
    k = k.filter("keyword <> ''")
    if (k.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0) <= AUTOMATON_BYTES:
        rows = k.collect()
        least = _least_said({r.keyword: r.ordinal for r in rows})(t)
        found = texts.withColumn("__least", least)
        names = texts.sparkSession.createDataFrame(sorted({(r.ordinal, r.key) for r in rows}), "__least long, __key string")
        out = found.join(names, "__least", "left")
    else:
        out = texts.join(_least_by_grams(texts.select(id_col, t.alias("t")), k, id_col), id_col, "left")
    if always is not None:
        first = (t != "") & (F.col("__least").isNull() | (F.col("__least") > F.lit(always.ordinal)))
        out = out.withColumn("__key", F.when(first, F.lit(always.key)).otherwise(F.col("__key")))
    return out.withColumnRenamed("__key", "area_key").drop("__least")


#: Characters by which texts and keywords meet where no automaton can hold the keywords.
GRAM = 4


def _least_by_grams(texts: DataFrame, k: DataFrame, id_col: str) -> DataFrame:
    """Texts are known by id_col. A keyword that is shorter than GRAM is met by its own length."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - n + 1)), lambda i: F.substr("t", i, F.lit(n)))
    grams = F.array_distinct(F.flatten(F.array(*map(runs, range(1, GRAM + 1)))))
    met = texts.filter("t <> ''").select(id_col, "t", F.explode(grams).alias("gram")).join(k.withColumn("gram", F.substring("keyword", 1, GRAM)), "gram")
    one = F.min(F.struct("ordinal", "key")).alias("x")
    return met.filter(F.contains("t", "keyword")).groupBy(id_col).agg(one).select(id_col, F.col("x.ordinal").alias("__least"), F.col("x.key").alias("__key"))


# -- places near points -----------------------------------------------------------------------------------------------------


def _height(km: float) -> float:
    """Degrees of latitude of a band: a little more than km."""
    return math.degrees(km / S.EARTH_KM) * 1.000001


def _cells_of(band: Column, km: float) -> Column:
    """How many cells a band of latitude has, each at least as wide as two points within km can be apart in longitude, if one of
    them is in this band (then the other is in it, or in one beside it)."""
    height = _height(km)
    farthest = F.greatest(F.abs((band - 1) * height - 90), F.abs((band + 2) * height - 90))
    widest = F.cos(F.radians(F.least(F.lit(90.0), farthest)))
    reach = F.when(widest <= math.sin(km / (2 * S.EARTH_KM)), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(km / (2 * S.EARTH_KM)) / widest))))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach * 1.000001))).cast("int")


def _cell(lng: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lng + 180, F.lit(360.0)) / (F.lit(360.0) / cells)).cast("int"), cells - 1)


def nearest_places(points: DataFrame, places: DataFrame, id_col: str = "listing_id", km: float = NEAR_KM, most: int = PER_CATEGORY) -> DataFrame:
    """id_col, category, place (1 to most), name, distance_km: the places nearest to each point, within km.

    points: id_col, lat, lng. places: ordinal, category, name, lat, lng; of places with one category and name (whatever the case)
    near a point, the one of the least ordinal stands for all; equal distances (to 10 m) go by ordinal. Rows without a point,
    a category or a name are left out.

    The earth is cut into bands of latitude as high as km, and bands into cells that are as wide. A place is in one cell; a point
    meets the nine around it, so this is an equi-join, at the poles and at 180 degrees too. Different points are joined, not
    listings, and places that repeat at one spot are one: a building with many units costs as much as one unit. Of what is
    met, ranks are cut before they are shuffled."""
    band = lambda lat: F.floor((lat + 90) / _height(km)).cast("int")
    spots = places.filter("lat is not null and lng is not null and category is not null and trim(name) <> ''").withColumn("fold", F.lower(F.trim("name")))
    spots = spots.groupBy("category", "fold", "lat", "lng").agg(F.min(F.struct("ordinal", "name")).alias("one")).select("category", "fold", F.col("lat").alias("plat"), F.col("lng").alias("plng"), "one.*")
    spots = spots.withColumn("band", band(F.col("plat"))).withColumn("cell", _cell(F.col("plng"), _cells_of(F.col("band"), km)))
    q = points.filter("lat is not null and lng is not null").select("lat", "lng").distinct()
    q = q.withColumn("band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: band(F.col("lat")) + i))).withColumn("cells", _cells_of(F.col("band"), km))
    beside = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.pmod(_cell(F.col("lng"), F.col("cells")) + i, F.col("cells")))
    q = q.withColumn("cell", F.explode(F.array_distinct(beside))).drop("cells")
    met = q.join(spots, ["band", "cell"]).withColumn("d", S.haversine_km(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng"))).filter(F.col("d") <= km)
    named = met.groupBy("lat", "lng", "category", "fold").agg(F.min(F.struct("ordinal", "name", F.round("d", 2).alias("distance_km"))).alias("one")).select("lat", "lng", "category", "one.*")
    w = Window.partitionBy("lat", "lng", "category").orderBy("distance_km", "ordinal")
    top = named.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return points.select(id_col, "lat", "lng").join(top, ["lat", "lng"]).select(id_col, "category", "place", "name", "distance_km")


# -- claims of distances ------------------------------------------------------------------------------------------------------


def changes_only(measured: DataFrame, key: list[str], value: str, at: str, order: str, span: str = "day") -> DataFrame:
    """The rows of measured whose value isn't that of the row before (by at, order) with the same key: what an append-only log
    takes, if it takes a value only when it has changed. The first of a key is taken; null is a value.

    Rows are ordered within a key and a span of time; only the first of a span has to know the last of the span before it, and
    these are one row for each span. So no key's whole history is sorted in one task."""
    part = [*key, "__span"]
    m = measured.withColumn("__span", F.date_trunc(span, at))
    now, before = F.struct(F.col(value).alias("v")), F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*part).orderBy(at, order))
    last = m.groupBy(*part).agg(F.max_by(now, F.struct(at, order)).alias("__last"))
    last = last.withColumn("__ended", F.lag("__last").over(Window.partitionBy(*key).orderBy("__span"))).drop("__last")
    last = last.select(*(F.col(c).alias(f"__of_{c}") for c in part), "__ended")
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in part]
    out = m.withColumn("__before", before).join(last, same, "left").filter(~F.coalesce("__before", "__ended").eqNullSafe(now))
    return out.select(*measured.columns)


# -- the point of a page ----------------------------------------------------------------------------------------------------

_POINT = "struct<lat:double,lng:double>"


def _coordinate(x: object, most: float) -> float | None:
    try:
        n = float(x)  # a number, or a text that reads as one
    except (TypeError, ValueError):
        return None
    return n if abs(n) <= most else None


def _point_in(node: object) -> dict | None:
    """Of the objects that have a latitude and a longitude, the first in the order of the text whose point is one. Within such an
    object nothing else is looked for. A stack instead of recursion: depth is bounded by memory only."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict) and "latitude" in x and "longitude" in x:
            lat, lng = _coordinate(x["latitude"], 90), _coordinate(x["longitude"], 180)
            if lat is not None and lng is not None:
                return {"lat": lat, "lng": lng}
        elif isinstance(x, dict | list):
            stack.extend(reversed(list(x.values()) if isinstance(x, dict) else x))
    return None


def page_point(html: Column) -> Column:
    """struct(lat, lng) of a page: from its JSON-LD blocks, at any depth, else from the meta tag geo.position; null without one.
    The order of members decides between several points, which Spark's VARIANT doesn't keep, so blocks are parsed in an Arrow function."""

    def run(blocks: pa.Array) -> pa.Array:
        out = []
        for texts in blocks.to_pylist():
            point = None
            for t in texts or []:
                try:
                    point = _point_in(json.loads(t))
                except (ValueError, RecursionError):
                    continue
                if point:
                    break
            out.append(point)
        return pa.array(out, pa.struct([("lat", pa.float64()), ("lng", pa.float64())]))

    tag = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bname=[\"']geo\.position[\"'][^>]*>", 0)
    said = F.split(F.regexp_extract(tag, r"(?is)\bcontent=[\"']([^\"']*)[\"']", 1), ";")
    lat, lng = (F.trim(F.get(said, F.lit(i))).try_cast("double") for i in (0, 1))
    good = (F.size(said) == 2) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
    return F.coalesce(F.arrow_udf(run, _POINT)(parsers.json_ld(html)), F.when(good, F.struct(lat.alias("lat"), lng.alias("lng"))))
