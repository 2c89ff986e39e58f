"""Landed records to listings: one projection for all sources, over the records' payloads (JSON).

A record has source, source_id, url, fetched_at and payload. Payloads of a source may lack any field; numbers are read
leniently, and what is no number states nothing. Facts of the text are read once a row. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from . import parsers

#: Kinds of sources, by their records' shape; photos that are kept of a listing, and bytes of its texts.
CLASSIFIED, MARKET, BROKER = "classified", "market", "broker"
MOST_PHOTOS, MOST_TEXT = 50, 20_000
PAYLOAD = (
    "struct<title:string,address:string,location:string,price:string,beds:string,baths:string,sqft:string,area_sqft:string,description:string,source_attributes:string,posted:string,"
    "point:struct<lat:double,lng:double>,photos:array<string>,parking:string,parking_spaces:string,management:string,structuredLocation:string,removed:boolean,detail_status:string,detail_error:string>"
)


def _text(c: Column) -> Column:
    """Trimmed; an empty one is none."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_title(title: Column) -> Column:
    """Without a trailing `| site` or ` - site` part, white space squeezed."""
    return _text(F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"\s*[|]\s*[^|]*$", ""))


def photo_list(urls: Column) -> Column:
    """Different addresses over https, in order, MOST_PHOTOS at most."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.startswith("https://"))), 1, MOST_PHOTOS)


def liveness(kind: Column, p: Column) -> Column:
    """ok, degraded or failed, by what the payload says of its page; a broker's record needs address and price, others a title (or a price)."""
    status = p.detail_status
    removed = (status == "removed") | F.coalesce(p.removed, F.lit(False))
    shown = F.when(kind == BROKER, _text(p.address).isNotNull() & S.first_number(p.price).isNotNull()).when(kind == MARKET, _text(p.title).isNotNull())
    shown = shown.otherwise(_text(p.title).isNotNull() | (S.lenient_int(p.price) != 0))
    blocked = status.isin("blocked", "failed") | ((kind == CLASSIFIED) & p.detail_error.isNotNull())
    return F.when(F.coalesce(removed & (kind != BROKER), F.lit(False)), "failed").when(F.coalesce(blocked & (kind != BROKER), F.lit(False)) | ~shown, "degraded").otherwise("ok")


def to_listings(records: DataFrame, kinds: dict[str, str], currency: str = "CAD", area_unit: str = "sqft") -> DataFrame:
    """A listing for each record: identity and signature, place, rent, size, facts, photos, liveness. kinds: of each source."""
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    r = records.select("source", "source_id", "url", "fetched_at", F.try_element_at(kind, F.col("source")).alias("kind"), F.from_json("payload", PAYLOAD).alias("p"))
    p, is_ = F.col("p"), lambda k: F.col("kind") == k
    address = F.when(is_(CLASSIFIED), F.coalesce(_text(p.address), _text(p.location))).otherwise(_text(p.address))
    title = F.when(is_(BROKER), address).when(is_(MARKET), clean_title(p.title)).otherwise(_text(p.title))
    r = r.withColumns({"title": title, "address": address, "description": _text(p.description), "source_attributes": F.when(is_(CLASSIFIED), _text(p.source_attributes))})
    said = X.with_facts(r, F.when(~is_(BROKER), F.concat_ws(" ", "title", "description", "source_attributes")), "floor", "parking", "furnishing", "full_unit", "beds_range", "area_range")
    said = X.with_facts(said, F.col("source_attributes"), "area_sqft", into="attributes")
    fact, plain = F.col("facts"), is_(CLASSIFIED)
    price = F.when(plain, F.nullif(S.lenient_int(p.price), F.lit(0)).cast("double")).when(is_(BROKER), S.first_number(p.price)).otherwise(S.lenient_number(p.price))
    beds, baths, size = S.lenient_number(p.beds), S.lenient_number(p.baths), S.lenient_number(F.coalesce(p.sqft, p.area_sqft))
    parking = X.parking_reconciled(_text(p.parking), fact.parking)
    spaces = S.first_number(p.parking_spaces)
    out = said.select(
        F.concat("source", F.lit(":"), "source_id").alias("listing_id"),
        "source",
        "source_id",
        "url",
        "title",
        "address",
        "description",
        "source_attributes",
        price.alias("rent"),
        F.when(price.isNotNull(), F.lit(currency)).alias("currency"),
        F.when(price.isNotNull(), F.lit("month")).alias("period"),
        F.when(~(plain & fact.beds_range), beds).alias("beds"),
        baths.alias("baths"),
        F.when(~(plain & fact.area_range), F.when(plain, F.coalesce(size, F.col("attributes.area_sqft"))).otherwise(size)).alias("area"),
        F.lit(area_unit).alias("area_unit"),
        F.when(plain, fact.floor.cast("double")).alias("floor"),
        F.when(is_(BROKER), F.when(spaces > 0, "Included").when(spaces == 0, "Unavailable")).when(is_(MARKET), parking["value"]).otherwise(fact.parking).alias("parking"),
        F.when(is_(MARKET), parking["state"]).alias("parking_state"),
        F.when(~is_(BROKER), fact.furnishing).alias("furnishing"),
        F.when(is_(MARKET), fact.full_unit).alias("full_unit"),
        F.when(is_(BROKER), _text(p.management)).alias("management"),
        p.point.lat.alias("lat"),
        p.point.lng.alias("lng"),
        photo_list(p.photos).alias("photo_urls"),
        F.when(plain & _text(p.address).isNotNull(), "detail_page").otherwise("source_field").alias("origin"),
        _text(p.posted).alias("posted"),
        liveness(F.col("kind"), p).alias("liveness"),
        F.col("fetched_at").alias("observed_at"),
    )
    signed = F.when(F.col("title").isNotNull(), F.col("title")).otherwise(F.when(F.col("source") != "", F.col("source_id")))
    return out.withColumns({"photos": F.size("photo_urls").cast("long"), "signature": S.signature(signed, F.col("rent"), F.col("address"))})


# -- detail pages -------------------------------------------------------------------------------------------------------

CARD = "card"

#: Of each kind of source, where its pages have what: an id (#), a class (.), a tag, or an attribute of one (@).
PLACES = {
    CLASSIFIED: {"og_title": "meta[og:title]@content", "page_title": "title", "body": "#postingbody", "attributes": ".attrgroup", "price": ".price", "address": ".mapaddress", "posted": "time@datetime", "lat": "#map@data-latitude", "lng": "#map@data-longitude", "photos": "#thumbs a@href"},
    BROKER: {
        "address": "#listingAddress", "price": "#listingPriceValue", "body": "#PropertyDescription", "features": "#propertyDetailsBuilding_BuildingFeatures", "beds": "#BedroomIcon .listingCardIconNum",
        "baths": "#BathroomIcon .listingCardIconNum", "area": "#SquareFootageIcon .listingCardIconNum", "management": "#propertyDetailsSectionVal_MaintenanceManagementCompany", "spaces": "#propertyDetailsSectionVal_TotalParkingSpaces", "photos": "img@src",
    },
    CARD: {"url": ".listingDetailsLink@href", "price": ".listingCardPrice", "address": ".listingCardAddress", "icons": ".listingCardIconNum", "office": ".listingCardOfficeName", "photos": "img@src", "value": "a@data-value"},
}
#: Kinds of pages whose elements each are a line of their own.
APART = {BROKER, CARD}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Picker(HTMLParser):
    """The texts, or the values of an attribute, of all elements at each place."""

    def __init__(self, places: dict[str, str], apart: bool = False):
        super().__init__(convert_charrefs=True)
        self.places, self.apart = {}, apart
        for name, at in places.items():
            path, _, attribute = at.partition("@")
            self.places[name] = path.split(), attribute
        self.found: dict[str, list[list[str] | str]] = {name: [] for name in places}
        self.open: list[tuple[str, dict[str, str]]] = []
        self.reading: list[tuple[int, list[str]]] = []

    @staticmethod
    def _is(step: str, tag: str, a: dict[str, str]) -> bool:
        if step.startswith("#"):
            return a.get("id") == step[1:]
        if step.startswith("."):
            return step[1:] in a.get("class", "").split()
        name, _, prop = step.partition("[")
        return tag == name and (not prop or a.get("property", a.get("name")) == prop.rstrip("]"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.apart:
            self.handle_data("\n")
        for name, (path, attribute) in self.places.items():
            if not self._is(path[-1], tag, a) or len(path) > 1 and not any(self._is(path[0], *e) for e in self.open):
                continue
            if attribute:
                if a.get(attribute, "").strip():
                    self.found[name].append(a[attribute].strip())
            else:
                self.found[name].append([])
                self.reading.append((len(self.open), self.found[name][-1]))
        if tag not in _VOID:
            self.open.append((tag, a))

    def handle_endtag(self, tag: str) -> None:
        if self.apart:
            self.handle_data("\n")
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]
            self.reading = [x for x in self.reading if x[0] < at]

    def handle_data(self, data: str) -> None:
        for _, into in self.reading:
            into.append(data)


def picked(pages: DataFrame, kind: str, id_col: str, html_col: str = "html") -> DataFrame:
    """id_col and, for each place, an array: the texts there (a line for each of their lines that isn't blank) or values."""
    names = list(PLACES[kind])
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} array<string>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in names}
            for html in batch.column(1).to_pylist():
                p = _Picker(PLACES[kind], kind in APART)
                p.feed(html or "")
                p.close()
                for n in names:
                    texts = (x if isinstance(x, str) else "\n".join(y for line in "".join(x).split("\n") if (y := " ".join(line.split()))) for x in p.found[n])
                    columns[n].append([t for t in texts if t])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[n], pa.list_(pa.string())) for n in names)], [id_col, *names])

    return pages.select(id_col, html_col).mapInArrow(run, schema)


#: What a labelled address may not say, and how a line begins that is one.
NO_ADDRESS = ["contact", "please contact", "tbd", "n/a", "na", "unknown"]
NO_ADDRESS_WITHIN = ["please contact", "contact for details", "call for"]


def address_in(body: Column) -> Column:
    """A labelled line of a text, if it may be an address, else the first line that begins with a number and names a street type."""
    labelled = _text(F.regexp_extract(body, r"(?im)^\s*address\s*:\s*(.+?)\s*$", 1))
    low = F.lower(labelled)
    fine = (F.length(low) >= 6) & ~low.isin(*NO_ADDRESS) & low.rlike(r"\d")
    for phrase in NO_ADDRESS_WITHIN:
        fine = fine & ~low.contains(phrase)
    street = rf"(?i)^\d[\p{{L}}\p{{N}}\s#_-]*\b({'|'.join(S.STREET_ENDINGS)})\b"
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(street))
    return F.coalesce(F.when(fine, labelled), F.get(lines, F.lit(0)))


def _first(c: str) -> Column:
    return F.get(F.col(c), F.lit(0))


def classified_details(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What a classified ad's page states: title, posted, description, source_attributes, price, address, point, photos, and facts of its texts."""
    d = picked(pages, CLASSIFIED, id_col)
    body = F.array_join("body", "\n")
    bounded = lambda c: S.bounded_text(_text(c), MOST_TEXT)
    mapped = F.when(~F.lower(_first("address")).contains("google map"), _first("address"))
    d = d.select(
        id_col,
        F.coalesce(_first("og_title"), _first("page_title")).alias("title"),
        _first("posted").alias("posted"),
        bounded(F.replace(body, F.lit("\n"), F.lit(" "))).alias("_b"),
        bounded(F.replace(F.array_join("attributes", " "), F.lit("\n"), F.lit(" "))).alias("_a"),
        F.nullif(S.first_number(F.regexp_extract(_first("price"), r"\$\s*([\d,]+)", 1)), F.lit(0.0)).alias("price"),
        F.coalesce(_text(mapped), address_in(body)).alias("address"),
        _first("lat").try_cast("double").alias("lat"),
        _first("lng").try_cast("double").alias("lng"),
        photo_list(F.col("photos")).alias("photos"),
        (F.size(F.array_distinct("photos")) > MOST_PHOTOS).alias("photos_truncated"),
    )
    d = d.select("*", F.col("_b.text").alias("description"), F.col("_b.cut").alias("description_truncated"), F.col("_a.text").alias("source_attributes")).drop("_b", "_a")
    said = X.with_facts(d, F.concat_ws(" ", "title", "description", "source_attributes"), "beds", "baths", "area_sqft", "floor", "furnishing", "parking")
    return said.select("*", "facts.*").drop("facts")


def broker_details(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What a broker's page states; pages without an address are none."""
    d = picked(pages, BROKER, id_col).filter(F.size("address") > 0)
    last = lambda c: F.element_at(F.split(_first(c), "\n"), -1)
    flat = lambda c: F.replace(_first(c), F.lit("\n"), F.lit(" "))
    body = _text(F.regexp_replace(flat("body"), r"(?i)^Listing Description\s*", ""))
    return d.select(
        id_col,
        F.replace(_first("address"), F.lit("\n"), F.lit(", ")).alias("address"),
        S.first_number(_first("price")).alias("price"),
        S.first_number(_first("beds")).alias("beds"),
        S.first_number(_first("baths")).alias("baths"),
        S.first_number(_first("area")).alias("area"),
        _text(F.concat_ws(" ", body, flat("features"))).alias("description"),
        last("management").alias("management"),
        S.first_number(last("spaces")).alias("parking_spaces"),
        photo_list(F.col("photos")).alias("photos"),
    )


def broker_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each card of a broker's search page that leads to a listing: id, url, price, address, beds, baths, area (its icons'
    numbers, in this order), office, lat, lng (of its marker, if it has one), photos."""
    card = F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"(?is)<article\b[^>]*\blistingCard\b[^>]*>(.*?)</article>"), F.lit(1)))
    d = picked(pages.select(id_col, card.alias("html")), CARD, id_col)
    number = lambda i: S.first_number(F.get("icons", F.lit(i)))
    marker = F.split(_first("value"), "_")
    at = lambda i, most: F.when(F.abs(F.get(marker, F.lit(i)).try_cast("double")) <= most, F.get(marker, F.lit(i)).try_cast("double"))
    out = d.select(
        id_col,
        F.nullif(F.regexp_extract(_first("url"), r"/real-estate/(\d+)(/|$)", 1), F.lit("")).alias("id"),
        _first("url").alias("url"),
        S.first_number(_first("price")).alias("price"),
        F.replace(_first("address"), F.lit("\n"), F.lit(", ")).alias("address"),
        *(number(i).alias(c) for i, c in enumerate(("beds", "baths", "area"))),
        F.replace(_first("office"), F.lit("\n"), F.lit(" ")).alias("office"),
        at(1, 90).alias("lat"),
        at(2, 180).alias("lng"),
        photo_list(F.col("photos")).alias("photos"),
    )
    return out.filter("id IS NOT NULL")


def detail_status(html: Column, canonical_url: Column, url: Column, host: Column, source_id: Column, truncated: Column) -> Column:
    """status and error of a detail page: removed, blocked, failed (another listing's), partial or complete."""
    outcome = parsers.outcome(html)
    other = canonical_url.isNotNull() & ~parsers.same_page(canonical_url, host, source_id)
    status = F.when(outcome != "ok", outcome).when(other, "failed").when(canonical_url.isNull() | truncated, "partial").otherwise("complete")
    error = F.when(other, "detail page identity did not match the requested listing").when(canonical_url.isNull(), "canonical URL unavailable").when(truncated, "detail content was truncated at storage limits")
    return F.struct(status.alias("status"), F.when(outcome == "ok", error).alias("error"))
