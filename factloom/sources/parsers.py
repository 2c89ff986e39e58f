"""Landed documents to rows: feeds, JSON-LD, search results, details, pages. Fetching is outside; these read what was landed.

Built-in functions where a pattern is enough; an Arrow function over html.parser where markup nests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

_LD = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
ITEM = "struct<url:string,name:string,description:string,offers:struct<price:string>,numberOfBedrooms:string,numberOfBathroomsTotal:string,floorSize:struct<value:string>,address:string,image:array<string>>"
ITEM_LIST = f"struct<`@type`:string,itemListElement:array<struct<item:{ITEM}>>>"
LISTING_NODE = "struct<`@type`:string,name:string,url:string,address:struct<streetAddress:string,addressLocality:string>,geo:struct<latitude:double,longitude:double>,offers:struct<price:string>,numberOfBedrooms:string>"
API_RESULT = (
    "struct<Id:string,PublicRemarks:string,Building:struct<Bedrooms:string,BathroomTotal:string,SizeInterior:string>,"
    "Property:struct<LeaseRentUnformattedValue:string,Address:struct<AddressText:string,Latitude:string,Longitude:string>,ParkingSpaceTotal:string>,RelativeDetailsURL:string>"
)


def _tag(item: Column, name: str) -> Column:
    inner = F.regexp_extract(item, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def feed_items(feeds: DataFrame, xml_col: str = "xml", since: str | None = None) -> DataFrame:
    """A row for each item of RSS documents: id (the link's last number), title, link, posted; dropped tells that it is older
    than the watermark (one of the same time stays)."""
    item = F.explode(F.regexp_extract_all(F.col(xml_col), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1)))
    i = feeds.select(*[c for c in feeds.columns if c != xml_col], item.alias("item"))
    posted = S.feed_time(F.coalesce(F.nullif(_tag(F.col("item"), "dc:date"), F.lit("")), _tag(F.col("item"), "pubDate")))
    out = i.select("*", _tag(F.col("item"), "title").alias("title"), _tag(F.col("item"), "link").alias("link"), posted.alias("posted")).drop("item")
    out = out.withColumn("id", F.nullif(F.regexp_extract("link", r"(\d+)(?:\.html)?/?$", 1), F.lit("")))
    return out.withColumn("dropped", F.coalesce(F.col("posted") < F.lit(since).cast("timestamp"), F.lit(False)) if since else F.lit(False))


def json_ld(html: Column) -> Column:
    """The texts of a page's JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(_LD), F.lit(1))


def item_lists(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row for each item of the first ItemList of each page that has an id of nine or ten digits."""
    keep = [c for c in pages.columns if c != html_col]
    lists = F.filter(F.transform(json_ld(F.col(html_col)), lambda t: F.from_json(t, ITEM_LIST)), lambda x: x["@type"] == "ItemList")
    rows = pages.select(*keep, F.get(lists, F.lit(0)).alias("l")).select(*keep, F.posexplode("l.itemListElement").alias("ordinal", "e"))
    i = F.col("e.item")
    rows = rows.select(
        *keep,
        "ordinal",
        F.nullif(F.regexp_extract(i.url, r"(\d{9,10})(?:\D*)$", 1), F.lit("")).alias("id"),
        i.url.alias("url"),
        plain_text(i["name"]).alias("title"),
        plain_text(i.description).alias("description"),
        S.lenient_number(i.offers.price).alias("price"),
        S.lenient_number(i.numberOfBedrooms).alias("beds"),
        S.lenient_number(i.numberOfBathroomsTotal).alias("baths"),
        S.lenient_number(i.floorSize.value).alias("area"),
        i.address.alias("address"),
        F.slice(i.image, 1, 50).alias("photos"),
    )
    return rows.filter("id IS NOT NULL")


def detail_node(html: Column) -> Column:
    """The first JSON-LD node that isn't a list and says something of an offer, bedrooms or an address."""
    nodes = F.transform(json_ld(html), lambda t: F.from_json(t, LISTING_NODE))
    return F.get(F.filter(nodes, lambda n: (n["@type"] != "ItemList") & (n.offers.isNotNull() | n.numberOfBedrooms.isNotNull() | n.address.isNotNull())), F.lit(0))


def api_results(documents: DataFrame, json_col: str = "json", city: str = "Toronto") -> DataFrame:
    """A row for each result of a search API's answer that has an id and an address of its own page, and is in the city. The API
    parts street and city by a bar; a number is the first one of its text (`2 + 1` bedrooms are 2)."""
    rows = documents.select(F.explode(F.from_json(json_col, f"struct<Results:array<{API_RESULT}>>").Results).alias("r"))
    p = F.col("r.Property")
    out = rows.select(
        F.col("r.Id").alias("id"),
        F.col("r.PublicRemarks").alias("description"),
        S.first_number(F.col("r.Building.Bedrooms")).alias("beds"),
        S.first_number(F.col("r.Building.BathroomTotal")).alias("baths"),
        S.first_number(p.LeaseRentUnformattedValue).alias("price"),
        F.replace(p.Address.AddressText, F.lit("|"), F.lit(", ")).alias("address"),
        p.Address.Latitude.try_cast("double").alias("lat"),
        p.Address.Longitude.try_cast("double").alias("lng"),
        S.first_number(p.ParkingSpaceTotal).cast("int").alias("parking_spaces"),
        F.col("r.RelativeDetailsURL").alias("url"),
    )
    return out.filter(F.col("id").isNotNull() & F.col("url").isNotNull() & F.col("address").rlike(rf"(?i),\s*{re.escape(city)}\b"))


def plain_text(html: Column) -> Column:
    """Without tags; five entities decoded; white space squeezed."""
    t = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def visible_text(html: Column) -> Column:
    return plain_text(F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->", " "), r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " "))


def title_and_links(pages: DataFrame) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"), F.get(links, F.lit(0)).alias("first_link"))


#: What tells that a page is gone, or that it was refused.
GONE = ["this posting has been deleted", "this posting has expired", "no longer available", "listing removed"]
REFUSED = ["access denied", "are you a robot", "unusual traffic", "captcha"]


def outcome(html: Column) -> Column:
    """removed before blocked before ok, by what a reader sees."""
    text = F.lower(visible_text(html))
    some = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: text.contains(m))
    return F.when(some(GONE), "removed").when(some(REFUSED), "blocked").otherwise("ok")


def liveness(page_outcome: Column, title: Column, price: Column) -> Column:
    return F.when(page_outcome == "removed", "failed").when((page_outcome != "ok") | (title.isNull() & price.isNull()), "degraded").otherwise("ok")


def same_page(url: Column, host: Column, record_id: Column) -> Column:
    """The address is of this host or a subdomain, and ends in this record's id."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return ((found == host) | found.endswith(F.concat(F.lit("."), host))) & (F.regexp_extract(url, r"(\d+)\D*$", 1) == record_id)


def with_detail(records: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """Records with what their details add: a detail's value where there is one, else the record's; a record without detail stays."""
    d = details.select("id", *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in columns))
    kinds = dict(records.dtypes)
    return records.join(d, "id", "left").select(*[c for c in records.columns if c not in columns], *(F.coalesce(F.col(f"_{c}").cast(kinds[c]), F.col(c)).alias(c) for c in columns))


#: Labels of masks and what they mask, in the order in which they are applied.
MASKS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+?\d?[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}",
    "postal": r"\b[A-Z]\d[A-Z] ?\d[A-Z]\d\b",
}


def redacted(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, the text with masks, and how often each was put. Each mask is found and put once over a whole column, by
    Arrow's RE2, whose time is linear in the text whatever it holds."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, counts = batch.column(1), []
            for label, pattern in MASKS.items():
                counts.append(pc.count_substring_regex(text, pattern).cast(pa.int64()))
                text = pc.replace_substring_regex(text, pattern, f"[{label}]")
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *counts], [id_col, "text", *MASKS])

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, text string, " + ", ".join(f"{m} long" for m in MASKS))


class _Cards(HTMLParser):
    """Rows of search results: elements of a class, with their first link, title, price and place."""

    def __init__(self, card: str):
        super().__init__(convert_charrefs=True)
        self.card, self.rows, self.depth, self.field = card, [], 0, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.depth:
            self.depth += tag not in ("br", "img", "input", "hr", "meta", "link")
        elif self.card in classes:
            self.rows.append({"url": None, "title": a.get("title"), "price": None, "place": None})
            self.depth = 1
        if self.depth:
            if tag == "a" and a.get("href") and not self.rows[-1]["url"]:
                self.rows[-1]["url"] = a["href"]
            self.field = next((f for f in ("title", "price", "place") if f in classes or (f == "place" and "location" in classes)), None)

    def handle_endtag(self, tag: str) -> None:
        self.field = None
        self.depth -= bool(self.depth)

    def handle_data(self, data: str) -> None:
        if self.depth and self.field and data.strip() and not self.rows[-1][self.field]:
            self.rows[-1][self.field] = " ".join(data.split())


def cards(pages: DataFrame, card: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each card of each page: id, ordinal, url, title, price (text), place."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, html in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                p = _Cards(card)
                p.feed(html or "")
                p.close()
                ids += [i.as_py()] * len(p.rows)
                rows += [(k, *r.values()) for k, r in enumerate(p.rows)]
            got = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(x, t) for x, t in zip(got, kinds, strict=True))], [id_col, "ordinal", "url", "title", "price", "place"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, ordinal long, url string, title string, price string, place string")


def search_urls(regions: DataFrame, keywords: list[str], base: str) -> DataFrame:
    """The addresses to fetch: every region with every keyword."""
    return regions.select("region", F.explode(F.array(*map(F.lit, keywords or ["apartments"]))).alias("keyword")).select("region", "keyword", F.concat(F.lit(base), "region", F.lit("/"), F.url_encode("keyword")).alias("url"))


def search_box(areas: DataFrame) -> DataFrame:
    """The box around all areas."""
    return areas.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def enabled_sources(catalog: DataFrame, wanted: DataFrame, credentials: list[str]) -> DataFrame:
    """source and why it is off (null: on): the profile's choice (wanted: source) before the catalog's before missing credentials."""
    c = catalog.select("source", "enabled", "needs_credentials").join(wanted.select("source", F.lit(True).alias("_wanted")).distinct(), "source", "left")
    return c.select(
        "source",
        F.when(F.col("_wanted").isNull(), "off in profile").when(~F.coalesce("enabled", F.lit(False)), "disabled").when(F.col("needs_credentials") & ~F.col("source").isin(*credentials), "missing credentials").alias("off"),
    )
