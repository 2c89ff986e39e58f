"""What is shown: texts of values, rows of lists, one listing's page, and small keys that caches go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

PAGE = 36
#: Units of ages in hours, by how they begin; what wraps text from outside.
AGES = [("min", 1 / 60), ("mo", 720.0), ("h", 1.0), ("d", 24.0), ("w", 168.0)]
WRAPPER = r"<<<[^>]*>>>|\[/?external[^\]]*\]"
REPORT_VERSION, REPORT_HOURS = "1", 24


def rent_display(amount: Column, currency: Column) -> Column:
    return F.coalesce(F.when(amount.isNotNull(), F.concat(F.format_string("%.2f", amount), F.lit(" "), currency)), F.lit("unknown"))


def plain_number(n: Column) -> Column:
    """Without an idle fraction."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def signed(n: Column) -> Column:
    return F.concat(F.when(n < 0, "-").otherwise("+"), plain_number(F.abs(n)))


def weight_text(weight: Column, rate: Column, cap: Column, per: Column) -> Column:
    """A weight with its sign, or a scaled one: its rate and its cap."""
    scaled = F.concat_ws(", ", F.when(rate.isNotNull(), F.concat(signed(rate), F.lit(" per "), per)), F.when(cap.isNotNull(), F.concat(F.lit("cap "), plain_number(cap))))
    return F.coalesce(signed(weight), F.nullif(scaled, F.lit("")), F.lit("—"))


def directions_url(base: str, origin: Column, lat: Column, lng: Column, mode: str = "walking") -> Column:
    return F.concat(F.lit(f"{base}?api=1&origin="), F.url_encode(origin), F.lit("&destination="), F.url_encode(F.concat(lat.cast("string"), F.lit(","), lng.cast("string"))), F.lit(f"&travelmode={mode}"))


def fact_text(value: Column, absence: Column) -> Column:
    """A fact in words: what kind of absence, yes or no, a list with commas, else as it stands."""
    low = F.lower(value)
    said = F.when(low == "true", "Yes").when(low == "false", "No").otherwise(F.replace(F.regexp_replace(value, r"\s*,\s*", ", "), F.lit("_"), F.lit(" ")))
    kind = F.coalesce(absence, F.when(value.isNull(), F.lit("not_stated")))
    return F.when(kind == "contradictory", "Conflicting evidence").when(kind == "not_applicable", "Not applicable").when(kind == "not_stated", "Unstated").otherwise(said)


def external_text(text: Column, most: int) -> Column:
    """Without wrapper marks, squeezed, cut to so many characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WRAPPER, " "), r"\s+", " ")), 1, most)


def posted_at(posted: Column, label: Column, now: str) -> Column:
    """When something was posted: as it says, else by its age (`3h ago`), else by month and day (of last year, where that is more
    than a day ahead). Null where it can't be told."""
    t = F.lit(now).cast("timestamp")
    amount, unit = (F.regexp_extract(F.lower(F.coalesce(label, F.lit(""))), r"(\d+)\s*(minutes|minute|mins|min|months|month|mo|hours|hour|hrs|hr|h|days|day|d|weeks|week|w)s?\s+ago", k) for k in (1, 2))
    hours = F
    for name, n in AGES:
        hours = hours.when(unit.startswith(name), F.lit(n))
    aged = F.when(unit != "", F.timestamp_seconds(F.unix_timestamp(t) - (amount.try_cast("double") * hours.otherwise(F.lit(0.0)) * 3600).cast("long")))
    month, day = (F.regexp_extract(F.trim(F.coalesce(label, F.lit(""))), r"^(\d{1,2})[-/](\d{1,2})$", k) for k in (1, 2))
    of = lambda y: F.try_to_timestamp(F.concat_ws("-", y.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    this = of(F.year(t))
    dated = F.when(month != "", F.when(this > t + F.expr("INTERVAL 1 DAY"), of(F.year(t) - 1)).otherwise(this))
    return F.coalesce(F.when(posted != "", F.try_to_timestamp(posted)), aged, dated)


def holds_run(text: Column, part: Column) -> Column:
    """Whether the words of part stand in text, one after the other; no words stand in none."""
    of = lambda c: F.array_join(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), " ")
    run = of(part)
    return (run != "") & F.concat(F.lit(" "), of(text), F.lit(" ")).contains(F.concat(F.lit(" "), run, F.lit(" ")))


def report_key(subject: Column, city: Column) -> Column:
    """A report's identity in a cache: its rules' version, city and subject."""
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.concat_ws("|", F.lit(REPORT_VERSION), low(city), low(subject))


def report_current(key: Column, saved_key: Column, saved_at: Column, now: str) -> Column:
    """Whether a saved report may be shown: of the same key, not from the future, and younger than REPORT_HOURS."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(saved_at)
    return F.coalesce((key == saved_key) & (age >= 0) & (age < REPORT_HOURS * 3600), F.lit(False))


def merge_patch(current: Column, patch: Column) -> Column:
    """Maps of text: patch over current; a null in patch takes its key away."""
    rest = F.map_filter(current, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(rest, F.map_filter(patch, lambda _, v: v.isNotNull()))


def attribute_categories(claims: DataFrame) -> DataFrame:
    """claims: listing_id, field, confidence. A row for each, by the part of its field before a point: its confidence as a score of 1, the largest first."""
    return claims.select("listing_id", F.substring_index("field", ".", 1).alias("category"), F.coalesce("confidence", F.lit(0.0)).alias("score"), (F.coalesce("confidence", F.lit(0.0)) * 100).alias("pct"))


def list_rows(classified: DataFrame, flags: DataFrame) -> DataFrame:
    """Display columns of classified listings: excluded ones say so in place of their verdict; reasons are those of checks that don't pass."""
    f = flags.select("listing_id", "star", "dismiss", "excluded")
    r = classified.join(f, "listing_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.transform(F.filter("checks", lambda c: c.status != "pass"), lambda c: c.reason)
    return r.select(
        "listing_id",
        "title",
        rent_display(F.col("rent"), F.col("currency")).alias("rent_text"),
        F.when(F.col("rent").isNotNull(), S.money_text(F.col("rent"))).alias("rent_short"),
        "address",
        F.nullif(F.trim("area_key"), F.lit("")).alias("area_key"),
        F.when(flag("excluded"), "excluded").otherwise(F.col("evidence_status")).alias("match_status"),
        F.when(flag("excluded"), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"),
        flag("star").alias("starred"),
        flag("dismiss").alias("dismissed"),
    )


def page_after(rows: DataFrame, *keys: str, last: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The page of rows (in the order of keys, none of them null) that follows the row whose keys are last, and one row more, by which it
    is known that another page follows. A page costs the same whatever its number: nothing before it is sorted."""
    if last is not None:
        after = F.lit(False)
        for i in range(len(keys)):
            step = F.col(keys[i]) > F.lit(last[i])
            for j in range(i):
                step = (F.col(keys[j]) == F.lit(last[j])) & step
            after = after | step
        rows = rows.filter((F.col(keys[0]) >= F.lit(last[0])) & after)
    return rows.orderBy(*keys).limit(size + 1)


def detail(listing_id: object, listings: DataFrame, records: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """One listing with its newest record, score and flags; no row where it has no record. Its filter reaches every scan."""
    at = lambda df: df.filter(F.col("listing_id") == listing_id)
    newest = at(records).groupBy("listing_id").agg(F.max_by(F.struct("record_id", "source", "status"), "record_id").alias("record"))
    return at(listings).join(newest, "listing_id").join(at(scores), "listing_id", "left").join(at(flags), "listing_id", "left")


def breakdowns(scored: DataFrame, ids: DataFrame, schema: str) -> DataFrame:
    """listing_id and breakdown (read from its JSON) of the wanted listings; what can't be read is left out."""
    return scored.join(ids.select("listing_id"), "listing_id", "left_semi").select("listing_id", F.from_json("breakdown", schema).alias("breakdown")).filter(F.col("breakdown").isNotNull())


def photo_candidates(listings: DataFrame) -> DataFrame:
    """a, b, photos: listings that share photos, without comparing pairs of all. Of a photo's listings the one of the least id
    stands for all: a photo of m listings gives m - 1 pairs. Addresses count without what follows a question mark."""
    p = listings.select("listing_id", F.explode(F.array_distinct(F.transform("photo_urls", lambda u: F.substring_index(u, "?", 1)))).alias("photo"))
    lead = p.groupBy("photo").agg(F.min("listing_id").alias("a"))
    return p.join(lead, "photo").filter("listing_id <> a").groupBy("a", F.col("listing_id").alias("b")).agg(F.count(F.lit(1)).alias("photos"))
