"""Hard criteria with three outcomes. Each criterion is one expression that gives a check (field, status, reason), and
what it adds to the lists of misses and unknowns; both verdicts are folded from these. No step shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import RUBRIC, Range, Rubric
from ..session import per_session


def _s(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def check(field: str, status: Column, reason: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), status.alias("status"), reason.alias("reason"))


class Criterion:
    """status and reason; misses and unknowns are arrays of reasons, null where nothing is added."""

    def __init__(self, field: str, *cases: tuple[Column, str, str | Column], otherwise: tuple[str, str | Column], unknown_counts: bool = True):
        self.field = field
        status = reason = F
        for when, s, r in cases:
            status, reason = status.when(when, F.lit(s)), reason.when(when, _s(r))
        self.status, self.reason = status.otherwise(F.lit(otherwise[0])), reason.otherwise(_s(otherwise[1]))
        self.miss = F.when(self.status == "fail", F.array(self.reason))
        self.unknown = F.when(self.status == "unknown", F.array(self.reason)) if unknown_counts else None

    @property
    def check(self) -> Column:
        return check(self.field, self.status, self.reason)


def short(n: Column | float) -> Column:
    """A number without an idle fraction."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def money(n: Column | float) -> Column:
    return F.concat(F.lit("$"), F.format_number(n if isinstance(n, Column) else F.lit(float(n)), 0))


def numeric(field: str, label: str, value: Column, r: Range) -> Criterion:
    cases: list[tuple[Column, str, str | Column]] = [(value.isNull(), "unknown", f"{label} unstated")]
    if r.eq is not None:
        cases.append((value != r.eq, "fail", F.concat(F.lit(f"{label} "), short(value), F.lit(" ≠ "), short(r.eq))))
    if r.min is not None:
        cases.append((value < r.min, "fail", F.concat(F.lit(f"{label} "), short(value), F.lit(" < min "), short(r.min))))
    if r.max is not None:
        cases.append((value > r.max, "fail", F.concat(F.lit(f"{label} "), short(value), F.lit(" > max "), short(r.max))))
    return Criterion(field, *cases, otherwise=("pass", f"{label} meets requirement"))


def area_key() -> Column:
    """The place's key, trimmed; an empty one is none."""
    return F.nullif(F.trim("area_key"), F.lit(""))


@per_session
def criteria(r: Rubric) -> tuple[list[Criterion], list[Column]]:
    """The criteria in force, and arrays of unknown reasons that stand outside them."""
    out: list[Criterion] = []
    extra: list[Column] = []
    fact = lambda name: F.col(f"facts.{name}")
    if r.rent_max is not None:
        rent = F.col("rent")
        odd = rent.isNotNull() & ((F.col("currency") != r.currency) | (F.col("period") != "month"))
        over = F.concat(F.lit("rent "), money(rent), F.lit(" > max "), money(r.rent_max))
        under = F.concat(F.lit("rent "), money(rent), F.lit(" < min "), money(r.rent_min or 0))
        low = rent < r.rent_min if r.rent_min is not None else F.lit(False)
        c = Criterion("rent", (rent.isNull(), "unknown", "rent unstated"), (odd, "unknown", "rent currency or period needs verification"), (low, "fail", under), (rent > r.rent_max, "fail", over), otherwise=("pass", "rent meets requirement"))
        # a miss counts whatever the currency; the doubt about units comes after all other unknowns
        c.miss = F.filter(F.array(F.when(rent > r.rent_max, over), F.when(low, under)), lambda x: x.isNotNull())
        c.unknown = F.when(rent.isNull(), F.array(F.lit("rent unstated")))
        extra.append(F.when(odd, F.array(F.lit("rent currency or period needs verification"))))
        out.append(c)
    for name in ("beds", "baths"):
        if (bounds := getattr(r, name)) is not None:
            out.append(numeric(name, name, F.col(name), bounds))
    if r.area_min is not None:
        area, unit = F.col("area"), F.lower("area_unit")
        out.append(
            Criterion(
                "area",
                (area.isNull(), "unknown", "area unstated"),
                (unit != r.area_unit.lower(), "unknown", F.concat(F.lit("area in "), F.col("area_unit"), F.lit(f", profile uses {r.area_unit}"))),
                (area < r.area_min, "fail", F.concat(F.lit("area "), F.format_number(area, 0), F.lit(" < min "), F.format_number(F.lit(r.area_min), 0), F.lit(f" {r.area_unit}"))),
                otherwise=("pass", "area meets requirement"),
            )
        )
    if r.floor is not None:
        out.append(numeric("floor", "floor", F.col("floor"), r.floor))
    if r.areas:
        out.append(Criterion("neighbourhood", (area_key().isNull(), "unknown", "area unknown"), (~area_key().isin(*r.areas), "fail", "area not in allowed list"), otherwise=("pass", "neighbourhood is in the allowed list")))
    if "basement" in r.exclude:
        # an unknown here is shown, but isn't a reason to doubt the listing
        out.append(Criterion("basement", (fact("basement"), "fail", "basement unit"), otherwise=("unknown", "basement status unstated"), unknown_counts=False))
    if "furnished_only" in r.exclude:
        kind = F.lower(F.trim("furnishing"))
        free = kind.contains("unfurnished") | kind.contains("optional")
        out.append(
            Criterion("furnishing", (kind.isNull(), "unknown", "furnishing status unstated"), (free, "pass", "not restricted to furnished"), (kind.contains("furnished"), "fail", "furnished only"), otherwise=("unknown", "furnishing status unclear"), unknown_counts=False)
        )
    if r.require_laundry:
        out.append(Criterion("in_suite_laundry", (fact("in_suite_laundry").isNull(), "unknown", "in-suite laundry unstated"), otherwise=("pass", "in-suite laundry confirmed")))
    if r.require_parking:
        p = fact("parking")
        out.append(Criterion("parking", (p.isNull(), "unknown", "parking unstated"), (p == "Unavailable", "fail", "parking required"), otherwise=("pass", "parking confirmed")))
    if r.lease_months_min is not None:
        n = fact("lease_months")
        out.append(Criterion("lease_months", (n.isNull(), "unknown", "lease months unstated"), (n < r.lease_months_min, "fail", "lease months outside requirement"), otherwise=("pass", "lease months meets requirement")))
    if r.total_monthly_max is not None:
        n = fact("total_monthly")
        out.append(Criterion("total_monthly", (n.isNull(), "unknown", "total monthly cost unstated"), (n > r.total_monthly_max, "fail", "total monthly cost outside requirement"), otherwise=("pass", "total monthly cost meets requirement")))
    if r.available_by is not None:
        d = fact("available_date")
        out.append(Criterion("available_date", (d.isNull(), "unknown", "availability date unstated"), (d > F.lit(r.available_by).cast("date"), "fail", f"available after {r.available_by}"), otherwise=("pass", "availability date meets requirement")))
    return out, extra


def _joined(parts: list[Column | None]) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(empty, *(F.coalesce(p, empty) for p in parts if p is not None))


@per_session
def _lists(r: Rubric) -> dict[str, Column]:
    found, extra = criteria(r)
    checks = F.array(*(c.check for c in found)).cast("array<struct<field:string,status:string,reason:string>>")
    return {"checks": checks, "misses": _joined([c.miss for c in found]), "unknowns": _joined([*(c.unknown for c in found), *extra])}


def with_facts(listings: DataFrame) -> DataFrame:
    """listings with what their texts say, read once."""
    return listings if "facts" in listings.columns else X.with_facts(listings, X.listing_text(listings.columns))


def classify(listings: DataFrame, r: Rubric = RUBRIC) -> DataFrame:
    """listings with facts, checks, misses, unknowns, status, evidence_status, eligible."""
    out = with_facts(listings).withColumns(_lists(r))
    status = F.when(F.size("misses") > 0, "miss").when(F.size("unknowns") > 0, "unverified").otherwise("match")
    out = out.withColumn("status", status)
    evidence = F.when(F.exists("checks", lambda c: c.status == "fail"), "miss").when(F.exists("checks", lambda c: c.status == "unknown"), "unverified").otherwise(F.col("status"))
    # unknown reasons that the exclude policy lets by
    tolerated = F.lit(r.unknown_policy == "review") | F.forall("unknowns", lambda x: x.isin("floor unstated", "area unknown"))
    return out.withColumns({"evidence_status": evidence, "eligible": (F.col("status") == "match") | ((F.col("status") == "unverified") & tolerated)})
