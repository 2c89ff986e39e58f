"""Chains of enrichers: what each provides and requires orders them, and each adds claims to the rows that it may.

An enricher is a function from rows to claims (listing_id, field, value, confidence); the chain is one plan over all rows: no
row is looked at on the driver, but for the count that a paid enricher's cost is estimated from."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import precedence


class UncappedSpend(RuntimeError):
    """A paid enricher without a cap."""


class SpendExceeded(RuntimeError):
    """The estimate would go over the cap."""


class SpendDeclined(RuntimeError):
    """A paid enricher whose cost wasn't confirmed."""


@dataclass(frozen=True)
class Enricher:
    """enrich: rows (listing_id and fields) -> listing_id, field, value, confidence. cost: of a row."""

    name: str
    provides: tuple[str, ...]
    enrich: Callable[[DataFrame], DataFrame]
    requires: tuple[str, ...] = ()
    origin: str = "text_rule"
    confidence: float = 0.6
    cost: float = 0.0


@dataclass
class Budget:
    """cap of all that is spent; confirm is asked once, before the first paid enricher."""

    cap: float | None = None
    confirm: Callable[[float], bool] | None = None
    spent: float = 0.0
    confirmed: bool = field(default=False)

    def take(self, estimate: float) -> None:
        if self.cap is None:
            raise UncappedSpend("a paid enricher needs a cap")
        if estimate < 0:
            raise ValueError("a cost is never negative")
        if estimate and not self.confirmed:
            if self.confirm is None or not self.confirm(estimate):
                raise SpendDeclined("the estimated cost wasn't confirmed")
            self.confirmed = True
        if self.spent + estimate > self.cap:
            raise SpendExceeded(f"{self.spent + estimate} is over the cap of {self.cap}")
        self.spent += estimate


def ordered(enrichers: Sequence[Enricher]) -> list[Enricher]:
    """Those that provide a field before those that require it, else as given; a circle is an error."""
    left, out = list(enrichers), []
    while left:
        waits = {f for e in left for f in e.provides}
        ready = next((e for e in left if not any(f in waits and f not in e.provides for f in e.requires)), None)
        if ready is None:
            raise ValueError(f"enrichers require each other: {', '.join(e.name for e in left)}")
        left.remove(ready)
        out.append(ready)
    return out


def _known(e: Enricher) -> Column:
    """Every field that it provides is stated already, by an origin of higher precedence, or an equal one as sure."""
    own, known = precedence(F.lit(e.origin)), F.lit(bool(e.provides))
    for f in e.provides:
        held = precedence(F.col(f"{f}_origin"))
        known = known & F.col(f).isNotNull() & ((held > own) | ((held == own) & (F.col(f"{f}_confidence") >= e.confidence)))
    return F.coalesce(known, F.lit(False))


def eligible(rows: DataFrame, e: Enricher) -> DataFrame:
    """The rows with all that it requires, and not all that it provides."""
    has = F.lit(True)
    for f in e.requires:
        has = has & F.col(f).isNotNull()
    return rows.filter(has & ~_known(e))


def run_chain(rows: DataFrame, enrichers: Sequence[Enricher], budget: Budget | None = None) -> DataFrame:
    """rows: listing_id and, of each field f, f, f_origin and f_confidence. The same with what the chain adds: a claim replaces a value of
    lower precedence, or of equal precedence and less confidence."""
    for e in ordered(enrichers):
        some = eligible(rows, e)
        if e.cost:
            (budget or Budget()).take(e.cost * some.count())
        claims = e.enrich(some)
        g = claims.groupBy("listing_id").agg(*(F.max(F.when(F.col("field") == f, F.struct("confidence", "value"))).alias(f"_{f}") for f in e.provides))
        j = rows.join(g, "listing_id", "left")
        for f in e.provides:
            new, held, own = F.col(f"_{f}"), precedence(F.col(f"{f}_origin")), precedence(F.lit(e.origin))
            wins = new.isNotNull() & (F.col(f).isNull() | (own > held) | ((own == held) & (new.confidence > F.col(f"{f}_confidence"))))
            kind = dict(rows.dtypes)[f]
            j = j.withColumns({f: F.when(wins, new.value.cast(kind)).otherwise(F.col(f)), f"{f}_origin": F.when(wins, F.lit(e.origin)).otherwise(F.col(f"{f}_origin")), f"{f}_confidence": F.when(wins, new.confidence).otherwise(F.col(f"{f}_confidence"))})
        rows = j.select(*rows.columns)
    return rows
