"""The browse list: filters that let unknown values pass, seven orders, pages, lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListFilter:
    """None: not asked for. beds and baths are lower bounds."""

    rent_min: float | None = None
    rent_max: float | None = None
    beds: float | None = None
    baths: float | None = None
    area_min: float | None = None
    score_min: float | None = None
    source: str | None = None
    area_key: str | None = None
    status: str | None = None

    def predicate(self) -> Column:
        """Unknown rent, beds, baths and area pass; unknown score, source and neighbourhood don't."""
        tests = [F.lit(True)]
        for name, value, over in (("rent", self.rent_min, True), ("rent", self.rent_max, False), ("beds", self.beds, True), ("baths", self.baths, True), ("area", self.area_min, True)):
            if value is not None:
                c = F.col(name)
                tests.append(c.isNull() | (c >= value if over else c <= value))
        if self.score_min is not None:
            tests.append(F.coalesce(F.col("score") >= self.score_min, F.lit(False)))
        for name, value in (("source", self.source), ("status", self.status)):
            if value is not None:
                tests.append(F.coalesce(F.col(name) == value, F.lit(False)))
        if self.area_key is not None:
            tests.append(F.coalesce(F.trim("area_key") == self.area_key, F.lit(False)))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    @property
    def idle(self) -> bool:
        return self == ListFilter()


#: Orders by name; every one ends with the id, so none leaves ties.
SORTS: dict[str, tuple[Column, ...]] = {}
ALIASES = {"": "score", "best": "score", "cheap": "rent_asc", "new": "posted_desc"}


def sorts() -> dict[str, tuple[Column, ...]]:
    if not SORTS:  # columns need a session
        address = F.lower(F.coalesce("address", F.lit("")))
        SORTS.update(
            score=(F.desc_nulls_last("score"),),
            rent_asc=(F.asc_nulls_last("rent"),),
            rent_desc=(F.desc_nulls_last("rent"),),
            area_desc=(F.desc_nulls_last("area"),),
            posted_desc=(F.desc_nulls_last("posted"),),
            posted_asc=(F.asc_nulls_last("posted"),),
            address=(address.asc(),),
        )
    return SORTS


def normal_sort(name: str | None) -> str:
    name = ALIASES.get(name or "", name)
    return name if name in sorts() else "score"


def page(rows: DataFrame, f: ListFilter = ListFilter(), sort: str = "score", limit: int = 36, offset: int = 0) -> DataFrame:
    """One page. Spark takes the top rows of each task and merges those (TakeOrderedAndProject)."""
    return rows.filter(f.predicate()).orderBy(*sorts()[normal_sort(sort)], "listing_id").offset(offset).limit(limit)


def without_actions(rows: DataFrame, actions: DataFrame, kind: str) -> DataFrame:
    return rows.join(actions.filter(F.col("kind") == kind), "listing_id", "left_anti")


def with_action(rows: DataFrame, actions: DataFrame, kind: str) -> DataFrame:
    return rows.join(actions.filter(F.col("kind") == kind), "listing_id", "left_semi")


def action_flags(actions: DataFrame, kinds: tuple[str, ...] = ("star", "dismiss", "excluded")) -> DataFrame:
    """Whether each entity has an action of each kind."""
    return actions.groupBy("listing_id").agg(*(F.coalesce(F.max(F.col("kind") == k), F.lit(False)).alias(k) for k in kinds))


def toggled_flags(actions: DataFrame, kinds: tuple[str, ...] = ("star", "dismiss", "excluded")) -> DataFrame:
    """Flags that each action of their kind turns round: on after an odd number of them."""
    return actions.groupBy("listing_id").agg(*((F.count_if(F.col("kind") == k) % 2 == 1).alias(k) for k in kinds))


def with_score(rows: DataFrame, scores: DataFrame, profile: int) -> DataFrame:
    """The score of one profile, 0 where it has none."""
    s = scores.filter(F.col("profile_id") == profile).select("listing_id", F.col("score").alias("_s"))
    return rows.join(s, "listing_id", "left").withColumn("score", F.coalesce("_s", F.lit(0.0))).drop("_s")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """new over old by key: the rows of old without one in new, and all of new."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def missing_facts(listings: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Labels of what isn't stated."""
    return listings.select("listing_id", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(label)) for c, label in labels.items()))).alias("missing"))


def decision_brief(scored: DataFrame, now: str, fetched: str = "fetched_at") -> DataFrame:
    """headline, blockers (failed checks) and questions (unknown ones). Facts older than a day, or from the future, are stale."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(fetched))
    stale = age.isNull() | (age > 86_400) | (age < 0)
    reasons = lambda s: F.transform(F.filter("checks", lambda c: c.status == s), lambda c: c.reason)
    return scored.select(
        "listing_id",
        F.when(F.col("evidence_status") == "miss", "rule out").when(stale, "refresh first").when(F.col("evidence_status") == "unverified", "ask first").otherwise("worth a visit").alias("headline"),
        F.array_join(reasons("fail"), "; ").alias("blockers"),
        F.array_join(reasons("unknown"), "; ").alias("questions"),
    )
