"""Claims and facts: which of competing claims holds, how facts are laid out, and how they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import precedence


def resolve(claims: DataFrame, *, by: tuple[str, ...] = ("listing_id", "field")) -> DataFrame:
    """The claim that holds for each field: the highest precedence, then the latest, then the largest id.

    row_number() = 1 is planned with a group limit before the shuffle, so a task sends at most one claim of a key on."""
    order = Window.partitionBy(*by).orderBy(precedence(F.col("origin")).desc(), F.desc("observed_at"), F.desc("claim_id"))
    return claims.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def resolve_reviewed(claims: DataFrame) -> DataFrame:
    """Entities with a current review take its claims, and the user's and geographic ones; others the claims without a review."""
    has_review = claims.filter("reviewed").select("listing_id").distinct()
    own = claims.join(has_review, "listing_id", "left_semi").filter(F.col("reviewed") | F.col("origin").isin("user", "geo_provider"))
    others = claims.join(has_review, "listing_id", "left_anti")
    return resolve(own.unionByName(others))


def unpivot(listings: DataFrame, fields: list[str], id_col: str = "listing_id") -> DataFrame:
    """A row for each field that is stated."""
    wide = listings.select(id_col, *(F.col(c).cast("string").alias(c) for c in fields))
    return wide.unpivot(id_col, fields, "field", "value").filter("value IS NOT NULL")


def pivot(facts: DataFrame, fields: list[str]) -> DataFrame:
    """The other way round: named fields need no pass for their names."""
    return facts.groupBy("listing_id").pivot("field", fields).agg(F.first("value"))


def overlay(base: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """Resolved facts over a base row."""
    f = pivot(facts, fields).select(F.col("listing_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in fields))
    return base.join(f, base["listing_id"] == f["_id"], "left").select(*(F.coalesce(f[f"_{c}"], base[c].cast("string")).alias(c) if c in fields else base[c] for c in base.columns))


def merge_field(known: Column, known_origin: Column, new: Column, new_origin: Column) -> Column:
    """A new value replaces a known one where its origin ranks as high; one that is absent never does."""
    return F.when(new.isNull(), known).when(known.isNull() | (precedence(new_origin) >= precedence(known_origin)), new).otherwise(known)


def fillable(value: Column, absence: Column) -> Column:
    """Only what isn't stated may be filled; a contradiction may not."""
    return value.isNull() & F.coalesce(absence == "not_stated", F.lit(True))


def fact_diff(before: DataFrame, after: DataFrame, key: tuple[str, ...] = ("listing_id", "field")) -> DataFrame:
    """Fields whose value is another one, with both."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return a.join(b, list(key), "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select(*key, "before", "after")


def new_claims(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Claims that aren't stored with the same value, origin, confidence and evidence; null equals null."""
    s = stored.select(*(F.col(c).alias(f"_{c}") for c in ("listing_id", "field", "value", "origin", "confidence", "evidence")))
    on = [incoming[c] == s[f"_{c}"] for c in ("listing_id", "field", "value", "origin")] + [incoming[c].eqNullSafe(s[f"_{c}"]) for c in ("confidence", "evidence")]
    return incoming.join(s, on, "left_anti")


def keep_newest(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= n)


def latest(rows: DataFrame, *key: str, by: str) -> DataFrame:
    """The row of the largest `by` for each key: an aggregate, reduced on the map side."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def best_by_precedence(claims: DataFrame, *key: str) -> DataFrame:
    """Of each key's claims the one of the highest precedence, the first of equals: an aggregate, reduced on the map side, so a
    key's history never stands in one place."""
    order = F.struct(precedence(F.col("origin")).alias("p"), (-F.col("claim_id")).alias("first"))
    rest = [c for c in claims.columns if c not in key]
    return claims.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def change_counts(claims: DataFrame) -> DataFrame:
    """Corrections of each entity: what a counter kept by triggers would hold."""
    return claims.filter("origin = 'user'").groupBy("listing_id").agg(F.count(F.lit(1)).alias("corrections"), F.countDistinct("field").alias("fields"))


def fingerprint(claims: DataFrame) -> DataFrame:
    """A hash over an entity's ordered claims."""
    one = F.array_sort(F.collect_list(F.struct("claim_id", "field", "value")))
    return claims.groupBy("listing_id").agg(F.sha2(F.to_json(one), 256).alias("fingerprint"))
