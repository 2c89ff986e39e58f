"""Sinks: append-only logs, projections that are written anew, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, partition: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that rows hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def entity_state(events: DataFrame) -> DataFrame:
    """What an upsert of each event would leave: the first time seen, the last, and the last status."""
    return events.groupBy("listing_id").agg(F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.max_by("status", F.struct("fetched_at", "record_id")).alias("status"))


def latest_by_key(events: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Upserts by key as an aggregate over their log."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_usable(events: DataFrame, key: str, value: str, usable: Column, order: str) -> DataFrame:
    """The latest value, or the latest usable one where the latest isn't."""
    return events.groupBy(key).agg(F.max_by(F.when(usable, F.col(value)), F.when(usable, F.col(order))).alias(value), F.max_by(usable, F.col(order)).alias("current"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def calendar_event(uid: Column, title: Column, start: Column) -> Column:
    """One hour, as an iCalendar text."""
    at = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART:"), at(start)), F.concat(F.lit("DTEND:"), at(start + F.expr("INTERVAL 1 HOUR"))), F.concat(F.lit("SUMMARY:"), title), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))


def notices(scored: DataFrame, new_ids: DataFrame, n: int = 10) -> DataFrame:
    """The n best of the new entities, each by its best score."""
    best = scored.join(new_ids, "listing_id", "left_semi").groupBy("listing_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "listing_id").limit(n)
