"""Health of sources: bands around what is usual, watermarks that may be vetoed, histories of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SEVERITY

#: Runs that a band looks back on, how many it needs, and its sides as shares of the median.
LOOK_BACK, LEAST_RUNS, LOW, HIGH = 5, 3, 0.6, 1.6


def severity(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), status)


def worst(status: Column) -> Column:
    """An aggregate: the status of the highest severity."""
    return F.max_by(status, severity(status))


def bands(runs: DataFrame) -> DataFrame:
    """source, runs, median, low, high: of each source's newest LOOK_BACK runs, null sides with fewer than LEAST_RUNS.

    The cut to a few runs of a source happens before the shuffle (window group limit)."""
    w = Window.partitionBy("source").orderBy(F.desc("day"))
    recent = runs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LOOK_BACK)
    g = recent.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.median("n").alias("median"))
    enough, m = F.col("runs") >= LEAST_RUNS, F.col("median")
    low = F.when(m <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(m * LOW)))
    high = F.when(m <= 0, F.lit(0)).otherwise(F.ceil(m * HIGH))
    return g.select("source", "runs", "median", F.when(enough, low).cast("long").alias("low"), F.when(enough, high).cast("long").alias("high"))


def watermark_decision(runs: DataFrame) -> DataFrame:
    """For the newest run of each source, against its runs before: whether its watermark may advance. It does if the run is
    in the band (or there is none yet) and its newest event is newer than the watermark; a run without rows, where a band
    wants some, is an alert."""
    w = Window.partitionBy("source").orderBy(F.desc("day"))
    placed = runs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LOOK_BACK + 1)
    now = placed.filter("r = 1").select("source", F.col("n").alias("now"), F.col("newest").alias("candidate"))
    before = placed.filter("r > 1")
    marks = before.groupBy("source").agg(F.max("newest").alias("watermark"))
    d = now.join(bands(before.drop("r")), "source", "left").join(marks, "source", "left")
    inside = F.col("low").isNull() | F.col("now").between(F.col("low"), F.col("high"))
    newer = F.col("watermark").isNull() | (F.col("candidate") > F.col("watermark"))
    return d.select(
        "source",
        "now",
        "low",
        "high",
        inside.alias("in_band"),
        newer.alias("newer"),
        (inside & newer).alias("advance"),
        ((F.col("now") == 0) & (F.col("low") > 0)).alias("alert"),
        F.when(inside & newer, F.col("candidate")).otherwise(F.col("watermark")).alias("next_watermark"),
    )


def histories(runs: DataFrame, limit: int = 30) -> DataFrame:
    """source, counts (newest first, `limit` at most), watermark: the newest that is known."""
    w = Window.partitionBy("source").orderBy(F.desc("day"))
    recent = runs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)
    ordered = F.array_sort(F.collect_list(F.struct("r", "n")))
    return recent.groupBy("source").agg(F.transform(ordered, lambda x: x.n).alias("counts"), F.max_by("newest", F.when(F.col("newest").isNotNull(), -F.col("r"))).alias("watermark"))


def seen_recently(bridge: DataFrame, records: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(source, source_id) whose newest record is of the last hours: not to be fetched again."""
    key = ["listing_id", "source", "source_id"]
    last = bridge.select(*key).distinct().join(records, key).groupBy("source", "source_id").agg(F.max("fetched_at").alias("fetched_at"))
    return last.filter(F.col("fetched_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def counts_document(runs: DataFrame) -> DataFrame:
    """day, doc: a run's counts by source as JSON."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
    return runs.groupBy("day").agg(F.to_json(m).alias("doc"))
