"""Incremental runs: Structured Streaming over landed batches, stateful deduplication, a queue of jobs with leases.

The batch forms are what the streams have to agree with; tests hold them together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: When what was seen is forgotten, leases and attempts of jobs, the longest wait between attempts.
FORGET_DAYS, LEASE_S, ATTEMPTS, LONGEST_WAIT_S = 90, 300, 3, 30


def run_available(spark: SparkSession, schema: str, path: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """One incremental run: what has landed since the last one, in micro-batches, each given to `each` with its number (a
    batch that is tried again has the same number)."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream's counts by window and type, late rows dropped past the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_arrivals(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Batch form of deduplication by signature: the first row of each, in the order of arrival."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("r = 1").drop("r")


def dedupe(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One run. rows: id, sig, at (order), ok (criteria). seen: id, sig of what earlier runs accepted. outcome of each row:

    refresh: an earlier run accepted its id, whatever its signature is now (a price that changes makes a new signature);
    touch: not its id, but its signature is known from an earlier run; repeat: this run has accepted its signature before;
    accept: none of these, and it meets the criteria; exclude: it doesn't, which leaves its id and its signature free.
    Rows without an id are left out. An id that this run accepted isn't known before the next one.

    What is known beforehand is two joins; within the run a signature's first acceptance tells all, which is an aggregation and
    a join: no id's and no signature's history is ever sorted in one task."""
    order = F.struct("at", "id")
    r = rows.filter(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).select("id", "sig", "at", "ok")
    known = F.lit(None).cast("string")
    if seen is not None:
        ids, sigs = seen.select("id", F.lit(True).alias("by_id")).distinct(), seen.select("sig", F.lit(True).alias("by_sig")).distinct()
        r = r.join(ids, "id", "left").join(sigs, "sig", "left")
        known = F.when(F.col("by_id"), "refresh").when(F.col("by_sig"), "touch")
    r = r.select("id", "sig", "at", "ok", known.alias("known"))
    first = r.filter("ok and known is null").groupBy("sig").agg(F.min(order).alias("first"))
    out = r.join(first, "sig", "left")
    new = F.when(F.col("first").isNull() | (order < F.col("first")), "exclude").when(order == F.col("first"), "accept").otherwise("repeat")
    return out.select("id", "sig", "at", F.coalesce("known", new).alias("outcome"))


def seen_after(outcomes: DataFrame, seen: DataFrame | None, now: str) -> DataFrame:
    """id, sig, first_seen, last_seen after a run: what was accepted is seen from now on (an id by its last signature), what was
    refreshed or touched is seen again; of the ids of one signature, a touch counts for the last that came."""
    at = F.lit(now).cast("timestamp")
    new = outcomes.filter("outcome = 'accept'").groupBy("id").agg(F.max_by("sig", F.struct("at", "sig")).alias("sig"))
    new = new.select("id", "sig", at.alias("first_seen"), at.alias("last_seen"))
    if seen is None:
        return new
    ids = outcomes.filter("outcome = 'refresh'").select("id", F.lit(True).alias("again")).distinct()
    touched = outcomes.filter("outcome = 'touch'").select("sig").distinct()
    last = seen.join(touched, "sig", "left_semi").groupBy("sig").agg(F.max_by("id", F.struct("first_seen", "id")).alias("id"))
    again = ids.union(last.select("id", F.lit(True))).distinct()
    kept = seen.join(again, "id", "left").select("id", "sig", "first_seen", F.when(F.col("again"), at).otherwise(F.col("last_seen")).alias("last_seen"))
    return kept.unionByName(new)


def dedupe_batch(path: str, now: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch (see run_available): each micro-batch is a run. What is seen after batch n, and its outcomes, are tables under
    path that carry its number, so a batch that is tried again reads the same state and writes the same."""

    def each(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        seen = spark.read.parquet(f"{path}/seen/{n - 1}") if n else None
        dedupe(rows, seen).write.mode("overwrite").parquet(f"{path}/outcomes/{n}")
        seen_after(spark.read.parquet(f"{path}/outcomes/{n}"), seen, now(n)).write.mode("overwrite").parquet(f"{path}/seen/{n}")

    return each


def arrivals(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream's rows without repeats of a key; what comes behind the watermark (`late` after the newest of the batch before) is
    dropped, and counted by the query (dropped_late)."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def dropped_late(progress: list) -> int:
    """Rows that a query's stateful operators have dropped behind the watermark, by its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def forget(state: DataFrame, now: str, days: int = FORGET_DAYS) -> DataFrame:
    """What was seen in the last days; a time that can't be read is kept."""
    at = F.try_to_timestamp("last_seen")
    return state.filter(at.isNull() | (at >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def _job_step(state: str, attempts: int, kind: str) -> tuple[str, int]:
    if state in ("succeeded", "failed", "cancelled"):
        return state, attempts
    if kind == "cancelled":
        return "cancelled", attempts
    if kind == "claimed" and state == "queued":
        return "running", attempts + 1
    if state == "running" and kind == "done":
        return "succeeded", attempts
    if state == "running" and kind == "failed":
        return ("failed" if attempts >= ATTEMPTS else "queued"), attempts
    return state, attempts


def job_states(events: DataFrame) -> DataFrame:
    """events: job, seq, kind (queued, claimed, failed, done, cancelled). The state that they leave, folded in the order of seq:
    done and cancelled end a job; a failure queues it again until ATTEMPTS claims are used up. Each task streams over its jobs'
    events in order and holds one job's state."""
    kind = events.schema["job"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started, job_type = None, ("queued", 0), False, None
        for batch in batches:
            job_type, ended = batch.schema.field(0).type, []
            for job, what in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and job != now:
                    ended.append((now, *state))
                    state = "queued", 0
                now, started = job, True
                state = _job_step(*state, what)
            yield _jobs(ended, job_type)
        if started:
            yield _jobs([(now, *state)], job_type)

    def _jobs(rows: list[tuple], job_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (job_type, pa.string(), pa.int32()), strict=True)], ["job", "state", "attempts"])

    ordered = events.repartition("job").sortWithinPartitions("job", "seq").select("job", "kind")
    g = ordered.mapInArrow(run, f"job {kind}, state string, attempts int")
    return g.withColumn("wait_s", F.when((F.col("state") == "queued") & (F.col("attempts") > 0), F.least(F.lit(LONGEST_WAIT_S), F.pow(F.lit(2), F.col("attempts")).cast("int"))))


def claimable(jobs: DataFrame, now: str, n: int = 1) -> DataFrame:
    """The oldest jobs that are due: queued ones, and running ones whose lease is over with attempts left."""
    t = F.lit(now).cast("timestamp")
    due = (F.col("state") == "queued") & (F.col("due_at") <= t)
    lost = (F.col("state") == "running") & (F.col("leased_at") + F.expr(f"INTERVAL {LEASE_S} SECONDS") < t) & (F.col("attempts") < ATTEMPTS)
    return jobs.filter(due | lost).orderBy("requested_at", "job").limit(n)


def new_revision(pending: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals that don't repeat a pending preview of the same entity and hash."""
    return proposed.join(pending.filter("state = 'preview'").select("listing_id", "hash"), ["listing_id", "hash"], "left_anti")


def current_revisions(revisions: DataFrame) -> DataFrame:
    """For each entity the applied revision that isn't superseded: the last one applied."""
    return revisions.filter("state = 'applied'").groupBy("listing_id").agg(F.max_by(F.struct("revision", "hash"), "applied_at").alias("x")).select("listing_id", "x.revision", "x.hash")


def stale(previews: DataFrame, now: DataFrame, fingerprints: list[str]) -> DataFrame:
    """Previews of which some fingerprint isn't what it was; null equals null."""
    n = now.select("listing_id", *(F.col(c).alias(f"now_{c}") for c in fingerprints))
    same = [F.col(c).eqNullSafe(F.col(f"now_{c}")) for c in fingerprints]
    every = same[0]
    for x in same[1:]:
        every = every & x
    return previews.join(n, "listing_id", "left").filter(~every).select(*previews.columns)
