"""Jobs that workers claim for a time: a keyed state with timers, the same fold over a table, and what a worker does.

A job is queued, claimed by a worker (who holds a token until its lease is over), and done, failed, refused or cancelled. A lease
that is over queues the job again, or fails it when ATTEMPTS claims are used up; so does a failure; what is refused has failed
for good. Who reports with another token than the one that holds the job is not heard."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .incremental import ATTEMPTS, LEASE_S

ENDED = "succeeded", "failed", "cancelled"
#: How far events may be behind each other.
LATE = "10 minutes"
_OUT = "job string, at timestamp, state string, attempts int, why string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Job:
    """until: when the lease is over, in milliseconds."""

    state: str = "queued"
    attempts: int = 0
    token: str | None = None
    until: int | None = None

    def over(self, now: int) -> bool:
        return self.state == "running" and self.until <= now

    def again(self) -> Job:
        return Job("failed" if self.attempts >= ATTEMPTS else "queued", self.attempts)

    def after(self, kind: str, token: str | None, at: int, lease: int) -> Job:
        if self.state in ENDED:
            return self
        if kind == "cancelled":
            return Job("cancelled", self.attempts)
        if self.state == "queued":
            return Job("running", self.attempts + 1, token, at + lease) if kind == "claimed" else self
        if token != self.token or kind not in ("done", "failed", "refused"):
            return self
        return Job("succeeded" if kind == "done" else "failed", self.attempts) if kind != "failed" else self.again()


def _ms(at: datetime.datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or datetime.UTC).timestamp() * 1000)


def _time(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC)


class Leases(StatefulProcessor):
    """A job's state by its key; the timer of a claim queues the job again, without any event of its own."""

    def __init__(self, lease_s: int):
        self.lease = lease_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", "state string, attempts int, token string, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        job = Job(*self.state.get()) if self.state.exists() else Job()
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            at = _ms(r.at)
            if job.over(at):
                until, job = job.until, job.again()
                yield _moved(key, until, job, "lease")
            before, job = job, job.after(r.kind, r.token, at, self.lease)
            if job != before:
                yield _moved(key, at, job, r.kind)
            if job.until and job != before:
                self.handle.registerTimer(job.until)
        self.state.update((job.state, job.attempts, job.token, job.until))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        job = Job(*self.state.get())
        if job.over(expiredTimerInfo.getExpiryTimeInMs()):  # else its worker has reported meanwhile
            until, job = job.until, job.again()
            self.state.update((job.state, job.attempts, job.token, job.until))
            yield _moved(key, until, job, "lease")


def _moved(key: tuple, at: int, job: Job, why: str) -> Row:
    return Row(job=str(key[0]), at=_time(at), state=job.state, attempts=job.attempts, why=why)


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which keyed state with timers needs; the session's setting is
    put back afterwards."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def transitions(events: DataFrame, lease_s: int = LEASE_S, late: str = LATE) -> DataFrame:
    """A stream's job, at, state, attempts, why (the event's kind, or lease), a row for each change of a job. events: job, seq,
    kind (queued, claimed, failed, refused, done, cancelled), token, at. To be started within rocksdb()."""
    e = events.select(F.col("job").cast("string").alias("job"), "seq", "kind", "token", "at").withWatermark("at", late)
    return e.groupBy("job").transformWithState(Leases(lease_s), _OUT, "append", "EventTime")


def leased_states(events: DataFrame, now: str, lease_s: int = LEASE_S) -> DataFrame:
    """job, state, attempts, token at a time: what transitions() comes to, over a table. A task streams over its jobs' events in
    order and holds one job; what has ended isn't read on, so a job's history is as short as its attempts."""
    kind = events.schema["job"].dataType.simpleString()
    end = int(events.sparkSession.sql("SELECT unix_millis(CAST(:t AS TIMESTAMP)) AS x", args={"t": now}).first().x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for key, at, what, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != key:
                    if held is not None:
                        out.append(held)
                    held = key, Job()
                job = held[1].again() if held[1].over(at) else held[1]
                held = key, job.after(what, token, at, lease_s * 1000)
            yield _rows(out, batch.schema.field(0).type)
            kind_of = batch.schema.field(0).type
        if held is not None:
            yield _rows([held], kind_of)

    def _rows(jobs: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        now_ = [(k, j.again() if j.over(end) else j) for k, j in jobs]
        columns = [[k for k, _ in now_], *([getattr(j, f) for _, j in now_] for f in ("state", "attempts", "token"))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.string(), pa.int32(), pa.string()), strict=True)], ["job", "state", "attempts", "token"])

    e = events.select("job", F.unix_millis("at").alias("at"), "kind", "token", "seq").repartition("job").sortWithinPartitions("job", "at", "seq").drop("seq")
    return e.mapInArrow(run, f"job {kind}, state string, attempts int, token string")


def claimed(jobs: DataFrame, worker: str, now: str, n: int = 1, lease_s: int = LEASE_S) -> DataFrame:
    """The n oldest jobs that are due, as their claims: an event for each, with the worker's token. jobs: job, state, attempts,
    requested_at, due_at."""
    due = jobs.filter((F.col("state") == "queued") & (F.col("attempts") < ATTEMPTS) & (F.col("due_at") <= F.lit(now).cast("timestamp")))
    token = F.sha2(F.concat_ws("|", F.lit(worker), F.lit(now), F.col("job").cast("string")), 256)
    return due.orderBy("requested_at", "job").limit(n).select("job", F.lit("claimed").alias("kind"), token.alias("token"), F.lit(now).cast("timestamp").alias("at"))


#: States of a fetched page that are as good as it gets, that will do, and characters of an error that are kept.
FOR_GOOD, USABLE, MOST_ERROR = ("removed", "blocked"), ("complete", "partial"), 500


def worked(claims: DataFrame, requested: DataFrame, fetch: Callable[[dict], dict], sources: list[str], now: str) -> DataFrame:
    """What a worker reports of the jobs that it has claimed: events as transitions() takes them (job, kind, token, at), with outcome,
    error and payload (JSON).

    claims: job, token. requested: job, source, source_id, url, payload: the record that a job is to bring up to date; sources: those
    that can be asked. fetch(record) gives status, payload and, it may be, error; what it raises is that job's failure, and the others go
    on. A job without a record, of a source that can't be asked, or whose page is gone for good is refused; complete and
    partial pages are done; all else has failed, and may be tried again. Jobs are fetched by all executors, each once."""
    import json

    r = requested.select("job", "source", "source_id", "url", "payload").withColumn("known", F.lit(True))
    todo = claims.select("job", "token").join(r, "job", "left")
    kind = claims.schema["job"].dataType.simpleString()
    names = ["job", "kind", "token", "outcome", "error", "payload"]

    def one(row: dict) -> tuple:
        if not row["known"]:
            return "refused", "record_missing", "the record isn't there any more", None
        if row["source"] not in sources:
            return "refused", "source_unavailable", f"source {row['source']!r} can't be asked", None
        try:
            got = fetch({k: row[k] for k in ("source", "source_id", "url", "payload")})
            status, error = got.get("status"), got.get("error")
            if status in FOR_GOOD:
                return "refused", status, error, None
            if status in USABLE:
                return "done", status, error, json.dumps(got.get("payload"), sort_keys=True)
            return "failed", "failed", error or "no usable detail", None
        except Exception as e:  # one job's failure is not the others'
            return "failed", "failed", f"{type(e).__name__}: detail update failed", None  # what it says may quote the page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            said = [one(r) for r in rows]
            errors = [" ".join(e.split())[:MOST_ERROR] if e else None for _, _, e, _ in said]
            columns = [batch.column("job"), *(pa.array(x, pa.string()) for x in ([k for k, *_ in said], [r["token"] for r in rows], [o for _, o, *_ in said], errors, [p for *_, p in said]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return todo.mapInArrow(run, f"job {kind}, kind string, token string, outcome string, error string, payload string").withColumn("at", F.lit(now).cast("timestamp"))


def plain(events: list[tuple], end: int, lease_s: int = LEASE_S) -> tuple[dict, list[tuple]]:
    """Of (job, seq, kind, token, ms): each job's state at the end, and its changes; the fold that the stream has to agree with."""
    jobs, moves = {}, []
    for key, _, kind, token, at in sorted(events, key=lambda e: (e[4], e[1])):
        job = jobs.get(key, Job())
        if job.over(at):
            moves.append((key, job.until, job.again(), "lease"))
            job = job.again()
        new = job.after(kind, token, at, lease_s * 1000)
        if new != job:
            moves.append((key, at, new, kind))
        jobs[key] = new
    for key, job in jobs.items():
        if job.over(end):
            moves.append((key, job.until, job.again(), "lease"))
            jobs[key] = replace(job.again())
    return jobs, moves
