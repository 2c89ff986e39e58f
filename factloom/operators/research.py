"""Search results about an address: which of them are accepted, and why the others aren't, counted in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import address

#: Days that a result is good for, results that a search may bring, results that are accepted of a subject.
DAYS, MOST_FOUND, MOST_ACCEPTED = 730, 8, 20
OUTCOMES = ["accepted", "skipped", "repeat", "stale", "untitled", "irrelevant", "unread"]


def outcomes(found: DataFrame, now: str) -> DataFrame:
    """found with outcome and match. found: subject (an address), city, search, place (the order within a search, from 0), url,
    title, excerpt, published (as text).

    In this order: skipped (no address of the web), repeat (the subject's earlier results had it), stale (no date, or one out of
    the last DAYS), untitled, irrelevant (it doesn't speak of the subject's address and of no other, in its city), else accepted;
    unread is what comes after a subject's MOST_ACCEPTED-th accepted one. What a search brings beyond MOST_FOUND is left out."""
    today = F.lit(now).cast("date")
    r = found.filter(F.col("place") < MOST_FOUND).withColumn("url", F.trim(F.coalesce("url", F.lit("")))).withColumn("at", F.struct("search", "place"))
    first = r.groupBy("subject", "url").agg(F.min("at").alias("first"))
    r = r.join(first, ["subject", "url"])
    published = S.published_date(F.trim("published"))
    recent = F.coalesce((published >= F.date_sub(today, DAYS)) & (published <= today), F.lit(False))
    test: Column = (
        F.when(~F.col("url").rlike(r"(?i)^https?://[^/?#\s]+"), "skipped")
        .when(F.col("at") > F.col("first"), "repeat")
        .when(~recent, "stale")
        .when(F.trim(F.coalesce("title", F.lit(""))) == "", "untitled")
    )
    r = r.withColumn("outcome", test)
    about = F.when(F.col("outcome").isNull(), address.about(F.col("subject"), F.col("city"), F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    r = r.withColumn("about", about).withColumn("outcome", F.coalesce("outcome", F.when(F.col("about"), "accepted").otherwise("irrelevant"))).drop("about", "first")
    # few results are accepted of a subject: their order is an array, the last that counts is its MOST_ACCEPTED-th
    last = r.filter("outcome = 'accepted'").groupBy("subject").agg(F.sort_array(F.collect_list("at")).alias("all")).filter(F.size("all") > MOST_ACCEPTED)
    last = last.select("subject", F.col("all")[MOST_ACCEPTED - 1].alias("last"))
    r = r.join(last, "subject", "left")
    return r.withColumn("outcome", F.when(F.coalesce(F.col("at") > F.col("last"), F.lit(False)), "unread").otherwise(F.col("outcome"))).drop("at", "last")


def counted(judged: DataFrame, name: str = "research") -> tuple[DataFrame, Observation]:
    """The accepted rows of outcomes(), and how many rows came to each outcome: counted while these rows are read, by whatever
    action reads them; Observation.get has the counts then."""
    seen = Observation(name)
    return judged.observe(seen, *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)).filter("outcome = 'accepted'"), seen


def in_order(accepted: DataFrame) -> DataFrame:
    """A subject's results as they are shown: the newest first, then by source and title."""
    return accepted.orderBy("subject", F.desc("published_at"), "source", "title")
