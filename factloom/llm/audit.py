"""Filter interaction audit: how much each of five filters removes, and what of it others would have removed, in every order.

Direct relational replay: each document's flags (one bit for each filter that it fails) are crossed with the 120 orders, a
broadcast table of fixed size; the five steps of an order are exploded; a step sees whether the document is still there, by
the first step that it fails; and conditional sums by part, order and step are combined on the map side, so a task sends 600
rows for each part, however many documents it has. Texts are read once: flags, and a digest for the equality of texts, are a
table in the shared folder.

Filters (a document that meets the condition fails): A under MIN_WORDS words; B fewer different words than DISTINCT_PERCENT
of all; C more capitals A-Z than CAPITAL_PERCENT of the code points; D a symbol of SYMBOLS; E the text of a smaller doc_id.

Edge cases: a null text counts as empty, and equals an empty one; a null lang is the part '' (with documents whose lang is
''); a row without doc_id has no smaller doc_id and is none (it never fails E), and has no labels; repeated rows count each,
and rows of one doc_id aren't smaller than each other; of several labels of a doc_id, one that says 1 is enough; null labels
say nothing; an empty table gives an empty result; further columns are dropped, whatever they are called.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D) and the digest of the whole text."""
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"], F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)))
    n = F.size("words")
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    ]
    bits = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(failed)), F.lit(0))
    return d.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), good and toxic, a row for each row of docs. Both joins take a table for their smaller
    side, so that adaptive execution can split what a digest or an id of many rows fills."""
    own = common.materialize(own_flags(docs))
    first = own.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    first = common.materialize(first.filter("copies > 1").select("digest", "first_id"))
    said = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    said = common.materialize(said.agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic")))
    late = F.when(F.col("doc_id") > F.col("first_id"), F.lit(1 << 4)).otherwise(F.lit(0))
    d = own.join(first, "digest", "left").select("doc_id", "part", F.col("fails").bitwiseOR(late).alias("fails"))
    return d.join(said, "doc_id", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """place (0 to 119) and bits, those of the filters in their order."""
    return spark.createDataFrame([(i, [1 << FILTERS.index(x) for x in o]) for i, o in enumerate(ORDERS)], "place int, bits array<int>")


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and COUNTS, for each part, order and step."""
    bit = lambda i: F.col("bits")[i]
    first = F.lit(len(FILTERS) + 1)
    for i in reversed(range(len(FILTERS))):
        first = F.when(F.col("fails").bitwiseAND(bit(i)) != 0, F.lit(i + 1)).otherwise(first)
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession))).withColumn("first", first)
    steps = crossed.select("part", "place", "fails", "good", "toxic", "first", F.posexplode("bits").alias("before", "bit")).withColumn("step", F.col("before") + 1)
    removed = F.col("first") == F.col("step")
    when = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": (F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    summed = steps.groupBy("part", "place", "step").agg(*(F.sum(x.cast("long")).alias(name) for name, x in when.items()))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("place") + 1)
    return summed.select("part", order.alias("filter_order"), "step", F.substring(order, F.col("step"), F.lit(1)).alias("filter"), *COUNTS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """replay() of documents, with shapley: what a filter removes, summed over all orders."""
    from pyspark.sql.window import Window

    of_filter: Column = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 rows
    return replay(flagged(docs, labels)).withColumn("shapley", of_filter)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
m AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      (len(words) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
      + 4 * (100 * len(regexp_extract_all(w.text, '[A-Z]')) > {CAPITAL_PERCENT} * length(w.text))::INT
      + 8 * regexp_matches(w.text, '{SYMBOLS}')::INT + 16 * (w.doc_id > first_id)::INT AS fails
      FROM w JOIN m USING (text) LEFT JOIN l USING (doc_id)),
o AS (SELECT unnest({ORDERS}) AS filter_order),
s AS (SELECT part, good, toxic, fails, filter_order, list_transform(range(1, 6), lambda i: 1 << (ascii(filter_order[i]) - 65)) AS bits FROM f, o),
c AS (SELECT *, coalesce(list_position(list_transform(bits, lambda b: (fails & b) > 0), true), 6) AS first FROM s),
e AS (SELECT *, unnest(range(1, 6)) AS step FROM c),
r AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter,
      sum((first > step)::INT)::BIGINT AS kept, sum((first = step)::INT)::BIGINT AS removed,
      sum((first < step AND (fails & bits[step]) > 0)::INT)::BIGINT AS redundant, sum((fails = bits[step])::INT)::BIGINT AS unique_fails,
      sum((first = step)::INT * good)::BIGINT AS good_lost, sum((first = step)::INT * toxic)::BIGINT AS toxic_lost
      FROM e GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
