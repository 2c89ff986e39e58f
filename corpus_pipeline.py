"""The corpus pipeline: language ID, toxicity, near duplicates, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of `documents`; the last
returns the pieces of the packed sequences. Between stages the documents are a table in the shared folder.

Every stage takes nulls in any column, empty tables, repeated rows and texts of any length, as its operator does; further
columns are dropped, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, jaccard, language, mixing, packing, toxicity
from factloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and a number for each row, which holds until this table is written anew: rows that are
    equal, or have no doc_id, stay apart."""
    return common.materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(_ROW)))


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose numbers are in verdicts."""
    return docs.join(verdicts.select(_ROW), _ROW, "left_semi").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language that is known, or of none with enough certainty, go."""
    rows = _numbered(docs)
    records = rows.select(_ROW, "text", F.lit(False).alias("html"), F.col("lang").alias("declared"), F.col("source").alias("host"))
    return _kept(rows, language.identify(records, language.train(rows), [_ROW]).filter("kept"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are predicted to be toxic go. The labels are those of the tables, the model is learnt from this stage's documents."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of the least doc_id stays, and all documents without words."""
    rows = _numbered(docs)
    named = jaccard.join(rows.select(F.col(_ROW).alias("doc_id"), "text"))  # row numbers for ids: one row of each component is its name
    named = named.select(F.col("doc_id").alias(_ROW), "component_id")
    first = rows.select(_ROW, "doc_id").join(named, _ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _ROW)).alias("one"))
    return _kept(rows, first.select(F.col(f"one.{_ROW}").alias(_ROW)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it: whole times, and once more by chance, at the odds of the
    part of it that the mix takes besides (decided by a hash, so that reruns agree). So a source's words come near its target,
    but for what whole copies are more or less than the words taken. Documents without words stay."""
    rows = _numbered(docs)
    taken = mixing.mix(rows, keep=(_ROW,))[0]
    share = F.col("taken") / F.col("size")
    odds = F.pmod(F.xxhash64("doc_id", "size", F.lit(mixing.SEED)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(share) + (odds < share - F.floor(share)).cast("int")).cast("int")
    times = taken.select(_ROW, copies.alias("copies")).filter("copies > 0")
    return rows.join(times, _ROW).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


_scratch: list[common.Scratch] = []


def _stage(f):
    """A stage deletes the tables that the stage before it worked with: by then that one's result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            old = _scratch.pop()
            if old.spark is spark:
                common.release(spark, old.paths_at_end)
        with_own = common.Scratch(ship(spark)).__enter__()
        out = f(spark, docs, sf_dir)
        with_own.paths_at_end = with_own.paths
        _scratch.append(with_own)
        return out

    run.__doc__ = f.__doc__
    return run


STAGES = [
    ("language_id", _stage(language_id)),
    ("toxicity", _stage(toxicity_filter)),
    ("near_duplicates", _stage(near_duplicates)),
    ("mixing", _stage(mixture)),
    ("packing", _stage(packed)),
]

#: Trained models, and tokens, aren't expressible in SQL: tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = common.table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        common.release(spark, [path] if path else [])
        path = docs.materialized
    return STAGES[-1][1](spark, docs, sf_dir)
