"""Shared pieces of the corpus operators: reading tables, tables in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from factloom.session import ship

#: Words everywhere in this package: runs of anything but space, tab, LF, VT, FF and CR (Java regex).
WORD = r"[^ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes handled at once in a Python worker. A single longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Rows of a file, where it is known how many there will be.
FILE_ROWS = 8_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset, and driver and executors are
    one process (tests, local mode), a temporary folder of this machine is set instead."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _hadoop_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _hadoop_delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder takes over
            return


def materialize(df: DataFrame, compression: str = "snappy", files: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage, and survives lost
    executors, because every reader takes the files rather than one executor's blocks. The files go when the
    driver ends. files: at most so many, where the writer knows that its rows are few."""
    if files is not None:
        df = df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized = path
    return out


def files_for(spark: SparkSession, rows: int) -> int:
    """How many files rows of the size of a document's id and hashes fill, and a task for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that nothing reads any more."""
    for path in paths:
        _hadoop_delete(spark, path)
        _written.remove((spark, path))


class Scratch:
    """with Scratch(spark) as s: tables materialized inside are deleted at the end, but for those given to s.keep()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.before = {p for _, p in _written}
        return self

    @property
    def paths(self) -> list[str]:
        return [p for s, p in _written if s is self.spark and p not in self.before and p not in self.kept]

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.materialized)
        return df

    def __exit__(self, *_: object) -> None:
        release(self.spark, self.paths)


def pieces(batches: Iterator[pa.RecordBatch], by: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices whose column `by` holds about `most` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > first and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: further columns of an input, whatever they are called, can't clash with an operator's own."""
    return df.select(*(df[n] for n in names))
