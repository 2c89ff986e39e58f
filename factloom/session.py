"""What every session needs of this library."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Of rows that a Python worker gets at once (Spark's own bound is 64 MB, for each of an executor's workers), and rows that a
#: scan decodes at once (texts of that many rows are one array).
ARROW_BYTES, SCAN_ROWS = 1 << 20, 1024

_built: dict = {}


def per_session(f):
    """f's value is kept for each Spark application and repr of its arguments: for expressions of hundreds of parts, each of
    which is a call to the JVM."""

    @functools.wraps(f)
    def kept(*args):
        key = f, SparkContext._active_spark_context.applicationId, repr(args)
        if key not in _built:
            _built[key] = f(*args)
        return _built[key]

    return kept


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names, which all executors share: cuts the lineage, and survives lost
    executors. Only where that is unset, and driver and executors are one process, a temporary folder of this machine is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df's rows dealt anew by key: a scan gives the rows of a small file to few tasks (those of a row group to one), however much
    work each of them will be."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application: Spark's file server gives it to each of them, also
    to those that start later, so that nothing need be installed there. The batches of this session are bounded."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", None) is None:
        to = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, str(f.relative_to(_PACKAGE.parent)))
        sc.addPyFile(to)
        sc._factloom_shipped = to
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
    return spark
