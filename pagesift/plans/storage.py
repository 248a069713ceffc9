"""Scratch tables in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a lookup table that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Spark's setting by which a query's shuffle files go when it ends; a written table needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``; in local mode, as in tests, a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/pagesift/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", batch: int | None = None, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: its lineage starts at those files.

    With ``path``, of ``scratch_path``, the rows are added to those that are there.

    A lost executor costs its running tasks only, and each later reader sees the same rows. ``batch`` bounds the
    rows handed to Python at once where rows are long texts, so that a worker's memory stays small. The write's shuffle
    files are removed when it ends.
    """
    spark = df.sparkSession
    added, path = bool(path), path or scratch_path(spark, name)
    with settings(spark, {CLEANUP: "true"}), arrow_batches(spark, batch):
        df.write.mode("append" if added else "error").options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer parts than there are, as a small file of one row group does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what is planned and run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def arrow_batches(spark: SparkSession, rows: int | None):
    """Bound the rows of an Arrow batch for what is planned and run inside; None leaves the session's own bound."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})


def discard(written: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a lookup table, broadcasting it only if it is counted at ``max_rows`` rows or fewer.

    Pass a materialised ``small``: it is counted, then read again. Larger tables take the shuffle join, whose
    hot keys adaptive execution splits.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
