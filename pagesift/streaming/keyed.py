"""A Parquet table with one row for each key that a stream keeps up to date, bucket by bucket.

A batch reads and rewrites only the buckets that its keys fall in. Each change is a new folder with the touched buckets
and a new version, one small file that names the folder of every bucket; a version counts once Spark has committed
that file. A batch that runs again after a failure finds itself in the latest version and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Buckets of a key's hash, fixed for the life of a table.
BUCKETS = 64
#: Versions whose folders stay for readers that have begun.
KEPT = 2


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    fs, pattern = _files(spark, f"{path}/_versions/*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()) for f in fs.globStatus(pattern) or [])


def state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``buckets``, each one's folder, and ``batches``, the last batch of each stream, of a version (the latest by default)."""
    if version is None:
        version = max(versions(spark, path), default=None)
    return json.loads(spark.read.text(f"{path}/_versions/{version}").first()[0]) if version is not None else {"buckets": {}, "batches": {}}


def read(spark: SparkSession, path: str, schema: StructType, only: list[str] | None = None) -> DataFrame:
    """The table's rows, or those of the buckets ``only``."""
    found = state(spark, path)["buckets"]
    folders = [f"{path}/{v}" for k, v in sorted(found.items()) if only is None or k in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, path: str, key: str, combine: Callable[[DataFrame], DataFrame], stream: str, number: int, buckets: int = BUCKETS) -> int | None:
    """Merge a batch into the table at ``path``: ``combine`` makes one row of each key from its stored row and the batch's.

    ``combine`` gets the columns of ``batch`` and ``_new`` (false for the stored row), and gives those of ``batch``.
    Returns the new version, or None where batch ``number`` of ``stream`` was committed before or has no rows.
    """
    spark, schema = batch.sparkSession, batch.schema
    now = state(spark, path)
    if now["batches"].get(stream, -1) >= number:
        return None
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")
    touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
    if not touched:
        return None
    rows = read(spark, path, schema, touched).withColumn("_new", F.lit(False)).union(batch.withColumn("_new", F.lit(True)))
    version = max(versions(spark, path), default=0) + 1
    merged = combine(rows).select(*schema.names).withColumn("_bucket", bucket)
    merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={version}")
    now["buckets"] |= {b: f"v={version}/_bucket={b}" for b in touched}
    now["batches"][stream] = number
    spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_versions/{version}")
    _vacuum(spark, path)
    return version


def _vacuum(spark: SparkSession, path: str) -> None:
    """Delete versions before the last ``KEPT`` and the bucket folders that no later one names."""
    found = versions(spark, path)
    if len(found) <= KEPT:
        return
    named = reduce(set.union, (set(state(spark, path, v)["buckets"].values()) for v in found[-KEPT:]))
    for v in found[:-KEPT]:
        for folder in set(state(spark, path, v)["buckets"].values()) - named:
            fs, p = _files(spark, f"{path}/{folder}")
            fs.delete(p, True)
        fs, p = _files(spark, f"{path}/_versions/{v}")
        fs.delete(p, True)
