"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts that a Python worker takes at once.
ROWS = 1000
#: Words are runs of anything but these ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None for null), without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with underscores added while it does."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_KEPT: dict = {}


def once(value, build):
    """``build(value)``, made once for each Python worker and broadcast ``value`` and kept for the worker's later tasks."""
    if id(value) not in _KEPT:
        if len(_KEPT) > 3:
            _KEPT.clear()
        _KEPT[id(value)] = value, build(value)  # holding the value keeps its id from being given to another
    return _KEPT[id(value)][1]
