"""Running sums and ranks over large orders without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import lookup_join, materialize


def running_sum(df: DataFrame, value: str, order: list[str], bucket: Column, group: list[str] = [], out: str = "running") -> DataFrame:
    """Add ``out``: the inclusive sum of ``value`` up to each row in ``order`` within ``group``; tied rows share it.

    ``bucket`` must not decrease along ``order``; it cuts each group into short pieces. Each piece is summed,
    the sums of earlier pieces are added up over one row per piece, and only then the rows inside a piece, so
    that a group of any size is spread over tasks.
    """
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_bucket"]
    sums = sums.select(*(F.col(k).alias(f"_{k}_of") for k in keys), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = None
    for key in keys:
        same = F.col(key).eqNullSafe(F.col(f"_{key}_of"))
        on = same if on is None else on & same
    joined = keyed.join(sums, on).drop(*(f"_{k}_of" for k in keys))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return joined.withColumn(out, F.sum(value).over(inside) + F.col("_before")).drop("_bucket", "_before")


def global_rank(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """Add ``out``: the 0-based place of each row in the global ``order``.

    Rows are range-sorted and written; one count for each written range is added up and joined on.
    """
    ordered = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = materialize(counts.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "starts")
    based = lookup_join(ordered.withColumn("_p", part), starts, "_p")
    return based.withColumn(out, F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_p", "_base")
