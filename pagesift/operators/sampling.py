"""Seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash_frac


def bottom_keys(df: DataFrame, strata: list[tuple[str, Column]], limit: int, seed: int = 42, key: str = "permitNum") -> DataFrame:
    """Rows ``k, h, key``: the ``limit`` keys of each stratum (1-based) with the smallest hashes, each once.

    Each task keeps the smallest of its own rows, in sets that merge: it sends at most ``limit`` rows a stratum, whatever
    it reads and however often a key repeats.
    """
    kind, width = df.schema[key].dataType.simpleString(), len(strata)
    # 63 strata to a number
    bits = [reduce(Column.bitwiseOR, (F.coalesce(c, F.lit(False)).cast("long") * F.lit(1 << j) for j, (_, c) in enumerate(strata[k : k + 63]))) for k in range(0, width, 63)]

    def least(batches):
        import numpy as np
        import pandas as pd

        kept, worst = [None] * width, [2.0] * width
        for pdf in batches:
            h = pdf["h"].to_numpy()
            for k in range(width):
                row = np.flatnonzero((pdf[f"b{k // 63}"].to_numpy() >> (k % 63) & 1) & (h <= worst[k]))
                if len(row):
                    best = pd.concat([kept[k], pdf[["h", "key"]].iloc[row]]).drop_duplicates().sort_values(["h", "key"]).head(limit)
                    kept[k], worst[k] = best, best["h"].iloc[-1] if len(best) == limit else 2.0
        for k, best in enumerate(kept):
            if best is not None:
                yield best.assign(k=np.int32(k + 1))[["k", "h", "key"]]

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), hash_frac(key, seed).alias("h"), *(b.alias(f"b{i}") for i, b in enumerate(bits)))
    few = rows.mapInPandas(least, f"k int, h double, key {kind}").distinct()
    order = Window.partitionBy("k").orderBy("h", "key")
    return few.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")


def stratified_sample(df: DataFrame, strata: list[tuple[str, Column]], n: int = 15, seed: int = 42, key: str = "permitNum") -> DataFrame:
    """``n`` rows of each stratum in hash order, without replacement over all: earlier strata choose first.

    A stratum loses at most n rows to each earlier one, so its picks are among its first n*K by hash (K strata). Only
    those, at most n*K*K rows whatever the table, are resolved stratum by stratum. Rows with a null key are never picked.
    """
    few = [(r["key"], r.k) for r in bottom_keys(df, strata, n * len(strata), seed, key).orderBy("k", "h", "key").collect()]
    taken: dict = {}
    counts: dict = {}
    for value, k in few:
        if value not in taken and counts.get(k, 0) < n:
            taken[value] = (k, counts.get(k, 0) + 1)
            counts[k] = counts.get(k, 0) + 1
    kind = df.schema[key].dataType.simpleString()
    rows = [(v, strata[k - 1][0], i) for v, (k, i) in taken.items()]
    picks = df.sparkSession.createDataFrame(rows, f"{key} {kind}, stratum string, pick int")
    return df.join(F.broadcast(picks), key)  # at most n*K rows


def audit_sample(df: DataFrame, share: float = 0.1, seed: int = 42, key: str = "page_id") -> DataFrame:
    """The rows whose hash falls below ``share``: the same rows on every run."""
    return df.where(hash_frac(key, seed) < share)
