"""Splits into train and eval by group, so that no group is on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hash_frac
from ..plans.storage import materialize
from .aggregates import permit_stats


def hash_split(df: DataFrame, group: str, seed: int = 42, eval_frac: float = 0.2, out: str = "side") -> DataFrame:
    """Eval for groups whose hash is below ``eval_frac``; new rows and groups move none of the others. No shuffle."""
    return df.withColumn(out, F.when(hash_frac(group, seed) < eval_frac, "eval").otherwise("train"))


#: Bins of a histogram over hashes, all that the driver sees of a selection.
BINS = 4096


def kth_by_hash(groups: DataFrame, group: str, k: int, h: str = "_h") -> tuple | None:
    """The ``k``-th row (1-based) by hash ``h`` in [0, 1] and then ``group``, as (hash, group); None for k < 1.

    Found by refining histograms: the bin that holds it is cut again until it has few rows or a single hash, so no task
    sorts all groups. ``groups`` is read once for each refinement: twice for up to 10^9 groups.
    """
    if k < 1:
        return None
    low, width = 0.0, 1.0
    while True:
        upper = F.col(h) < low + width if low + width < 1 else F.lit(True)
        inside = groups.where((F.col(h) >= low) & upper)
        counts = inside.groupBy(F.least(F.floor((F.col(h) - low) / width * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
        for number, n in sorted(tuple(r) for r in counts):
            if k <= n:
                break
            k -= n
        low, width = low + number * width / BINS, width / BINS
        if n <= BINS or width < 2.0**-40:
            break
    upper = F.col(h) < low + width if low + width < 1 else F.lit(True)
    row = groups.where((F.col(h) >= low) & upper).orderBy(h, group).limit(k).orderBy(F.desc(h), F.desc(group)).first()
    return (row[h], row[group])


def upto(place: tuple | None, group: str, h: str = "_h"):
    """Whether a row is at or before the (hash, group) of ``kth_by_hash``."""
    if place is None:
        return F.lit(False)
    return (F.col(h) < place[0]) | ((F.col(h) == place[0]) & (F.col(group) <= F.lit(place[1])))


def count_split(df: DataFrame, group: str, seed: int = 42, train_frac: float = 0.8) -> DataFrame:
    """Each group with its side: the first ``round(train_frac * n)`` by hash are train (half to even), at least one eval if n > 1."""
    groups = materialize(df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", hash_frac(group, seed)), "groups")
    n = groups.count()
    cut = n if n < 2 else max(1, min(round(train_frac * n), n - 1))
    return groups.select(group, F.when(upto(kth_by_hash(groups, group, cut), group), "train").otherwise("eval").alias("side"))


def frozen_split(truth: DataFrame, group: str = "permit_num", finish: str = "finish", seed: int = 42, eval_frac: float = 0.25, whale: int = 300, min_groups: int = 8, min_finish: int = 15) -> DataFrame:
    """One row for each group: pages, finish_pages, whale, moved, side.

    Groups over ``whale`` pages are train. Of the others the lowest ``round(eval_frac * n)`` by hash are eval; then
    groups with finish pages follow in hash order until there are ``min_groups`` groups and ``min_finish`` finish
    pages in eval. The rank is a selection; each group that follows adds at least one group and page, so those that
    may follow are the first ``max(min_groups, min_finish)`` by hash, and only they are ordered.
    """
    stats = permit_stats(truth.where(F.col(group).isNotNull()), group, finish).withColumn("whale", F.col("pages") > whale)
    stats = materialize(stats.withColumn("_h", hash_frac(group, seed)), "groups")
    small = stats.where("NOT whale")
    place = kth_by_hash(small, group, round(eval_frac * small.count()))
    inside = upto(place, group)
    begun = small.where(inside).agg(F.count("*").alias("n"), F.coalesce(F.sum("finish_pages"), F.lit(0)).alias("f")).first()
    few = small.where(~inside & (F.col("finish_pages") > 0)).orderBy("_h", group).limit(max(min_groups, min_finish)).select(group, "finish_pages").collect()
    moved, n, f = [], begun["n"], begun["f"]
    for name, pages in few:
        if n >= min_groups and f >= min_finish:
            break
        moved.append(name)
        n, f = n + 1, f + pages
    follows = F.col(group).isin(moved) if moved else F.lit(False)
    chosen = stats.withColumn("moved", ~F.col("whale") & follows)
    side = F.when(~F.col("whale") & (inside | F.col("moved")), "eval").otherwise("train")
    return chosen.withColumn("side", side).select(group, "pages", "finish_pages", "whale", "moved", "side")


def split_stats(split: DataFrame, min_groups: int = 8, min_finish: int = 15) -> DataFrame:
    """Groups, pages, finish pages, whales and moved groups by side and over all (side null), and whether eval has its floors."""
    out = split.rollup("side").agg(
        F.count("*").alias("groups"), F.sum("pages").alias("pages"), F.sum("finish_pages").alias("finish_pages"),
        F.count_if("whale").alias("whales"), F.count_if("moved").alias("moved"))
    met = F.when(F.col("side") == "eval", (F.col("groups") >= min_groups) & (F.col("finish_pages") >= min_finish))
    return out.withColumn("floors_met", met)


def whales(split: DataFrame, group: str = "permit_num") -> DataFrame:
    return split.where("whale").select(group, "pages").orderBy(F.desc("pages"), group)


def apply_frozen_split(pages: DataFrame, split: DataFrame, group: str = "permit_num", default: str = "train") -> DataFrame:
    """Pages with the side of their group; groups the split does not know get ``default`` and ``is_new``."""
    known = split.select(F.col(group).alias("_g"), F.col("side").alias("_side"))
    joined = pages.join(known, F.col(group) == F.col("_g"), "left")
    return joined.withColumn("side", F.coalesce("_side", F.lit(default))).withColumn("is_new", F.col("_g").isNull()).drop("_g", "_side")


def new_groups(pages: DataFrame, split: DataFrame, group: str = "permit_num") -> DataFrame:
    """Groups that the split does not know, with their pages."""
    return pages.join(split.select(group), group, "left_anti").groupBy(group).agg(F.count("*").alias("pages"))


def leaks(split: DataFrame, group: str, side: str = "side") -> DataFrame:
    """Groups that are on more than one side."""
    return split.groupBy(group).agg(F.count_distinct(side).alias("sides")).where("sides > 1")


def assert_no_leak(split: DataFrame, group: str, side: str = "side") -> None:
    found = leaks(split, group, side).take(3)
    if found:
        raise AssertionError(f"groups on both sides, for example {[r[0] for r in found]}")


def canonical_split(truth: DataFrame, leaders: DataFrame, group: str = "permit_num", key: str = "page_id", seed: int = 42, train_frac: float = 0.8) -> DataFrame:
    """Sides by ``count_split``, with near-duplicates (``key, leader``) thinned: train keeps all, eval the first page of each group."""
    from .dedup import eval_representatives

    sided = truth.join(count_split(truth, group, seed, train_frac), group).join(leaders, key, "left").withColumn("leader", F.coalesce("leader", key))
    reps = eval_representatives(sided, key).select(key).withColumn("_rep", F.lit(True))
    return sided.join(reps, key, "left").where((F.col("side") == "train") | F.col("_rep")).drop("_rep")
