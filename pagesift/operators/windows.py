"""Current truth, first and last rows, ranks and running counts by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: How much a label's source counts; sources not named count 0.
PRIORITY = {"human": 4, "adjudicate": 3, "review": 2, "labeler": 1, "pilot": 1}


def priority_of(source: str, priority: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in priority.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(source)], F.lit(0))


def ranked(df: DataFrame, keys: list[str], *order: Column, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. The rank limit is applied before the shuffle too, so hot keys stay small."""
    return ranked(df, keys, *order, out="_rn").where("_rn = 1").drop("_rn")


def current_truth(labels: DataFrame, priority: dict[str, int] = PRIORITY, key: str = "page_id") -> DataFrame:
    """The label of each page that counts: by source priority, then the latest, then the highest id."""
    return best_per_key(labels.withColumn("priority", priority_of("source", priority)), [key], F.desc("priority"), F.desc("created_at"), F.desc("id"))


def current_truth_maxby(labels: DataFrame, priority: dict[str, int] = PRIORITY, key: str = "page_id") -> DataFrame:
    """The same as an aggregate that combines before the shuffle: the form for large logs and for streams."""
    labels = labels.withColumn("priority", priority_of("source", priority))
    rest = [c for c in labels.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("priority", "created_at", "id"))
    return labels.groupBy(key).agg(best.alias("_b")).select(key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def view_truth(labels: DataFrame, key: str = "page_id", human: str = "human") -> DataFrame:
    """A human's label if there is one, else the most confident; ties go to the highest id."""
    return best_per_key(labels, [key], F.coalesce(F.col("source") == human, F.lit(False)).desc(), F.desc_nulls_last("confidence"), F.desc("id"))


def view_truth_join(labels: DataFrame, key: str = "page_id", human: str = "human") -> DataFrame:
    """The same by joining each label with its page's best rank, as a cross-check of the window."""
    rank = F.when(F.col("source") == human, F.lit(2.0)).otherwise(F.coalesce("confidence", F.lit(-1.0)))  # a null source is no human
    ranked_ = labels.withColumn("_rank", rank)
    best = ranked_.groupBy(key).agg(F.max("_rank").alias("_best"))
    tied = ranked_.join(best, key).where("_rank = _best")
    return best_per_key(tied, [key], F.desc_nulls_last("confidence"), F.desc("id")).drop("_rank", "_best")


def first_per_key(df: DataFrame, keys: list[str], seq: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the order of ``seq``, which must be unique in a key."""
    return best_per_key(df, keys, F.desc(seq) if last else F.asc(seq))


def largest_per_group(df: DataFrame, group: str, size: str, id_: str) -> DataFrame:
    """The largest row of each group; the smallest id wins ties."""
    return best_per_key(df, [group], F.desc_nulls_last(size), F.asc(id_))


def interleave(df: DataFrame, group: str, size: str, id_: str, n: int | None = None) -> DataFrame:
    """Round robin over groups, the largest row of each first; the first ``n`` rows if given. Adds ``rn``."""
    out = ranked(df, [group], F.desc_nulls_last(size), F.asc(id_))
    # of the first n rows no group has more than n: a rank limit, which is applied before the shuffle
    return out.where(F.col("rn") <= n).orderBy("rn", group).limit(n) if n else out.orderBy("rn", group)


def pr_curve(scored: DataFrame, truth: str = "finish", score: str = "score") -> DataFrame:
    """Cumulative true and false positives down the distinct scores: precision and recall at each.

    Scores are grouped first. Their running sums are built from score ranges, so no task holds the whole curve;
    scores must be in [0, 1].
    """
    from ..plans.running import running_sum

    hit = F.col(truth).cast("long")
    counts = scored.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(hit).alias("_tp"), F.sum(1 - hit).alias("_fp"))
    down = counts.withColumn("_down", -F.col(score))
    bucket = F.floor(1024 * (1 - F.col(score)))
    both = running_sum(running_sum(down, "_tp", ["_down"], bucket, out="tp"), "_fp", ["_down"], bucket, out="fp")
    total = scored.agg(F.sum(hit).alias("_all"))
    return both.join(F.broadcast(total)).select(
        score, "tp", "fp", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "_all").alias("recall"))
