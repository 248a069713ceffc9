"""Evaluation of scores with an asymmetric cost: never miss a finish page, false positives are cheap.

Input is ``scored``: a score, the flags keep, finish and floordemo, and a group. An empty denominator gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02)


def _rate(hit: Column, base: Column) -> Column:
    return F.try_divide(F.count_if(hit & base).cast("double"), F.count_if(base))


def metric_columns(pred: Column) -> list[Column]:
    keep = F.col("keep")
    return [
        _rate(pred, F.col("finish")).alias("finish_recall"),
        _rate(pred, F.col("floordemo")).alias("floordemo_recall"),
        _rate(pred, keep).alias("keep_recall"),
        _rate(pred, ~keep).alias("fp_rate"),
        _rate(keep, pred).alias("keep_precision"),
        F.try_divide(F.count_if(pred).cast("double"), F.count("*")).alias("frac_kept"),
    ]


METRICS = ("finish_recall", "floordemo_recall", "keep_recall", "fp_rate", "keep_precision", "frac_kept")


def at(thr, score: str = "score") -> Column:
    return F.coalesce(F.col(score) >= thr, F.lit(False))


def micro_metrics(scored: DataFrame, thr: float = 0.5) -> DataFrame:
    """One row of metrics over all pages at a threshold."""
    return scored.agg(*metric_columns(at(thr)))


def packet_metrics(scored: DataFrame, thr: float = 0.5, group: str = "permit_num") -> DataFrame:
    """One row: each metric averaged over the groups that have its denominator."""
    return scored.groupBy(group).agg(*metric_columns(at(thr))).agg(*(F.avg(m).alias(m) for m in METRICS))


def full_recall_threshold(scored: DataFrame) -> DataFrame:
    """The lowest score of a finish page; null if there is none."""
    return scored.agg(F.min(F.when(F.col("finish"), F.col("score"))).alias("thr"))


def full_recall_point(scored: DataFrame) -> DataFrame:
    """Metrics at the full-recall threshold, with it; all null if there is none."""
    joined = scored.join(F.broadcast(full_recall_threshold(scored)))
    pred = F.col("score") >= F.col("thr")
    return joined.groupBy("thr").agg(*(F.when(F.first("thr").isNotNull(), m).alias(n) for m, n in zip(metric_columns(F.coalesce(pred, F.lit(False))), METRICS)))


def threshold_table(scored: DataFrame, grid=GRID) -> DataFrame:
    """Metrics at each threshold of a grid, in one pass: counts for each score band are added up down the grid."""
    cuts = sorted(grid)
    band = sum((at(t).cast("int") for t in cuts), F.lit(0)).alias("band")
    counts = scored.groupBy(band).agg(
        F.count_if("finish").alias("finish"), F.count_if("floordemo").alias("floordemo"), F.count_if("keep").alias("keep"), F.count_if(~F.col("keep")).alias("drop"), F.count("*").alias("n"))
    grid_rows = scored.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(cuts)], "i int, thr double")
    pairs = counts.join(F.broadcast(grid_rows))
    sums = pairs.groupBy("thr").agg(*(F.sum(F.when(F.col("band") >= F.col("i"), F.col(c)).otherwise(0)).alias(f"k_{c}") for c in ("finish", "floordemo", "keep", "drop", "n")), *(F.sum(c).alias(f"a_{c}") for c in ("finish", "floordemo", "keep", "drop", "n")))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return sums.select("thr", ratio("k_finish", "a_finish").alias("finish_recall"), ratio("k_floordemo", "a_floordemo").alias("floordemo_recall"), ratio("k_keep", "a_keep").alias("keep_recall"), ratio("k_drop", "a_drop").alias("fp_rate"), ratio("k_keep", "k_n").alias("keep_precision"), ratio("k_n", "a_n").alias("frac_kept"))


def packet_table(scored: DataFrame, thr: float = 0.5, group: str = "permit_num") -> DataFrame:
    """Groups with a finish page: how many, how many caught, recall."""
    out = scored.groupBy(group).agg(F.count_if("finish").alias("n_finish"), F.count_if(F.col("finish") & at(thr)).alias("n_caught")).where("n_finish > 0")
    return out.withColumn("recall", F.col("n_caught") / F.col("n_finish"))


def packet_summary(scored: DataFrame, thr: float = 0.5, group: str = "permit_num") -> DataFrame:
    """One row: groups, groups with a finish page, groups that lose none."""
    each = scored.groupBy(group).agg(F.count_if("finish").alias("n"), F.count_if(F.col("finish") & at(thr)).alias("c"))
    return each.agg(F.count("*").alias("packets"), F.count_if(F.col("n") > 0).alias("finish_packets"), F.count_if((F.col("n") > 0) & (F.col("n") == F.col("c"))).alias("full_packets"))


def misses(scored: DataFrame, thr: float = 0.5) -> DataFrame:
    """Finish pages below the threshold, lowest score first."""
    return scored.where(F.col("finish") & ~at(thr)).orderBy(F.asc_nulls_first("score"))


def router(train: DataFrame, held_out: DataFrame, branch: str = "branch", fallback: float = 0.5, missing: str = "neither", sentinel: float = 2.0) -> DataFrame:
    """Each held-out page with its branch's threshold and decision.

    A branch's threshold is its full-recall threshold on the train scores, ``fallback`` without a finish page there.
    Pages of the ``missing`` branch are always kept: their score is ``sentinel``.
    """
    tuned = train.where(F.col(branch) != missing).groupBy(branch).agg(F.min(F.when(F.col("finish"), F.col("score"))).alias("_t"))
    out = held_out.join(F.broadcast(tuned), branch, "left")
    thr = F.when(F.col(branch) == missing, F.lit(fallback)).otherwise(F.coalesce("_t", F.lit(fallback)))
    score = F.when(F.col(branch) == missing, F.lit(sentinel)).otherwise(F.col("score"))
    return out.withColumn("thr", thr).withColumn("score", score).withColumn("pred", F.coalesce(score >= thr, F.lit(False))).drop("_t")


def routed_metrics(routed: DataFrame) -> DataFrame:
    """Metrics of a router's decisions."""
    return routed.agg(*metric_columns(F.col("pred")))


def experiment_row(metrics: DataFrame, **config: str) -> DataFrame:
    """A row for the experiment log: configuration, metrics and a readable note."""
    note = F.concat_ws("; ", *(F.concat(F.lit(f"{m}="), F.coalesce(F.format_string("%.3f", m), F.lit("NA"))) for m in ("finish_recall", "fp_rate")))
    return metrics.select(*(F.lit(v).alias(k) for k, v in config.items()), *metrics.columns, F.when(F.col("finish_recall").isNull(), "NA").otherwise(note).alias("notes"))


def verdict(scored: DataFrame, thr: float = 0.5, min_floordemo: float = 0.95, group: str = "permit_num") -> DataFrame:
    """Each group with its recalls and whether it passes: all finish pages and 95% of the floor and demo pages kept."""
    each = scored.groupBy(group).agg(*metric_columns(at(thr))[:2])
    passed = (F.coalesce("finish_recall", F.lit(1.0)) == 1) & (F.coalesce("floordemo_recall", F.lit(1.0)) >= min_floordemo)
    return each.withColumn("accepted", passed)


def excluded(pages: DataFrame, emb: DataFrame, key: str = "page_id", side: str = "side") -> DataFrame:
    """Pages without a vector, and finish pages among them, by side."""
    return pages.join(emb.select(key).distinct(), key, "left_anti").groupBy(side).agg(F.count("*").alias("pages"), F.count_if("finish").alias("finish_pages"))


def plateau(log: DataFrame, k: int = 3, cycle: str = "cycle", metric: str = "finish_recall") -> DataFrame:
    """The log with the best metric so far and whether it has not improved over the last ``k`` cycles. One row a cycle."""
    w = Window.orderBy(cycle)
    best = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = log.withColumn("best", best)
    return out.withColumn("plateau", F.coalesce(F.col("best") <= F.lag("best", k).over(w), F.lit(False)))


def compare_leaderboards(a: DataFrame, b: DataFrame, keys: list[str], metrics=("finish_recall", "fp_rate")) -> DataFrame:
    """Two leaderboards side by side: differences of metrics and rank; a row that one lacks has nulls."""
    left = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in (*metrics, "rank")))
    right = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in (*metrics, "rank")))
    out = left.join(right, keys, "full")
    for c in (*metrics, "rank"):
        out = out.withColumn(f"d_{c}", F.col(f"b_{c}") - F.col(f"a_{c}"))
    return out


def collapse(probs: str, classes: list[str], keep) -> Column:
    """The sum of the probabilities of the classes to keep, from an array in the order of ``classes``."""
    at_ = [i for i, c in enumerate(classes) if c in set(keep)]
    return sum((F.element_at(probs, i + 1) for i in at_), F.lit(0.0))
