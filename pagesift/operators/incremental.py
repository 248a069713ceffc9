"""Work queues and append-only tables: inserts, status changes, copies, batches and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import col
from .windows import PRIORITY, current_truth, first_per_key

DOCUMENT_EDGES = (("pending", "downloaded"), ("pending", "error"), ("downloaded", "rendered"), ("downloaded", "error"))


def insert_or_ignore(target: DataFrame, incoming: DataFrame, key, seq: str) -> DataFrame:
    """The rows to append: the first of each new key of ``incoming`` that ``target`` lacks."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_per_key(incoming, keys, seq).join(target.select(*keys), keys, "left_anti")


def transition(target: DataFrame, updates: DataFrame, edges=DOCUMENT_EDGES, key="id", status="status") -> tuple[DataFrame, DataFrame]:
    """(table with legal status changes made, updates that were rejected). ``updates`` has one row for each key."""
    new = updates.select(F.col(key).alias("_k"), F.col(status).alias("_new"))
    legal = F.concat_ws(">", status, "_new").isin(*(f"{a}>{b}" for a, b in edges))
    joined = target.join(new, F.col(key) == F.col("_k"), "left")
    done = joined.withColumn(status, F.when(F.col("_new").isNotNull() & legal, F.col("_new")).otherwise(F.col(status))).drop("_k", "_new")
    known = target.select(F.col(key).alias("_k"), F.col(status).alias("_old"))
    tried = updates.join(known, F.col(key) == F.col("_k"), "left")
    ok = F.concat_ws(">", "_old", status).isin(*(f"{a}>{b}" for a, b in edges)) & F.col("_old").isNotNull()
    return done, tried.where(~F.coalesce(ok, F.lit(False))).drop("_k").withColumnRenamed("_old", "old_status")


def append_labels(target: DataFrame, incoming: DataFrame, priority=PRIORITY) -> DataFrame:
    """Current truth after appending: a correction is a new row, no row is changed."""
    return current_truth(target.unionByName(incoming, allowMissingColumns=True), priority)


def delta_copy(src: DataFrame, dst: DataFrame, natural_key, id_col: str = "id") -> DataFrame:
    """Rows of ``src`` that ``dst`` lacks by natural key, with new ids that follow on from ``dst``'s largest."""
    from ..plans.running import global_rank

    keys = [natural_key] if isinstance(natural_key, str) else list(natural_key)
    start = dst.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    fresh = src.join(dst.select(*keys), keys, "left_anti")
    return global_rank(fresh, *keys, id_col, out="_rank").withColumn(id_col, F.lit(start) + 1 + F.col("_rank")).drop("_rank")


def progress(pages: DataFrame, labels: DataFrame, key="page_id", status="status") -> DataFrame:
    """Labelled and remaining pages by status and over all (status null)."""
    done = labels.select(key).distinct().withColumn("_done", F.lit(True))
    joined = pages.join(done, key, "left")
    return joined.rollup(status).agg(F.count("*").alias("pages"), F.count_if("_done").alias("labeled"), (F.count("*") - F.count_if("_done")).alias("remaining"))


def cut_batches(queue: DataFrame, workers: int = 4, size: int = 80, doc="document_id", order="page_id") -> DataFrame:
    """Add ``worker`` and ``batch``: documents stay with one worker, batches have at most ``size`` pages.

    A worker's pages are numbered by range-built running counts, so workers may have any number of pages.
    """
    from ..plans.running import running_sum

    place = F.conv(F.substring(F.sha2(col(doc).cast("string"), 256), 1, 8), 16, 10).cast("long")
    keyed = queue.withColumn("worker", F.pmod(place, F.lit(workers)).cast("int")).withColumn("_p", place).withColumn("_one", F.lit(1))
    counted = running_sum(keyed, "_one", ["_p", doc, order], F.shiftright("_p", 24), ["worker"], "_rn")
    return counted.withColumn("batch", F.ceil(F.col("_rn") / F.lit(size)).cast("long")).drop("_p", "_one", "_rn")


def check_unique(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(F.count("*").alias("n")).where("n > 1")


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns that have nulls, with their number."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return counts.unpivot([], cols, "column", "nulls").where("nulls > 0")


def check_fk(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose key is not null and not in ``parent``."""
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def validate_labels(df: DataFrame, categories, value: str = "value", required=("category", "confidence"), optional=()) -> tuple[DataFrame, DataFrame]:
    """(valid rows with category and confidence parsed, rejected rows with a reason) of a column of JSON texts."""
    keys = F.json_object_keys(value)
    confidence = F.get_json_object(value, "$.confidence")
    number = confidence.try_cast("double")
    reason = (
        F.when(keys.isNull(), "not_json")
        .when(~F.coalesce(F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.array_contains(keys, k)), F.lit(False)), "missing_key")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in (*required, *optional)]))) > 0, "extra_key")
        .when(~F.coalesce(F.get_json_object(value, "$.category").isin(*categories), F.lit(False)), "bad_category")
        .when(~F.coalesce(number.between(0, 1), F.lit(False)), "bad_confidence")
    )
    judged = df.withColumn("reason", reason)
    valid = judged.where("reason IS NULL").drop("reason").withColumn("category", F.get_json_object(value, "$.category")).withColumn("confidence", number)
    return valid, judged.where("reason IS NOT NULL")


def id_after(df: DataFrame, id_: str = "id") -> DataFrame:
    """Rows numbered in order of ``id_``, one row a key; for small tables."""
    return df.withColumn("n", F.row_number().over(Window.orderBy(id_)))
