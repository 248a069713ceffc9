"""Exact dedup by a tree of merges over sorted runs of digests.

Each input partition is a run: its rows' digests, sorted. In each round the runs of ``FAN`` neighbouring numbers meet in
one: their entries are sorted and equal neighbours become a single entry with the number of rows and the identifier
that stays. Runs are ordered by a short digest and entries are verified by SHA-256 and length, so texts that share a
short digest stay apart. No task holds a run: a run's digests are dealt to all tasks, and each round combines before
it shuffles, so a text that a third of all rows share costs one entry a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.storage import lookup_join, materialize
from .common import fresh

#: Runs that meet in one in each round, as a power of two: 16.
FAN_BITS = 4
ENTRY = ["d", "sha", "bytes"]


def entry_of(text: Column) -> list[Column]:
    """Short digest, SHA-256 and length of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("d"), F.unhex(F.sha2(whole, 256)).alias("sha"), F.octet_length(whole).alias("bytes")]


def digest_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row for each row of ``docs``, without its text: its entry, ``id``, ``row`` and the number of its run, sorted within runs."""
    rows = docs.select(F.col(key).alias("id"), *entry_of(F.col(text)), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows.sortWithinPartitions(*ENTRY), "runs")


def merge_runs(runs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """One merged run of all ``runs``: each entry once, its rows ``n`` and ``keep``, the (id, row) that stays.

    The largest id stays and, of rows that share it, the last; a null id only where there is no other. The maximum of
    a struct makes Spark merge sorted entries, and spill, rather than hash them.
    """
    last = runs.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    merged = runs.select("run", *ENTRY, F.lit(1).cast("long").alias("n"), F.struct("id", "row").alias("keep"))
    while True:
        merged = merged.groupBy(F.shiftright("run", fan_bits).alias("run"), *ENTRY).agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
        last >>= fan_bits
        if not last:
            return merged.drop("run")


def copies(runs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """The merged entries of more than one row, written."""
    return materialize(merge_runs(runs, fan_bits).where("n > 1"), "copies")


def _same(left, right) -> Column:
    return (left("d") == right("d")) & (left("sha") == right("sha")) & (left("bytes") == right("bytes"))


def _under(name: str):
    return lambda c: F.col(f"`{name}`.{c}")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null counts as empty, so null and empty texts are one group. Exactly one row of a
    group is kept, also where rows repeat as a whole. Only digests are shuffled, each document's text is read once.
    """
    runs = digest_runs(docs, key, text)
    side = copies(runs).select(F.struct(*ENTRY, "n", "keep").alias("g"))
    joined = lookup_join(runs, side, _same(F.col, _under("g")), "left")
    return joined.select(
        F.col("id").alias(key),
        F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("g.keep.id")).alias("keep_id"),
        F.coalesce("g.n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("g").isNull() | (F.col("g.keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their own columns as they are.

    Texts without copies pass without a shuffle where the texts with copies are few enough to broadcast.
    """
    runs = digest_runs(docs, key, text)
    found = copies(runs)
    own, g = fresh(docs, "_entry"), fresh(docs, "_copies")
    side = found.select(F.struct(*ENTRY, "keep").alias(g))
    joined = lookup_join(docs.withColumn(own, F.struct(*entry_of(F.col(text)))), side, _same(_under(own), _under(g)), "left")
    kept = joined.where(F.col(g).isNull() | F.col(f"`{g}`.keep.id").eqNullSafe(F.col(key)))
    winners = runs.alias("r").join(found.alias("f"), _same(lambda c: F.col(f"r.{c}"), lambda c: F.col(f"f.{c}")) & F.col("r.id").eqNullSafe(F.col("f.keep.id")))
    if not winners.where("r.row <> f.keep.row").isEmpty():  # rows that repeat id and text
        kept = kept.where(F.col(g).isNull()).unionByName(kept.where(F.col(g).isNotNull()).dropDuplicates([own]))
    return kept.select(*docs.columns)
