"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash, once for each epoch, and each copy gets a virtual finish time: the
source's words up to and including it, divided by the source's target. Sorted by that time over all sources, the
mix is the longest prefix within the total budget; every source reaches its target at time one.
Both running sums are built from short hash or time ranges, so a source with a third of all rows is spread over
tasks; what comes back to the documents is one cut-off for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.running import global_rank, running_sum
from ..plans.storage import lookup_join, materialize
from .common import WORD, fresh

SEED = 42
#: No document is taken more often.
EPOCHS = 3
#: Copies meant for one piece of a running sum.
PIECE = 5_000


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def order_key(epoch: Column, size: str = "size") -> Column:
    """Place of a document in its source's shuffle of one epoch; equal for equal (doc_id, size)."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(size).cast("string")))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources by code point, null last."""
    ranked = global_rank(sources, F.col("source").asc_nulls_last(), out="_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod("_rank", F.lit(len(cycle))) + 1).cast("int"))
    return ranked.withColumn("weight", weight).drop("_rank")


def targets(sources: DataFrame, budget: float | None = None, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: shares of ``budget`` by weight, at most ``epochs`` times a source.

    The excess over that limit goes to the others by weight, again until none is above. A round is one
    aggregate over the sources. ``budget`` is all sizes by default.
    """
    most = F.lit(float(epochs)) * F.col("source_size")
    if budget is None:
        budget = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit, capped = None, F.lit(False)
    while True:
        left, weights = sources.agg(F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if not weights:
            break
        unit = (budget - left) / weights
        now = capped | (F.col("weight") * unit > most)
        if sources.where(now & ~capped).isEmpty():
            break
        # once above, always above: the unit only grows from round to round
        capped = F.col("weight") * unit > most
    share = F.col("weight") * F.lit(unit if unit is not None else 0.0)
    return sources.withColumn("target", F.when(capped, most).otherwise(share))


def cutoffs(sized: DataFrame, planned: DataFrame, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """Add ``last_epoch`` and ``last_key`` to each source: its last copy in the mix (null: none).

    Up to the time 1 + m, where m is the most that one document is of its source's target, every source has its
    target, so the budget is used up; copies that finish later cannot be in the mix and are left out before the sum.
    """
    side = planned.select(F.col("source").alias("_source"), "source_size", "target")
    copies = lookup_join(sized.where("size > 0"), side, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "target", F.explode(F.sequence(F.lit(1), F.least(F.lit(epochs), F.ceil(F.col("target") / F.col("source_size")).cast("int") + 1))).alias("epoch")
    ).where("target > 0")
    copies = copies.withColumn("key", order_key(F.col("epoch")))
    rows = copies.count()
    pieces = min(4096, max(1, -(-rows // PIECE)))
    spread = F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * pieces / 65536)
    queued = running_sum(copies, "size", ["epoch", "key"], F.col("epoch") * pieces + spread, ["source"], "queued")
    timed = materialize(queued.withColumn("finish", F.col("queued") / F.col("target")), "queued")
    most = timed.agg(F.max(F.col("size") / F.col("target"))).first()[0] or 0.0
    able = timed.where(F.col("finish") <= (1 + most) * (1 + 1e-9))
    mixed = running_sum(able, "size", ["finish", "source", "epoch", "key"], F.floor(F.col("finish") * max(4 * pieces, 256)), [], "mixed")
    last = mixed.where(F.col("mixed") <= budget).groupBy("source").agg(F.max(F.struct("epoch", "key")).alias("last"))
    joined = planned.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.select(*planned.columns, F.col("last.epoch").alias("last_epoch"), F.col("last.key").alias("last_key"))


def plan(docs: DataFrame, weights=cyclic_weights, budget: int | None = None) -> DataFrame:
    """One row for each source: source, source_size, weight, target, last_epoch, last_key.

    ``docs`` has ``doc_id, source, size``. ``weights`` adds ``weight`` to ``source, source_size``.
    """
    sized = docs.select("doc_id", "source", "size")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] if budget is None else budget
    planned = materialize(targets(weights(sources), float(total)), "targets")
    return materialize(cutoffs(sized, planned, total), "cutoffs")


def with_copies(docs: DataFrame, planned: DataFrame, size: str = "size", out: str = "mix", epochs: int = EPOCHS) -> DataFrame:
    """Add ``out`` to ``docs``: a struct of source_size, target and copies, how often the mix takes the row.

    ``size`` names the column with the row's words. Documents without words are taken once if their source is in the
    mix at all; they add nothing to any sum. An own column named ``out`` is replaced, others are kept.
    """
    docs = docs.drop(out)
    of = fresh(docs, "_plan")
    side = planned.select(F.struct("source", "source_size", "target", "last_epoch", "last_key").alias(of))
    joined = lookup_join(docs, side, F.col("source").eqNullSafe(F.col(f"{of}.source")), "left")
    last = F.struct(F.col(f"{of}.last_epoch").alias("e"), F.col(f"{of}.last_key").alias("k"))
    known = F.col(f"{of}.last_epoch").isNotNull()
    taken = F.lit(0)
    for e in range(1, epochs + 1):
        here = F.struct(F.lit(e).alias("e"), order_key(F.lit(e), size).alias("k"))
        taken = taken + F.when(known & (here <= last), 1).otherwise(0)
    copies = F.when(F.col(size) > 0, taken).otherwise(known.cast("int"))
    return joined.withColumn(out, F.struct(F.col(f"{of}.source_size"), F.col(f"{of}.target"), copies.alias("copies"))).drop(of)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, size, source_size, target, taken.

    Sizes are written once, so texts are read once. Null texts have size 0; null sources are one source; rows that
    agree in doc_id and size are taken alike.
    """
    sized = materialize(docs.select("doc_id", "source", size_of().alias("size")), "sizes")
    out = with_copies(sized, plan(sized))
    return out.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document row as often as it is taken, with all its own columns as they are."""
    planned = plan(materialize(docs.select("doc_id", "source", size_of().alias("size")), "sizes"))
    size = fresh(docs, "_size")
    sized = docs.withColumn(size, size_of())
    out = fresh(sized, "_mix")
    taken = with_copies(sized, planned, size, out)
    times = F.expr(f"if(`{out}`.copies > 0, sequence(1, `{out}`.copies), cast(array() as array<int>))")
    return taken.withColumn(out, F.explode(times)).select(*docs.columns)
