"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)``: each node of ``edges`` with the smallest node reachable from it.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): each node's larger neighbours, then
    its smaller ones, are tied to its smallest neighbour, until every component is a star. A round needs only
    minima per node, which combine before the shuffle, and joins on the node, whose hot keys adaptive execution
    splits; it is written to the shared folder, so lineage stays short, and replaces the last one. Self-loops and repeated edges are
    harmless; null ends are ignored; an empty table gives an empty one.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs = materialize(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        earlier, pairs = pairs, materialize(_small_star(_large_star(pairs)), "edges")
        discard(earlier)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
