"""Similar pairs, leaders and neighbours by pruned plans, against trying all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.operators import cells, dedup as D


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "page_id long, embedding array<double>")


def unit_of(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32).astype(np.float64)


def all_pairs(x, t):
    c = unit_of(x) @ unit_of(x).T
    some = x.any(axis=1)  # zero vectors are similar to nothing
    return {(i, j) for i, j in zip(*np.nonzero((c > t) & some[:, None] & some[None, :])) if i < j}


@pytest.mark.parametrize("t,pivots,block", [(0.98, None, 1024), (0.98, 30, 7), (0.9, 12, 40), (0.3, None, 64), (-0.5, None, 50)])
def test_pairs_equal_trying_all(spark, t, pivots, block):
    g = np.random.default_rng(3)
    centres = g.normal(size=(25, 20))
    x = np.concatenate([c + g.normal(size=(8, 20)) * s for c, s in zip(centres, g.uniform(0.01, 0.6, 25))])
    x = np.concatenate([x, x[:5], np.zeros((2, 20)), np.repeat(x[7:8], 12, 0)])
    rows = frame(spark, x)
    found = [(r.a, r.b) for r in D.similar_pairs(rows, t, block=block, pivots=pivots).collect()]
    assert len(found) == len(set(found)) and set(found) == all_pairs(x, t)
    if t != 0.9:
        return
    links = D.similar_links(rows, t, block=block)
    direct, tied = ({r.page_id: r.leader for r in D.dup_components(p, rows).collect()} for p in (D.similar_pairs(rows, t), links))
    assert direct == tied and links.count() < max(2, len(found))


def test_no_vectors(spark):
    empty = frame(spark, np.ones((1, 3))).limit(0)
    assert D.similar_pairs(empty, 0.9).count() == D.nearest(empty).count() == 0
    assert D.pruning_report(empty).first().met == 0
    one = frame(spark, np.ones((1, 3)))
    assert D.similar_pairs(one, 0.9).count() == D.nearest(one).count() == 0


def test_pruning_leaves_few_pairs(spark):
    g = np.random.default_rng(4)
    x = np.concatenate([c + g.normal(size=(20, 32)) * 0.1 for c in g.normal(size=(60, 32))])
    got = D.pruning_report(frame(spark, x), 0.98).first()
    assert got.vectors == 1200 and got.share < 0.05


def test_bounds_hold():
    g = np.random.default_rng(6)
    x, p = unit_of(g.normal(size=(300, 6))), unit_of(g.normal(size=(12, 6)))
    sims, home, best, high = cells.bounds(x, p, cells.distances(p))
    c = x @ x.T
    for i in range(len(x)):
        for q in range(len(p)):
            if q != home[i] and (home == q).any():
                assert c[i, home == q].max() <= high[i, q] + 1e-9


@pytest.mark.parametrize("block,group", [(1024, None), (9, None), (9, "g"), (40, "g")])
def test_nearest_equals_trying_all(spark, block, group):
    g = np.random.default_rng(8)
    x = np.concatenate([g.normal(size=(80, 5)), np.repeat(g.normal(size=(1, 5)), 6, 0), np.zeros((1, 5))])
    rows = frame(spark, x).withColumn("g", F.when(F.col("page_id") < 30, "one").otherwise((F.col("page_id") % 3).cast("string")))
    names = {r.page_id: r.g if group else str(r.page_id) for r in rows.collect()}
    u = unit_of(x)
    want = {}
    for i in range(len(x) - 1):
        near = [(-float(u[i] @ u[j]), j) for j in range(len(x) - 1) if names[i] != names[j]]
        want[i] = min((round(s, 9), j) for s, j in near)
    got = {r.page_id: (round(-r.cos, 9), r.neighbour) for r in D.nearest(rows, group=group, block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-7 for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= len(want) - 6  # equal vectors tie up to rounding


def plain_leaders(n, edges):
    leaders, want = [], {}
    for i in range(n):
        near = [(-edges[j, i], j) for j in leaders if (j, i) in edges]
        want[i] = min(near)[1] if near else i
        if not near:
            leaders.append(i)
    return want


def got_leaders(spark, n, edges, **options):
    pairs = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a long, b long, cos double")
    return {x.page_id: x.leader for x in D.dup_leaders(pairs, spark.range(n).withColumnRenamed("id", "page_id"), **options).collect()}


@pytest.mark.parametrize("width,block_edges", [(1, 200_000), (2, 200_000), (3, 900)])
def test_leaders_on_long_chains(spark, width, block_edges):
    """Each id is similar to those next to it: a component whose answer runs through all its ids."""
    r, n = random.Random(width), 5000 if block_edges > 1000 else 1500
    edges = {(i, j): r.choice([0.5, 0.6]) for i in range(n) for j in range(i + 1, min(n, i + width + 1))}
    assert got_leaders(spark, n, edges, block_edges=block_edges) == plain_leaders(n, edges)


@pytest.mark.parametrize("seed", range(2))
def test_leaders_in_blocks(spark, seed):
    r, n = random.Random(seed), 120
    edges = {tuple(sorted(r.sample(range(n), 2))): r.choice([0.5, 0.6, 0.7]) for _ in range(300)}
    edges |= {(0, b): 0.55 for b in range(1, n, 3)} | {(a, n - 1): 0.5 for a in range(n - 1)}
    assert got_leaders(spark, n, edges, block_edges=40) == plain_leaders(n, edges)
