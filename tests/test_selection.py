"""Selections by hash without a global sort: bottom keys of strata, the k-th group, and split documents."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions.scalars import hash_frac
from pagesift.operators import sampling as SA, splits as SP
from pagesift.sources import io


def frac(key):
    return int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16) / 4294967295


@pytest.mark.parametrize("parts,limit", [(1, 4), (7, 4), (7, 100)])
def test_bottom_keys(spark, parts, limit):
    """Also where a third of all rows share a key, and where keys are null."""
    r = random.Random(1)
    keys = [f"k{r.randint(0, 60)}" for _ in range(400)] + ["hot"] * 200 + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "permitNum string, i int").repartition(parts)
    strata = [("a", F.col("i") % 2 == 0), ("b", F.lit(None).cast("boolean")), ("c", F.col("permitNum") < "k3")]
    got = {(x.k, x["key"]) for x in SA.bottom_keys(rows, strata, limit).collect()}
    want = set()
    for k, ok in ((1, lambda i, key: i % 2 == 0), (3, lambda i, key: key < "k3")):
        some = {key for i, key in enumerate(keys) if key is not None and ok(i, key)}
        want |= {(k, key) for key in sorted(some, key=lambda x: (frac(x), x))[:limit]}
    assert got == want
    assert SA.stratified_sample(rows.limit(0), strata, 3).count() == 0


def test_kth_by_hash(spark):
    names = [f"g{i}" for i in range(9000)]
    groups = spark.createDataFrame([(n,) for n in names], "g string").withColumn("_h", hash_frac("g"))
    order = sorted(names, key=lambda g: (frac(g), g))
    for k in (1, 2, 4500, 8999, 9000):
        assert SP.kth_by_hash(groups, "g", k)[1] == order[k - 1]
    assert SP.kth_by_hash(groups, "g", 0) is None
    edges = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 0.5), ("d", 1.0), ("e", 1.0)] + [(f"f{i:05}", 0.5) for i in range(5000)], "g string, _h double")
    assert [SP.kth_by_hash(edges, "g", k)[1] for k in (1, 2, 3, 4, 5003, 5004, 5005)] == ["a", "b", "c", "f00000", "f04999", "d", "e"]


def test_split_document(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"g{r.randrange(40)}", r.random() < 0.02) for i in range(800)] + [(10_000 + i, "whale", True) for i in range(310)]
    split = SP.frozen_split(spark.createDataFrame(rows, "page_id long, permit_num string, finish boolean"))
    io.write_split(split, f"{tmp_path}/doc", rules="as documented")
    doc = io.read_split_document(spark, f"{tmp_path}/doc").first()
    by = {x.permit_num: x for x in split.collect()}
    assert doc.version == "v1" and doc.rules == "as documented" and doc.train == sorted(g for g in by if by[g].side == "train") and doc.eval == sorted(g for g in by if by[g].side == "eval")
    stats = doc.stats
    assert [(w.permit_num, w.pages) for w in stats.whales_forced_train] == [("whale", 310)] and stats.total_pages == 1110
    assert [m.permit_num for m in stats.moved_to_eval_to_meet_floors] == sorted((g for g in by if by[g].moved), key=frac) and stats.moved_to_eval_to_meet_floors
    assert stats.eval.finish_pages == sum(by[g].finish_pages for g in doc.eval) and stats.floors_met == (len(doc.eval) >= 8 and stats.eval.finish_pages >= 15) != stats.floors_exhausted_without_meeting
    assert {x.permit_num: x.side for x in io.read_split(spark, f"{tmp_path}/doc").collect()} == {g: by[g].side for g in by}
