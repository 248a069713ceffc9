"""TF-IDF vectors and the truncated SVD against exact ones."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pagesift.operators import features as FE


def test_vectors_hold_the_long_form(spark):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words, 20)) if i else None) for i in range(25)], "page_id long, text string").repartition(3)
    fitted = FE.fit_tfidf(docs.where("page_id < 15"), top=40)
    long = {(x.page_id, x["rank"] - 1): x.tfidf for x in fitted.transform(docs).collect()}
    rows = fitted.vectors(docs, 50).select("page_id", "features").collect()
    assert {len(x.features) for x in rows} == {50} and len(rows) == 25
    got = {(x.page_id, int(i)): v for x in rows for i, v in zip(x.features.indices, x.features.values)}
    assert got.keys() == long.keys() and all(abs(got[k] - long[k]) < 1e-12 for k in got)
    plan = fitted.cells(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 1 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("sparse", [True, False])
def test_svd_equals_the_exact_one(spark, sparse):
    g = np.random.default_rng(2)
    a = g.normal(size=(90, 30)) @ np.diag(0.85 ** np.arange(30)) @ g.normal(size=(30, 70)) + 0.01 * g.normal(size=(90, 70))
    a *= g.random(a.shape) < 0.3
    make = (lambda v: Vectors.sparse(70, [(int(i), float(v[i])) for i in np.flatnonzero(v)])) if sparse else Vectors.dense
    rows = spark.createDataFrame([(i, make(v)) for i, v in enumerate(a)], ["page_id", "features"]).repartition(4)
    fitted = FE.fit_svd(rows, k=8, extra=10)
    exact = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(fitted.singular, exact[1][:8], rtol=0.01)
    assert np.allclose(fitted.v.T @ fitted.v, np.eye(8), atol=1e-9)
    placed = {r.page_id: np.array(r.svd) for r in fitted.transform(rows).collect()}
    assert all(np.allclose(placed[i], a[i] @ fitted.v) for i in placed) and len(placed) == 90
    kept = sum((p**2).sum() for p in placed.values())
    assert kept > 0.99 * (exact[1][:8] ** 2).sum()


def test_svd_of_few_places_and_no_rows(spark):
    rows = spark.createDataFrame([(1, Vectors.dense([3.0, 0.0])), (2, Vectors.dense([0.0, 1.0])), (3, Vectors.sparse(2, []))], ["page_id", "features"])
    fitted = FE.fit_svd(rows, k=256)
    assert np.allclose(fitted.singular, [3, 1])
    assert np.allclose([np.abs(r.svd) for r in fitted.transform(rows).orderBy("page_id").collect()], [[3, 0], [0, 1], [0, 0]])
    assert FE.fit_svd(rows.limit(0)).singular == []


def test_sweep_of_all_variants(spark):
    """Every combination has a row, and words that tell the classes apart are learnt from."""
    from pagesift.functions.predicates import KEEP, with_flags
    from pagesift.operators import models as M

    words = {"floor_plan": "room door window", "mep": "duct pipe wire"}
    rows = [(i, f"p{i % 10}", c, " ".join([words[c]] * (1 + i % 3)) + f" page w{i % 7} v{i % 5}", [float(c == "mep") + i % 4 / 9, 1.0]) for i in range(80) for c in [("floor_plan", "mep")[i % 2]]]
    docs = with_flags(spark.createDataFrame(rows, "page_id long, permit_num string, category string, text string, embedding array<double>"))
    truth = docs.withColumn("side", F.when(F.col("page_id") < 50, "train").otherwise("eval"))
    tables, heads = M.text_variants(docs, truth.where("side = 'train'"), {"e": docs}, top=50, k=4)
    out = M.sweep(truth.drop("text", "embedding"), tables, heads, keep_classes=KEEP, logreg={"maxIter": 20}, mlp={"maxIter": 10}).collect()
    assert sorted((r.features, r["head"], r.task) for r in out) == sorted((n, h, t) for n in tables for h in heads[n] for t in ("binary", "collapse"))
    assert len(out) == 4 + 4 + 2
    wrong = [(r.features, r.task, r.keep_recall, r.fp_rate) for r in out if r["head"] == "logreg" and (r.keep_recall, r.fp_rate) != (1.0, 0.0)]
    assert not wrong, wrong
