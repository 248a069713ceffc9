"""Findings of round 3 on queries that may fail on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from pagesift.functions import scalars as S
from pagesift.operators import dedup as D, features as FE
from pagesift.queries import QUERIES, reports as R

from .test_similarity import all_pairs, frame


def test_links_of_many_blocks_stay_few(spark):
    """Blocks for groups are few however small, and a task sends one forest for all it multiplies."""
    x = np.random.default_rng(1).normal(size=(600, 6)) * 0.1 + 1
    x[300:] *= np.array([1, -1, 1, -1, 1, -1])
    rows = frame(spark, x)
    links = D.similar_links(rows, 0.3, block=5)
    assert len(all_pairs(x, 0.3)) > 80_000 and links.count() < 8_000
    assert {(r.page_id < 300, r.leader) for r in D.dup_components(links, rows).collect()} == {(True, 0), (False, 300)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_read_once(spark, tmp_path):
    """A number is taken apart once, and a table of one small file is dealt to all cores."""
    plan = plan_of(spark.range(3).select(S.html_unescape(F.concat(F.lit("&#"), F.col("id").cast("string"))).alias("t")))
    assert plan.count("conv(") == 1
    spark.range(2000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["scl4_references"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    k = 1000
    assert found.where(F.col("c_custkey") == k).first().t == chr(160 + k) + "é’&lt;A&zzz;" + chr(65536 + k)


def test_references_as_in_the_standard_library(spark):
    from html import unescape
    from html.entities import html5

    texts = [f"&{n}{end}" for n in html5 for end in ("", ";", "x")] + [f"&#{k};" for k in (0, 9, 65, 127, 128, 159, 55296, 64976, 1114111, 1114112, 10**12)] + ["&#x41", "&#X0000000000041;", "&#;", "&a;", "&notit;", "&"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.html_unescape("t").alias("u")).collect()
    assert [r.t for r in rows if r.u != unescape(r.t)] == []


def test_json_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"a":1,"z":"y"}',), ("[1]",), (None,)], "j string")
    parts = rows.select(S.parse_metrics("j", ("a", "b")).alias("m"))
    assert plan_of(parts.select("m.a", "m.b", "m.other")).count("from_json(") == 1
    assert [(r.a, r.b) for r in parts.select("m.a", "m.b").collect()] == [(1.0, None), (None, None), (None, None)]


def test_terms_are_made_once(spark):
    """No filter before the explosion makes the lists a second time, and a task's share by key does not grow with the table."""
    docs = spark.createDataFrame([(1, "a bb cc bb cc"), (2, None), (3, "a"), (4, "bb cc")], "page_id long, text string").repartition(3)
    assert plan_of(FE.terms(docs)).count("regexp_extract_all(") == 1
    assert {tuple(r) for r in FE.terms(docs).collect()} == {(1, "bb", 2), (1, "cc", 2), (1, "bb cc", 2), (1, "cc bb", 1), (4, "bb", 1), (4, "cc", 1), (4, "bb cc", 1)}
    fitted = FE.fit_tfidf(docs)
    assert {(r.term, r.tf, r.df) for r in fitted.vocab.collect()} == {("bb", 3, 2), ("cc", 3, 2), ("bb cc", 3, 2)}
    assert fitted.cells(docs).rdd.getNumPartitions() == 8 * 3


def test_head_rows_are_written_once(spark):
    """A head's rows are read from files: no encoder over texts is left in their plan."""
    seen = []
    fit, R.M.fit_head = R.M.fit_head, lambda train, *a, **k: seen.append(train) or fit(train, *a, **k)
    try:
        R.mod1_logistic(spark, "/root/testdata/sf0.001")
    finally:
        R.M.fit_head = fit
    assert "MapInPandas" not in plan_of(seen[0]) and seen[0].count() > 0
