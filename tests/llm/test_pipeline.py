"""The pipeline against a brute-force version of its stages."""

import binascii

import corpus_pipeline
from pyspark.sql import functions as F

from pagesift.llm import mixing, token_output

from .cases import docs, own_columns, prose, with_clashes
from .test_operators import BENCH, plain_contamination, plain_metrics


def test_pipeline_equals_brute_force(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    item = prose(30, 900)
    texts = [prose(60 + i, i) for i in range(60)] + [prose(60, 0), None, "", "short", item + " " + prose(40, 5), "a b c " * 40]
    sources = [f"s{i % 4}" if i % 9 else None for i in range(len(texts))]
    docs(spark, texts, sources).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = []
    for d, t in enumerate(texts):
        m = plain_metrics(t)
        if m[0] >= 50 and 100 * m[4] <= 50 * m[0]:
            rows.append((d, t))
    first = {}
    for d, t in rows:  # no two of the other texts are similar
        first.setdefault(t, d)
    rows = [(d, t) for d, t in rows if first[t] == d]
    dirty = plain_contamination([t for _, t in rows], [(1, item)])
    rows = [r for r, c in zip(rows, dirty) if not c[4]]
    left = docs(spark, [t for _, t in rows], [sources[d] for d, _ in rows], [d for d, _ in rows])
    taken = {r.doc_id: r.taken // r.size for r in mixing.report(left).collect()}
    model, at, want = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER)), 0, {}
    for d, t in rows:
        ids = model.encode(t, add_special_tokens=False).ids + [0]
        for _ in range(taken[d]):
            want[d, at] = (len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    assert got == want and 60 not in {d for d, _ in got}


def test_stages_keep_columns(spark, tmp_path):
    with_clashes(docs(spark, [prose(70, i) for i in range(20)])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and out.count() > 10 and own_columns(out)
        assert stage(spark, frame.where(F.lit(False)), str(tmp_path)).count() == 0


def test_pipeline_drops_near_copies(spark, tmp_path):
    def edited(seed, n):
        words = prose(300, seed).split()
        for i in range(n):  # each edit changes five shingles
            words[20 * i + 10] = "edit"
        return " ".join(words)

    # 3, 5 and 6 edits leave a similarity of 0.90, 0.84 and 0.82; 8 leave 0.76
    texts = [edited(900 + g, n) for g in range(6) for n in (0, 3, 5, 6)] + [edited(950 + g, n) for g in range(6) for n in (0, 8)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, frame, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {4 * g for g in range(6)} | set(range(24, 36))


def test_near_dedup_leaves_texts_where_they_are(spark):
    """Dropped ids beyond Spark's own bound for broadcasts are broadcast all the same, so that no text is shuffled."""
    from pagesift.llm import simhash
    from pagesift.plans.storage import settings

    frame = docs(spark, [prose(70, i // 2) for i in range(20)])
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        left = simhash.deduplicate(frame, width=5)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in left.collect()} == set(range(0, 20, 2))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_leaders_and_live_shingles_come_from_one_window(spark):
    from pagesift.llm import simhash

    rows = [(1, 9, 0, 7, 1), (2, 9, 3, 7, 1), (3, 9, 2, 7, 3), (4, 9, 0, 8, 4), (5, 9, 1, 8, 4)]  # shingle 8 has one component left
    live = spark.createDataFrame(rows, "node long, n int, pos int, g int, comp long")
    led = simhash._led(live, 0, several=True)
    assert led._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.node, r.first.node, r.first.n, r.first.pos) for r in led.collect()} == {(1, 1, 9, 0), (2, 1, 9, 0), (3, 1, 9, 0)}
