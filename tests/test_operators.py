"""Operators against plain sequential versions, and their properties."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import predicates as P, scalars as S
from pagesift.operators import aggregates as A, dedup as D, evaluate as E, extract as X, features as FE, incremental as I, joins as J, models as M, sampling as SA, splits as SP, windows as W
from pagesift.operators.graph import connected_components
from pagesift.plans.running import global_rank, running_sum
from pagesift.sources import io
from pagesift.streaming import keyed, tables as ST


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x").alias("y")).first().y


@pytest.mark.parametrize("value, want", [("$1,000,000", 1e6), (" 12.5 ", 12.5), ("", None), (None, None), ("5d", None), ("abc", None), ("1e3", 1000.0), ("-.5", -0.5)])
def test_parse_money(spark, value, want):
    assert one(spark, value, S.parse_money) == want


@pytest.mark.parametrize("value, want", [("2022-01-02", 2022), (" 1999", 1999), ("22-1", None), ("", None), (None, None)])
def test_issue_year(spark, value, want):
    assert one(spark, value, S.issue_year) == want


@pytest.mark.parametrize("name, want", [("Site Plan.pdf", "site_only"), ("site-plans floor.pdf", "plan"), ("A-101 site plan.pdf", "plan"), ("A.2.pdf", "plan"), ("notes.txt", "neither"), (None, "neither"), ("PLAN", "plan"), ("Architectural.PDF", "plan")])
def test_plan_likeness(spark, name, want):
    assert one(spark, name, S.plan_likeness) == want


def test_screen_names(spark):
    names = [("Floor Plan A-101.pdf",), ("Foo MEP.pdf",), ("floor mepx.pdf",), ("plans.doc",), ("a 101.PDF",), (None,)]
    kept = [r.name for r in P.screen_names(spark.createDataFrame(names, "name string")).collect()]
    assert kept == ["Floor Plan A-101.pdf", "a 101.PDF"]
    assert one(spark, "Old MECH.pdf", P.skip_reason) == "mech" and one(spark, "plan", P.skip_reason) is None


def test_scalars_of_odd_values(spark):
    assert one(spark, " >  a&amp;b \n c", S.clean_filename) == "a&b c"
    assert one(spark, "x/data/pages/1/data/pages/p.1.png", S.text_path) == "x/data/pagetext/1/data/pages/p.1.txt"
    assert one(spark, "a;b|c", S.escape_pair) == "a,b/c"
    assert one(spark, " x" * 26, S.text_gate) == ("x " * 26).strip()
    assert one(spark, "x" * 50, S.text_gate) is None
    assert one(spark, [0.0, 0.0], S.l2_normalize, "array<float>") == [0.0, 0.0]
    assert [one(spark, v, S.int_or_zero) for v in ("", None, "x", "7", "1.5")] == [0, 0, 0, 7, 0]
    import hashlib

    assert one(spark, "k", S.hash_frac) == int(hashlib.sha256(b"42:k").hexdigest()[:8], 16) / 0xFFFFFFFF


def test_cost_band_edges(spark):
    got = [one(spark, v, lambda c: P.cost_between(c, 250_000, 1_000_000), "double") for v in (249_999.0, 250_000.0, 999_999.0, 1_000_000.0, None)]
    assert got == [False, True, True, False, False]


@pytest.mark.parametrize("seed", range(3))
def test_running_sum_and_rank(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.randrange(1000), r.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(x.g, x.k): x.running for x in running_sum(df, "v", ["k"], F.floor(F.col("k") / 37), ["g"]).collect()}
    assert got == {(g, k): sum(v2 for g2, k2, v2 in rows if g2 == g and k2 <= k) for g, k, _ in rows}
    ranked = global_rank(df.select("k").distinct(), "k").collect()
    assert {x.k: x["rank"] for x in ranked} == {k: i for i, k in enumerate(sorted({k for _, k, _ in rows}))}
    assert global_rank(df.where("k < 0"), "k").count() == 0


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed, chain", [(0, False), (1, False), (2, True)])
def test_components(spark, seed, chain):
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(60)] if chain else [(r.randrange(80), r.randrange(80)) for _ in range(50)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == {n: c for n, c in union_find(nodes, [p for p in pairs if p[0] != p[1]]).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    n, edges = 50, {}
    for _ in range(120):
        a, b = sorted(r.sample(range(n), 2))
        edges[a, b] = r.choice([0.5, 0.6, 0.7])
    leaders, want = [], {}
    for i in range(n):
        near = [(-edges[j, i], j) for j in leaders if (j, i) in edges]
        want[i] = min(near)[1] if near else i
        if not near:
            leaders.append(i)
    pairs = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "a long, b long, cos double")
    got = {x.page_id: x.leader for x in D.dup_leaders(pairs, spark.range(n).withColumnRenamed("id", "page_id")).collect()}
    assert got == want


@pytest.fixture(scope="module")
def vectors(spark):
    """24 groups of vectors with one near copy each, a zero vector, and a direction that tells what to keep."""
    import numpy as np

    g = np.random.default_rng(5)
    rows, page = [], 0
    for group in range(24):
        first, start = None, page
        for _ in range(g.integers(6, 14)):
            category = ("floor_plan", "finish_plan", "mep", "detail")[page % 4]
            v = g.normal(size=64) + (2.0 if page % 4 < 2 else -2.0) * np.eye(64)[0] * 2
            first = v if first is None else first
            rows.append((page, f"p{group}", category, v.tolist()))
            page += 1
        rows.append((page, f"p{group}", rows[start][2], (first + g.normal(size=64) * 0.001).tolist()))
        page += 1
    rows.append((page, "p0", "mep", [0.0] * 64))
    return spark.createDataFrame(rows, "page_id long, permit_num string, category string, embedding array<double>")


@pytest.mark.parametrize("block", [16, 1024])
def test_injected_copies_are_found(spark, vectors, block):
    pairs = D.similar_pairs(vectors, 0.98, block=block).collect()
    assert len(pairs) == 24 and all(p.cos > 0.98 for p in pairs)
    lsh = {(p.a, p.b) for p in D.lsh_pairs(vectors, 0.98).collect()}
    assert lsh <= {(p.a, p.b) for p in pairs} and len(lsh) >= 22
    near = D.nearest(vectors, block=block).where("cos > 0.98").count()
    assert near == 48


def test_heads_and_sweep(spark, vectors):
    from pyspark.ml.functions import array_to_vector

    truth = SP.hash_split(P.with_flags(vectors), "permit_num", eval_frac=0.3)
    features = vectors.select("page_id", array_to_vector("embedding").alias("features"))
    rows = truth.join(features, "page_id")
    for head, task in (("logreg", "binary"), ("logreg", "collapse"), ("trees", "collapse")):
        model = M.fit_head(rows.where("side = 'train'"), head, task)
        scored = M.score(model, rows.where("side = 'eval'"), P.KEEP)
        m = E.micro_metrics(scored).first()
        assert m.keep_recall > 0.9 and m.fp_rate < 0.1, (head, task, m)
    out = M.sweep(truth, {"v": features}, heads=("logreg",), keep_classes=P.KEEP).collect()
    assert len(out) == 2 and all(r.keep_recall > 0.9 for r in out)
    single = M.sweep(truth.where("keep"), {"v": features}, heads=("logreg",), tasks=("binary",)).first()
    assert single.finish_recall is None and single.notes == "single keep class"
    assert set(M.triage(model, rows, P.KEEP).select("route").distinct().toPandas().route) <= {"keep", "check", "discard"}


def test_split_is_stable_and_fair(spark):
    r = random.Random(3)
    rows = [(i, f"g{r.randrange(60)}", r.random() < 0.05) for i in range(2000)] + [(10_000 + i, "whale", True) for i in range(400)]
    truth = spark.createDataFrame(rows, "page_id long, permit_num string, finish boolean")
    got = {x.permit_num: x for x in SP.frozen_split(truth).collect()}
    stats = {}
    for _, g, f in rows:
        n, k = stats.get(g, (0, 0))
        stats[g] = (n + 1, k + f)
    import hashlib

    frac = lambda g: int(hashlib.sha256(f"42:{g}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    order = sorted((g for g in stats if stats[g][0] <= 300), key=lambda g: (frac(g), g))
    side = set(order[: round(0.25 * len(order))])
    for g in order:
        if len(side) >= 8 and sum(stats[x][1] for x in side) >= 15:
            break
        if g not in side and stats[g][1]:
            side.add(g)
    assert {g for g, x in got.items() if x.side == "eval"} == side and got["whale"].whale and got["whale"].side == "train"
    before = {x.permit_num: x.side for x in SP.hash_split(truth, "permit_num").collect()}
    more = truth.union(spark.createDataFrame([(99_999, "new", True)], truth.schema))
    after = {x.permit_num: x.side for x in SP.hash_split(more, "permit_num").collect()}
    assert all(after[g] == s for g, s in before.items())
    SP.assert_no_leak(SP.hash_split(truth, "permit_num"), "permit_num")
    with pytest.raises(AssertionError):
        SP.assert_no_leak(truth.withColumn("side", F.col("finish").cast("string")), "permit_num")


@pytest.mark.parametrize("n", [1, 2, 5])
def test_count_split(spark, n):
    got = [x.side for x in SP.count_split(spark.createDataFrame([(f"g{i}",) for i in range(n)], "g string"), "g").collect()]
    assert got.count("train") == {1: 1, 2: 1, 5: 4}[n]


def test_stratified_sample_is_without_replacement(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("permitNum"), "id")
    strata = [("a", F.col("id") < 30), ("b", F.col("id") < 45), ("c", F.col("id") % 2 == 0), ("none", F.lit(False))]
    got = SA.stratified_sample(df, strata, 15).collect()
    assert len({r.permitNum for r in got}) == len(got) == 45
    import hashlib

    frac = lambda k: int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
    taken, tests = {}, [lambda i: i < 30, lambda i: i < 45, lambda i: i % 2 == 0]
    for name, ok in zip("abc", tests):
        for i in sorted((i for i in range(200) if ok(i) and str(i) not in taken), key=lambda i: (frac(i), str(i)))[:15]:
            taken[str(i)] = name
    assert {r.permitNum: r.stratum for r in got} == taken


LOG = "id long, page_id long, source string, category string, confidence double, created_at string"


@pytest.fixture(scope="module")
def log(spark):
    r = random.Random(9)
    rows = [(i, r.randrange(40), r.choice(["human", "review", "labeler", "pilot", "x", None]), r.choice("ab"), r.choice([0.1, 0.5, 0.5, None]), f"2024-01-0{r.randint(1, 3)}") for i in range(400)]
    return spark.createDataFrame(rows, LOG)


def test_truths_agree(log):
    cols = ["page_id", "id"]
    assert sorted(W.current_truth(log).select(*cols).collect()) == sorted(W.current_truth_maxby(log).select(*cols).collect())
    assert sorted(W.view_truth(log).select(*cols).collect()) == sorted(W.view_truth_join(log).select(*cols).collect())


def test_streams_equal_batch(spark, log, tmp_path):
    log.repartition(5).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ST.stream_truth(src(), f"{tmp_path}/truth", f"{tmp_path}/c1", buckets=8).awaitTermination()
    best = sorted(W.current_truth(log).select("page_id", "id").collect())
    assert sorted(keyed.read(spark, f"{tmp_path}/truth", log.schema).select("page_id", "id").collect()) == best
    ST.stream_counts(src(), "source", "counts_t", f"{tmp_path}/c2").awaitTermination()
    assert sorted(map(repr, spark.table("counts_t").collect())) == sorted(map(repr, A.status_counts(log, "source").collect()))
    for checkpoint in ("c3", "c4"):  # all rows again by another stream
        ST.stream_ingest(src(), f"{tmp_path}/sink", "page_id", f"{tmp_path}/{checkpoint}", seq="id").awaitTermination()
    assert keyed.read(spark, f"{tmp_path}/sink", log.schema).count() == log.select("page_id").distinct().count()


def test_stream_goes_on_after_a_restart(spark, log, tmp_path):
    """New files after a stop, and a batch that failed after its folder was written: no row twice, other buckets stay."""
    sink, schema = f"{tmp_path}/truth", log.schema
    best = lambda rows: W.current_truth_maxby(rows, W.PRIORITY, "page_id")
    halves = [log.where(F.col("id") % 2 == k) for k in range(2)]
    assert keyed.upsert(halves[0], sink, "page_id", best, "s", 0, 8) == 1
    assert keyed.upsert(halves[0], sink, "page_id", best, "s", 0, 8) is None  # the same batch again
    halves[1].limit(3).write.partitionBy("source").parquet(f"{sink}/v=2")  # what a failed attempt left
    before = keyed.state(spark, sink)["buckets"]
    few = halves[1].where(F.pmod(F.xxhash64("page_id"), F.lit(8)) == 3)
    assert keyed.upsert(few, sink, "page_id", best, "s", 1, 8) == 2
    after = keyed.state(spark, sink)["buckets"]
    assert {k for k in after if after[k] != before.get(k)} == {"3"}
    assert keyed.upsert(halves[1], sink, "page_id", best, "s", 2, 8) == 3
    assert keyed.upsert(log.limit(0), sink, "page_id", best, "s", 3, 8) is None
    got = keyed.read(spark, sink, schema)
    assert sorted(got.select("page_id", "id").collect()) == sorted(W.current_truth(log).select("page_id", "id").collect())
    assert keyed.versions(spark, sink) == [2, 3]


SCORED = "page_id long, permit_num string, category string, score double"


def test_metrics(spark):
    r = random.Random(6)
    rows = [(i, f"p{i % 7}", r.choice(["finish_plan", "floor_plan", "mep", "other"]), r.random()) for i in range(300)] + [(999, "p1", "finish_plan", None)]
    scored = P.with_flags(spark.createDataFrame(rows, SCORED))
    grid = {x.thr: x for x in E.threshold_table(scored).collect()}
    recalls = [grid[t].finish_recall for t in sorted(grid, reverse=True)]
    assert recalls == sorted(recalls)
    assert all(grid[t][m] == E.micro_metrics(scored, t).first()[m] for t in grid for m in E.METRICS)
    full = E.full_recall_point(scored.where("score IS NOT NULL")).first()
    assert full.finish_recall == 1.0
    none = E.micro_metrics(scored.where("category = 'mep'")).first()
    assert none.finish_recall is None and none.keep_recall is None
    assert E.full_recall_threshold(scored.where("NOT finish")).first().thr is None
    curve = W.pr_curve(scored).orderBy(F.desc("score")).collect()
    assert curve[-1].tp == sum(c == "finish_plan" for _, _, c, s in rows if s is not None)
    assert E.misses(scored).first().page_id == 999


def test_router_falls_back_and_keeps(spark):
    rows = [(1, "p", "finish_plan", 0.4, "text"), (2, "p", "mep", 0.45, "text"), (3, "p", "mep", 0.45, "image"), (4, "p", "mep", None, "neither")]
    frame = P.with_flags(spark.createDataFrame(rows, SCORED + ", branch string"))
    got = {r.page_id: (r.thr, r.pred) for r in E.router(frame, frame).collect()}
    assert got == {1: (0.4, True), 2: (0.4, True), 3: (0.5, False), 4: (0.5, True)}


def test_leaderboard_and_plateau(spark):
    rows = [("a", 0.9, 0.2), ("b", 0.9, None), ("c", None, 0.0), ("d", 0.9, 0.1)]
    board = J.leaderboard(spark.createDataFrame(rows, "config string, finish_recall double, fp_rate double"), tie="config")
    assert [r.config for r in board.orderBy("rank").collect()] == ["d", "a", "b", "c"]
    log = spark.createDataFrame([(i, m) for i, m in enumerate([0.1, 0.5, 0.5, 0.4, 0.5, 0.6])], "cycle int, finish_recall double")
    assert [r.plateau for r in E.plateau(log).orderBy("cycle").collect()] == [False, False, False, False, True, False]


def test_extract_links_takes_the_last_name_in_the_window(spark):
    html = "<b>First.pdf (1/2/2024)</b> Second &amp; more.pdf (1/3/2024) <a onclick=DocRedirect(7)> <a onclick=docredirect(8)>" + "z" * 1300 + "DocRedirect(9)"
    got = X.extract_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r.page_id, r.pos, r.doc_id) for r in got] == [(1, 0, "7"), (1, 1, "8"), (1, 2, "9")]
    assert got[0].filename.endswith("Second & more.pdf") and got[2].filename == ""


def test_pages_cut_at_the_cap(spark):
    text = "\f".join(["x" * 60, "short", "y" * 30_000])
    got = X.explode_pages(spark.createDataFrame([(1, text), (2, None)], "document_id long, text string"), cap=2).collect()
    assert [(r.page_index, r.status, r.n_chars) for r in got] == [(0, "written", 60), (1, "short", 5), (2, "out_of_range", 30_000)]


def test_transitions_and_validation(spark):
    target = spark.createDataFrame([(1, "pending"), (2, "rendered"), (3, None)], "id long, status string")
    done, rejected = I.transition(target, spark.createDataFrame([(1, "downloaded"), (2, "pending"), (9, "error")], "id long, status string"))
    assert sorted((r.id, r.status) for r in done.collect() if r.status) == [(1, "downloaded"), (2, "rendered")]
    assert sorted(r.id for r in rejected.collect()) == [2, 9]
    cases = [None, "{", "[]", '{"category":"a","confidence":1.2}', '{"category":"a","confidence":null}', '{"category":"a","confidence":1}', '{"category":"a","confidence":0,"z":1}']
    valid, bad = I.validate_labels(spark.createDataFrame([(c,) for c in cases], "value string"), ["a"])
    assert [r.confidence for r in valid.collect()] == [1.0] and bad.count() == 6


def test_batches_keep_documents_together(spark):
    queue = spark.range(500).select(F.col("id").alias("page_id"), (F.col("id") % 37).alias("document_id"))
    got = I.cut_batches(queue, 3, 20).collect()
    worker = {}
    for r in got:
        worker.setdefault(r.document_id, set()).add(r.worker)
    sizes = {}
    for r in got:
        sizes[r.worker, r.batch] = sizes.get((r.worker, r.batch), 0) + 1
    assert all(len(w) == 1 for w in worker.values()) and max(sizes.values()) <= 20 and len(got) == 500


def test_sources(spark, tmp_path):
    import numpy as np

    (tmp_path / "log.csv").write_text('1,ok,10,"a, b"\n1,ok,20,c\n2,not_pdf,5,d\n3,ok\n')
    got = io.read_download_log(spark, f"{tmp_path}/log.csv").collect()
    assert [(r.doc_id, r.bytes, r.name) for r in got] == [("1", 20, "c")]
    np.savez(tmp_path / "v.npz", emb=np.ones((3, 4), np.float16), page_id=np.array(["1", "2", "3"]))
    assert io.read_embeddings(spark, f"{tmp_path}/v.npz", "b").agg(F.sum("page_id"), F.first(F.size("embedding"))).first() == (6, 4)
    np.savez(tmp_path / "w.npz", emb=np.ones((3, 4), np.float16), page_id=np.array(["1"]))
    with pytest.raises(Exception, match="one length"):
        io.read_embeddings(spark, f"{tmp_path}/w.npz", "b")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"ok \xff text")
    assert io.read_text_files(spark, f"{tmp_path}/t").first().text == "ok  text"
    pdf = spark.createDataFrame([(1, bytearray(b"%PDF" + b"x" * 20_000)), (2, bytearray(b"%PDF")), (3, bytearray(b"<HTML>no")), (4, bytearray(b"zip")), (5, None)], "id int, content binary")
    assert [r.reason for r in io.triage_binary(pdf).orderBy("id").collect()] == [None, "too_small", "block_page", "not_pdf", "empty"]
    with pytest.raises(ValueError):
        J.align(spark.range(3), spark.range(5), "id")


def test_features(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "red fish"), (3, ""), (4, None)], "page_id long, text string")
    fitted = FE.fit_tfidf(docs)
    assert [r.term for r in fitted.vocab.orderBy("rank").collect()] == ["red", "fish", "red fish"]
    norms = fitted.transform(docs).groupBy("page_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n")).collect()
    assert {r.page_id for r in norms} == {1, 2} and all(abs(r.n - 1) < 1e-9 for r in norms)
    assert fitted.vectors(docs, 3).where("page_id = 3").first().features.numNonzeros() == 0

    def encoder(texts):
        import numpy as np

        return np.array([[len(t), 1.0] for t in texts])

    got = FE.embed(docs, encoder, "len", content="text").collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3]
    svd = FE.fit_svd(fitted.vectors(docs, 3), k=2)
    back = svd.transform(fitted.vectors(docs, 3)).where("page_id = 1").first()
    assert len(back.svd) == 2


def test_yield_table_lists_empty_strata(spark):
    rows = spark.createDataFrame([("a", "1", "x", "3"), ("a", "0", "", "1"), ("zz", "2", "1", "2")], "stratum string, docCount string, planLikeCount string, pdfCount string")
    got = {r.stratum: tuple(r)[1:] for r in A.yield_table(rows, spark.createDataFrame([("a",), ("b",)], "stratum string")).collect()}
    assert got == {"a": (2, "50.0%", "0.0%", 2.0), "b": (0, "", "", None), "zz": (1, "100.0%", "100.0%", 2.0)}
