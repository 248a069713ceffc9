"""Aggregates, samples, splits, near-duplicates, features, evaluation and incremental tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_frac
from ..operators import aggregates as A, dedup as D, evaluate as E, features as FE, incremental as I, joins as J, models as M, sampling as SA, splits as SP, windows as W
from ..plans.storage import materialize, scratch_path, spread
from ..streaming import keyed
from ..sources import io
from ..sources.schemas import CATEGORIES
from ..streaming import tables as ST
from .basic import names
from .registry import LABELS, PERMITS, PRIORITY_SQL, SCORED, STRATA_SQL, TRUTH, hash_sql, labels, metrics_sql, permits, query, rounded, scored, strata, table, truth

GRID_SQL = "(VALUES (0.9),(0.8),(0.7),(0.6),(0.5),(0.4),(0.3),(0.2),(0.1),(0.05),(0.02)) g(t)"


def flagship(spark, sf):
    """Current labels, split by group, measured under a deterministic score."""
    return rounded(E.micro_metrics(scored(spark, sf).where("side = 'eval'")))


@query("""WITH s AS (SELECT unnest(['PROMO','SMALL','ECONOMY','MEDIUM','NOTHING']) stratum), r AS (SELECT p_type stratum, count(*) n, count(*) FILTER (WHERE p_size % 5 > 0) d, count(*) FILTER (WHERE p_size % 3 = 0) p, median(p_size % 7) m FROM part GROUP BY 1)
SELECT coalesce(s.stratum, r.stratum) stratum, coalesce(n, 0) n, CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE printf('%.1f%%', 100.0 * d / n) END pct_docs, CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE printf('%.1f%%', 100.0 * p / n) END pct_plans, m::DOUBLE median_pdfs FROM s FULL JOIN r ON s.stratum = r.stratum""")
def agg1_yield_table(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_type").alias("stratum"), (F.col("p_size") % 5).cast("string").alias("docCount"), F.when(F.col("p_size") % 3 == 0, "1").otherwise("0").alias("planLikeCount"), (F.col("p_size") % 7).cast("string").alias("pdfCount"))
    return A.yield_table(rows, spark.createDataFrame([(x,) for x in ("PROMO", "SMALL", "ECONOMY", "MEDIUM", "NOTHING")], "stratum string"))


@query("SELECT p_type, median(p_size)::DOUBLE m FROM part GROUP BY 1")
def agg2_median(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.median("p_size").cast("double").alias("m"))


@query("SELECT event_type, count(*) n FROM events GROUP BY 1")
def agg3_status_counts(spark, sf):
    return A.status_counts(table(spark, sf, "events"), "event_type")


@query(f"WITH {TRUTH} SELECT permit_num, count(*) pages, count(*) FILTER (WHERE finish) finish_pages FROM truth GROUP BY 1")
def agg4_permit_stats(spark, sf):
    return A.permit_stats(truth(spark, sf))


_SPLIT = f"""stats AS (SELECT permit_num, count(*) pages, count(*) FILTER (WHERE finish) finish_pages FROM truth GROUP BY 1),
small AS (SELECT *, {hash_sql('permit_num')} h FROM stats WHERE pages <= 12), placed AS (SELECT *, row_number() OVER (ORDER BY h, permit_num) rn, count(*) OVER () n FROM small),
cut AS (SELECT *, rn <= round_even(0.25 * n, 0) first FROM placed), base AS (SELECT count(*) n0, coalesce(sum(finish_pages), 0) f0 FROM cut WHERE first),
more AS (SELECT permit_num, n0 + count(*) OVER w - 1 < 20 OR f0 + sum(finish_pages) OVER w - finish_pages < 15 moved FROM cut, base WHERE NOT first AND finish_pages > 0 WINDOW w AS (ORDER BY h, permit_num ROWS UNBOUNDED PRECEDING)),
split AS (SELECT permit_num, pages, finish_pages, false whale, coalesce(moved, false) moved, CASE WHEN first OR moved THEN 'eval' ELSE 'train' END side FROM cut LEFT JOIN more USING (permit_num)
 UNION ALL SELECT permit_num, pages, finish_pages, true, false, 'train' FROM stats WHERE pages > 12)"""


def frozen(spark, sf):
    return SP.frozen_split(truth(spark, sf), whale=12, min_groups=20)


@query(f"WITH {TRUTH}, {_SPLIT} SELECT * FROM split")
def spl4_frozen_split(spark, sf):
    return frozen(spark, sf)


@query(f"WITH {TRUTH}, {_SPLIT} SELECT side, count(*) groups, sum(pages)::BIGINT pages, sum(finish_pages)::BIGINT finish_pages, count(*) FILTER (WHERE whale) whales, count(*) FILTER (WHERE moved) moved, CASE WHEN side = 'eval' THEN count(*) >= 20 AND sum(finish_pages) >= 15 END floors_met FROM split GROUP BY ROLLUP (side)")
def agg5_split_stats(spark, sf):
    return SP.split_stats(frozen(spark, sf), min_groups=20)


_side = lambda s: f"string_agg(permit_num, ',' ORDER BY permit_num) FILTER (WHERE side = '{s}') {s}, count(*) FILTER (WHERE side = '{s}') {s}_permits, coalesce(sum(pages) FILTER (WHERE side = '{s}'), 0)::BIGINT {s}_pages, coalesce(sum(finish_pages) FILTER (WHERE side = '{s}'), 0)::BIGINT {s}_finish"


@query(f"WITH {TRUTH}, {_SPLIT}, doc AS (SELECT {_side('train')}, {_side('eval')}, count(*) total_permits, sum(pages)::BIGINT total_pages, sum(finish_pages)::BIGINT total_finish_pages, coalesce(string_agg(permit_num || ':' || pages::VARCHAR, ',' ORDER BY permit_num) FILTER (WHERE whale), '') whales, coalesce(string_agg(permit_num || ':' || pages::VARCHAR || ':' || finish_pages::VARCHAR, ',' ORDER BY {hash_sql('permit_num')}, permit_num) FILTER (WHERE moved), '') moved FROM split) SELECT *, eval_permits >= 20 AND eval_finish >= 15 floors_met, NOT (eval_permits >= 20 AND eval_finish >= 15) exhausted FROM doc")
def src9_split_document(spark, sf):
    """The frozen split written as a document and read back, its lists as texts; a side without groups has none."""
    path = scratch_path(spark, "split")
    io.write_split(frozen(spark, sf), path, min_groups=20)
    doc, side = io.read_split_document(spark, path), lambda s: (F.array_join(F.when(F.size(s) > 0, F.col(s)), ",").alias(s), F.col(f"stats.{s}.permits").alias(f"{s}_permits"), F.col(f"stats.{s}.pages").alias(f"{s}_pages"), F.col(f"stats.{s}.finish_pages").alias(f"{s}_finish"))
    listed = lambda c, *names: F.array_join(F.transform(f"stats.{c}", lambda x: F.concat_ws(":", *(x[n].cast("string") for n in names))), ",")
    return doc.select(
        *side("train"), *side("eval"), "stats.total_permits", "stats.total_pages", "stats.total_finish_pages", listed("whales_forced_train", "permit_num", "pages").alias("whales"),
        listed("moved_to_eval_to_meet_floors", "permit_num", "pages", "finish_pages").alias("moved"), "stats.floors_met", F.col("stats.floors_exhausted_without_meeting").alias("exhausted"))


@query(f"WITH {TRUTH}, {_SPLIT} SELECT permit_num, pages FROM split WHERE whale")
def agg5_whales(spark, sf):
    return SP.whales(frozen(spark, sf))


@query(f"WITH {TRUTH}, {_SPLIT} SELECT d.doc_id, coalesce(split.side, 'train') side, split.side IS NULL is_new FROM documents d LEFT JOIN split ON split.permit_num = concat_ws('-', source, lang)")
def spl5_apply_frozen_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("permit_num"))
    return SP.apply_frozen_split(d, frozen(spark, sf)).select("doc_id", "side", "is_new")


@query(f"WITH {TRUTH}, {_SPLIT} SELECT t.page_id, coalesce(side, 'train') side FROM truth t LEFT JOIN split USING (permit_num)")
def jn11_membership(spark, sf):
    return SP.apply_frozen_split(truth(spark, sf), frozen(spark, sf)).select("page_id", "side")


@query(f"WITH {SCORED} SELECT side, count(*) total, count(*) FILTER (WHERE n_chars > 1500) covered, round(count(*) FILTER (WHERE n_chars > 1500)::DOUBLE / count(*), 6) \"share\" FROM scored GROUP BY ROLLUP (side)")
def agg6_coverage(spark, sf):
    return rounded(A.coverage(scored(spark, sf).withColumn("has", F.col("n_chars") > 1500), "has", "side"))


@query(f"WITH {SCORED}, b AS (SELECT side, count(*) FILTER (WHERE n_chars > 1500)::DOUBLE / count(*) s FROM scored GROUP BY ROLLUP (side)), a AS (SELECT side, count(*) total, count(*) FILTER (WHERE n_chars > 800)::DOUBLE / count(*) s FROM scored GROUP BY ROLLUP (side)) SELECT a.side, total, round(a.s, 6) share_after, round(b.s, 6) share_before, round(a.s - b.s, 6) gain FROM a JOIN b ON a.side IS NOT DISTINCT FROM b.side")
def agg6_coverage_delta(spark, sf):
    rows = scored(spark, sf)
    return rounded(A.coverage_delta(rows.withColumn("has", F.col("n_chars") > 1500), rows.withColumn("has", F.col("n_chars") > 800), "has", "side"))


@query("SELECT source document_id, count(*) FILTER (WHERE n_chars < 800) missing, count(*) pages FROM documents GROUP BY 1 HAVING missing > 0")
def agg7_missing_by_doc(spark, sf):
    d = table(spark, sf, "documents").withColumn("gone", F.col("n_chars") < 800).withColumnRenamed("source", "document_id")
    return A.missing_by_doc(d, "gone")


@query("SELECT count(DISTINCT user_id) n, count(DISTINCT event_type) k FROM events")
def agg8_distinct(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.count_distinct("user_id").alias("n"), F.count_distinct("event_type").alias("k"))


@query(f"WITH {LABELS} SELECT page_id, max(CASE WHEN source = 'human' THEN 2.0 ELSE coalesce(confidence, -1) END) best FROM labels_ GROUP BY 1")
def agg9_best_rank(spark, sf):
    rank = F.when(F.col("source") == "human", F.lit(2.0)).otherwise(F.coalesce("confidence", F.lit(-1.0)))
    return labels(spark, sf).groupBy("page_id").agg(F.max(rank).alias("best"))


@query("SELECT (coalesce(max(event_id), 0) + 1)::BIGINT next_id FROM events")
def agg11_next_id(spark, sf):
    return A.next_id(table(spark, sf, "events"), "event_id")


@query(f"WITH {TRUTH} SELECT category, count(*) pages, round(avg(keep::INT), 6) keep_rate, round(avg(n_chars), 6) mean_confidence FROM truth GROUP BY ROLLUP (category)")
def agg12_label_summary(spark, sf):
    return rounded(A.label_summary(truth(spark, sf), confidence="n_chars"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' floor layout.pdf' WHEN 1 THEN p_name || ' site plan.pdf' WHEN 2 THEN 'A-' || p_size::VARCHAR || ' ' || p_name || '.dwg' WHEN 3 THEN p_name || ' mep plans.pdf' ELSE p_name || '.msg' END"
_KIND = "CASE p_partkey % 5 WHEN 1 THEN 'site_only' WHEN 4 THEN 'neither' ELSE 'plan' END"


@query(f"SELECT p_brand, count(*) docs, count(*) FILTER (WHERE ends_with(name, '.pdf')) pdfs, count(*) FILTER (WHERE kind = 'plan') plans, count(*) FILTER (WHERE kind = 'site_only') site_only, coalesce(string_agg(name, ';' ORDER BY p_partkey) FILTER (WHERE kind = 'plan'), '') AS names, string_agg(p_partkey::VARCHAR, ';' ORDER BY p_partkey) ids, string_agg(p_partkey::VARCHAR || '|' || name, ';' ORDER BY p_partkey) pairs FROM (SELECT *, {_NAME} AS name, {_KIND} kind FROM part) GROUP BY 1")
def agg13_doc_rollup(spark, sf):
    return A.doc_rollup(names(spark, sf), "p_brand", "p_partkey", "p_partkey", "name")


@query(f"SELECT p_type, count(*) docs, count(*) FILTER (WHERE ends_with({_NAME}, '.pdf')) pdfs, count(*) FILTER (WHERE {_KIND} = 'plan') plans, count(*) FILTER (WHERE {_KIND} = 'site_only') site_only FROM part GROUP BY 1")
def agg14_doc_counts(spark, sf):
    return A.doc_rollup(names(spark, sf), "p_type", "p_partkey", "p_partkey", "name").select("p_type", "docs", "pdfs", "plans", "site_only")


_PAIRS = f"{LABELS}, pairs AS (SELECT page_id, arg_max(category, id) FILTER (WHERE source = 'labeler') label_a, arg_max(category, id) FILTER (WHERE source = 'review') label_b FROM labels_ GROUP BY 1 HAVING label_a IS NOT NULL AND label_b IS NOT NULL)"


@query(f"WITH {_PAIRS} SELECT label_a, label_b, count(*) n, (SELECT round(avg((label_a = label_b)::INT), 6) FROM pairs) agreement FROM pairs GROUP BY 1, 2")
def agg15_agreement(spark, sf):
    return rounded(A.agreement(labels(spark, sf), "labeler", "review"))


@query(f"WITH {_PAIRS} SELECT page_id, label_a, label_b FROM pairs WHERE label_a <> label_b AND page_id NOT IN (SELECT page_id FROM labels_ WHERE source = 'adjudicate')")
def agg16_adjudication_queue(spark, sf):
    return A.adjudication_queue(labels(spark, sf))


@query(f"WITH {LABELS} SELECT page_id, source, category, count(*) n FROM labels_ GROUP BY ALL HAVING n > 1")
def agg17_duplicate_rows(spark, sf):
    return A.duplicate_rows(labels(spark, sf))


@query(f"WITH {SCORED} SELECT side, count(DISTINCT permit_num) permits FROM scored GROUP BY 1")
def agg18_distinct_permits(spark, sf):
    return scored(spark, sf).groupBy("side").agg(F.count_distinct("permit_num").alias("permits"))


def _sample_sql(n: int) -> str:
    flags = ", ".join(f"CASE WHEN {c} THEN {k} END" for k, (_, c) in enumerate(STRATA_SQL, 1))
    label = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(STRATA_SQL, 1))
    steps, taken = [], "SELECT NULL::BIGINT p, 0 k WHERE false"
    for k in range(1, 13):
        before = f"(SELECT p FROM s{k - 1})" if k > 1 else "(SELECT 0::BIGINT WHERE false)"
        own = f"SELECT p, {k} k FROM (SELECT p, h FROM hits WHERE k = {k} AND p NOT IN {before} ORDER BY h, p LIMIT {n})"
        steps.append(f"s{k} AS ({own} UNION ALL {'SELECT p, k FROM s' + str(k - 1) if k > 1 else taken})")
    return f"WITH {PERMITS}, hits AS (SELECT \"permitNum\" p, {hash_sql(chr(34) + 'permitNum' + chr(34))} h, unnest(list_filter([{flags}], lambda x: x IS NOT NULL)) k FROM permits), {', '.join(steps)} SELECT p AS \"permitNum\", CASE k {label} END stratum FROM s12"


@query(_sample_sql(15))
def spl1_stratified_sample(spark, sf):
    return SA.stratified_sample(permits(spark, sf), strata(), 15).select("permitNum", "stratum")


@query(f"SELECT doc_id, CASE WHEN {hash_sql('source')} < 0.2 THEN 'eval' ELSE 'train' END side FROM documents")
def spl2_hash_split(spark, sf):
    return SP.hash_split(table(spark, sf, "documents"), "source").select("doc_id", "side")


@query(f"WITH g AS (SELECT DISTINCT concat_ws('-', source, lang) g FROM documents), p AS (SELECT g, row_number() OVER (ORDER BY {hash_sql('g')}, g) rn, count(*) OVER () n FROM g) SELECT g, CASE WHEN rn <= CASE WHEN n < 2 THEN n ELSE greatest(1, least(round_even(0.8 * n, 0), n - 1)) END THEN 'train' ELSE 'eval' END side FROM p")
def spl3_count_split(spark, sf):
    return SP.count_split(table(spark, sf, "documents").withColumn("g", F.concat_ws("-", "source", "lang")), "g")


@query(f"WITH {LABELS} SELECT id FROM labels_ WHERE {hash_sql('id')} < 0.1")
def spl7_audit_sample(spark, sf):
    return SA.audit_sample(labels(spark, sf), key="id").select("id")


@query("SELECT lang, count(DISTINCT source) sides FROM documents GROUP BY 1 HAVING sides > 1")
def spl9_leaks(spark, sf):
    return SP.leaks(table(spark, sf, "documents"), "lang", "source")


_PAIRSQL = "pairs AS (SELECT a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4)"


def vec_pairs(spark, sf, t=0.4):
    return D.similar_pairs(table(spark, sf, "embeddings"), t, "vec_id")


@query(f"WITH {_PAIRSQL} SELECT a, b, round(cos, 4) cos FROM pairs")
def dup1_similar_pairs(spark, sf):
    return rounded(vec_pairs(spark, sf), n=4)


def with_copies(spark, sf):
    """The embeddings, and each once more with a first number a twentieth larger."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.union(e.select(F.col("vec_id") + 10_000_000, F.transform("embedding", lambda x, i: F.when(i == 0, x * F.lit(1.05).cast("float")).otherwise(x))))


_COPIES = "copies AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, list_prepend((embedding[1] * 1.05::FLOAT)::FLOAT, embedding[2:]) FROM embeddings), near AS (SELECT a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) cos FROM copies a JOIN copies b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.98)"


@query(f"WITH {_COPIES} SELECT a, b, round(cos, 5) cos FROM near")
def dup1_near_copies(spark, sf):
    return rounded(D.similar_pairs(with_copies(spark, sf), 0.98, "vec_id"), n=5)


@query("SELECT 2 * count(*) vectors, true pruned FROM embeddings")
def dup1_pruning(spark, sf):
    """Whether far fewer than all pairs meet at the threshold that is in use."""
    return D.pruning_report(with_copies(spark, sf), 0.98, "vec_id").select("vectors", (F.col("share") < 0.5).alias("pruned"))


@query(f"WITH {_COPIES} SELECT count(*) pairs, true enough FROM near")
def dup1_lsh_recall(spark, sf):
    """The exact pairs, and whether random projections find at least nine in ten of them and nothing else."""
    e = with_copies(spark, sf)
    exact = materialize(D.similar_pairs(e, 0.98, "vec_id").select("a", "b"), "exact")
    found = D.lsh_pairs(e, 0.98, "vec_id").select("a", "b", F.lit(True).alias("f"))
    both = exact.withColumn("e", F.lit(True)).join(found, ["a", "b"], "full")
    return both.agg(F.count("e").alias("pairs"), (F.count_if(F.col("e") & F.col("f")) >= 0.9 * F.count("e")).alias("enough"))


_COMP = f"{_PAIRSQL}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT vec_id s, vec_id t FROM embeddings UNION SELECT s, b FROM reach JOIN edges ON t = a), comp AS (SELECT s vec_id, min(t) leader FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {_COMP} SELECT * FROM comp")
def dup2_components(spark, sf):
    e = table(spark, sf, "embeddings")
    return D.dup_components(D.similar_links(e, 0.4, "vec_id"), e, "vec_id")


#: The sequential loop as a recursion: one step an id, with the list of leaders so far.
_LEADERS = f"{_PAIRSQL}, ids AS (SELECT vec_id id, row_number() OVER (ORDER BY vec_id) k FROM embeddings), near AS (SELECT k, id, coalesce(list(a) FILTER (WHERE a IS NOT NULL), []) nb FROM ids LEFT JOIN pairs ON b = id GROUP BY ALL), walk AS (SELECT 0::BIGINT k, []::BIGINT[] leaders UNION ALL SELECT walk.k + 1, CASE WHEN len(list_intersect(leaders, nb)) > 0 THEN leaders ELSE list_append(leaders, id) END FROM walk JOIN near ON near.k = walk.k + 1), done AS (SELECT unnest(leaders) l FROM walk WHERE k = (SELECT count(*) FROM ids)), joins AS (SELECT b, arg_max(a, (cos, -a)) l FROM pairs JOIN done ON a = l GROUP BY b), led AS (SELECT id vec_id, coalesce(l, id) leader FROM ids LEFT JOIN joins ON b = id)"


@query(f"WITH RECURSIVE {_LEADERS} SELECT vec_id, leader FROM led")
def dup3_leaders(spark, sf):
    return D.similar_leaders(table(spark, sf, "embeddings"), 0.4, "vec_id")


def sided_groups(spark, sf):
    e = table(spark, sf, "embeddings")
    leaders = materialize(D.dup_components(D.similar_links(e, 0.4, "vec_id"), e, "vec_id"), "leaders")
    return leaders.withColumn("side", F.when(hash_frac("vec_id") < 0.5, "eval").otherwise("train"))


_SIDED = f"{_COMP}, sided AS (SELECT *, CASE WHEN {hash_sql('vec_id')} < 0.5 THEN 'eval' ELSE 'train' END side FROM comp)"


@query(f"WITH RECURSIVE {_SIDED} SELECT min(vec_id) vec_id, leader FROM sided WHERE side = 'eval' GROUP BY leader")
def dup4_eval_representatives(spark, sf):
    return D.eval_representatives(sided_groups(spark, sf), "vec_id").select("vec_id", "leader")


@query(f"WITH RECURSIVE {_SIDED} SELECT min(vec_id) vec_id, leader FROM sided WHERE side = 'eval' GROUP BY leader")
def win6_eval_representatives(spark, sf):
    return D.eval_representatives(sided_groups(spark, sf), "vec_id").select("vec_id", "leader")


@query(f"WITH RECURSIVE {_SIDED} SELECT vec_id FROM sided WHERE side = 'eval' AND vec_id = leader")
def dup5_eval_global(spark, sf):
    return D.eval_global_representatives(sided_groups(spark, sf), "vec_id").select("vec_id")


@query(f"WITH RECURSIVE {_SIDED} SELECT count(*) pages, count(DISTINCT leader) AS groups, count(*) FILTER (WHERE side = 'eval') eval_before, count(*) - count(DISTINCT leader) duplicates, count(DISTINCT leader) FILTER (WHERE side = 'eval') eval_after FROM sided")
def dup6_report(spark, sf):
    return D.dedup_report(sided_groups(spark, sf), "vec_id")


@query(f"WITH RECURSIVE {_SIDED} SELECT vec_id, round(1.0 / count(*) OVER (PARTITION BY leader), 6) weight FROM sided")
def dup7_weights(spark, sf):
    return rounded(D.dup_weights(sided_groups(spark, sf))).select("vec_id", "weight")


def _nn_sql(where: str) -> str:
    return f"WITH e AS (SELECT *, vec_id // 5 document, vec_id % 7 permit FROM embeddings), n AS (SELECT a.vec_id, a.label la, a.document da, a.permit pa, arg_max(struct_pack(l := b.label, d := b.document, p := b.permit), list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) x FROM e a JOIN e b ON {where} GROUP BY ALL), c AS (SELECT label, count(*) n FROM embeddings GROUP BY 1) SELECT count(*) pages, round(avg((la = x.l)::INT), 6) same_category, round(avg(((la < 4) = (x.l < 4))::INT), 6) same_keep, round(avg((da = x.d)::INT), 6) same_document, round(avg((pa = x.p)::INT), 6) same_permit, (SELECT round(sum((n / 1.0 / (SELECT sum(n) FROM c)) ** 2), 6) FROM c) chance_category FROM n"


def _nn(spark, sf, group=None):
    e = table(spark, sf, "embeddings")
    known = e.select("vec_id", F.col("label").alias("category"), (F.col("label") < 4).alias("keep"), F.expr("vec_id div 5").alias("document"), (F.col("vec_id") % 7).alias("permit"))
    return rounded(D.nn_diagnosis(e.select("vec_id", "embedding"), known, "vec_id", group=group, same=("document", "permit")))


@query(_nn_sql("a.vec_id <> b.vec_id"))
def dup8_nn_diagnosis(spark, sf):
    return _nn(spark, sf)


@query(_nn_sql("a.permit <> b.permit"))
def dup8_cross_permit(spark, sf):
    return _nn(spark, sf, "permit")


@query("SELECT sha256(text) sha256, count(*) n, min(doc_id) first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING n > 1")
def dup9_exact_dups(spark, sf):
    return D.exact_dups(table(spark, sf, "documents"))


_SPLIT6 = f"{_LEADERS}, {TRUTH}, g AS (SELECT permit_num, row_number() OVER (ORDER BY {hash_sql('permit_num')}, permit_num) rn, count(*) OVER () n FROM (SELECT DISTINCT permit_num FROM truth)), s AS (SELECT page_id, t.permit_num, CASE WHEN rn <= CASE WHEN n < 2 THEN n ELSE greatest(1, least(round_even(0.8::DOUBLE * n, 0), n - 1)) END THEN 'train' ELSE 'eval' END side, coalesce(leader, page_id) leader FROM truth t JOIN g USING (permit_num) LEFT JOIN led ON vec_id = page_id)"


@query(f"WITH RECURSIVE {_SPLIT6} SELECT page_id, permit_num, side, leader FROM s QUALIFY side = 'train' OR row_number() OVER (PARTITION BY leader, side ORDER BY page_id) = 1")
def spl6_canonical_split(spark, sf):
    leaders = D.similar_leaders(table(spark, sf, "embeddings"), 0.4, "vec_id").withColumnRenamed("vec_id", "page_id")
    return SP.canonical_split(truth(spark, sf), leaders).select("page_id", "permit_num", "side", "leader")


_TERMS = """toks AS (SELECT page_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') w FROM src), terms AS (SELECT page_id, term, count(*) tf FROM (SELECT page_id, unnest(w) term FROM toks UNION ALL SELECT page_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks) GROUP BY ALL)"""
_VOCAB = """vocab AS (SELECT term, sum(tf)::BIGINT tf, count(*) df FROM fit GROUP BY 1 HAVING df >= 2), ranked AS (SELECT *, ln((1.0 + (SELECT count(*) FROM src WHERE train)) / (1.0 + df)) + 1 idf, row_number() OVER (ORDER BY tf DESC, term)::INT rank FROM vocab QUALIFY rank <= 30000)"""
_SRC = "src AS (SELECT doc_id page_id, text, doc_id % 4 > 0 train FROM documents)"


def tfidf(spark, sf):
    d = spread(table(spark, sf, "documents").withColumnRenamed("doc_id", "page_id"))
    return d, FE.fit_tfidf(d.where("page_id % 4 > 0"), top=30000)


@query(f"WITH {_SRC}, {_TERMS}, fit AS (SELECT t.* FROM terms t JOIN src USING (page_id) WHERE train), {_VOCAB} SELECT term, tf, df, round(idf, 6) idf, rank FROM ranked")
def fea10_vocab_stats(spark, sf):
    return rounded(tfidf(spark, sf)[1].vocab)


@query(f"WITH {_SRC}, {_TERMS}, fit AS (SELECT t.* FROM terms t JOIN src USING (page_id) WHERE train), {_VOCAB}, w AS (SELECT page_id, term, rank, t.tf * idf x FROM terms t JOIN ranked USING (term)) SELECT page_id, term, rank, round(x / sqrt(sum(x * x) OVER (PARTITION BY page_id)), 5) tfidf FROM w WHERE page_id % 4 = 0")
def fea1_tfidf(spark, sf):
    d, fitted = tfidf(spark, sf)
    return rounded(fitted.transform(d.where("page_id % 4 = 0")), n=5)


@query()
def fea2_svd(spark, sf):
    """All documents' 256 places in the space fitted on train, and the share of their length that it keeps."""
    d, fitted = tfidf(spark, sf)
    vectors = materialize(fitted.vectors(d.select("page_id", "text")).drop("text"), "vectors")
    placed = FE.fit_svd(vectors.where("page_id % 4 > 0"), k=256).transform(vectors)
    return placed.select("page_id", "svd", F.round(F.aggregate("svd", F.lit(0.0), lambda s, x: s + x * x), 3).alias("kept"))


@query("SELECT vec_id, len(embedding) * 2 n, round(sqrt(2), 5) norm FROM embeddings")
def fea3_concat_blocks(spark, sf):
    from ..functions.scalars import norm

    both = FE.concat_blocks(table(spark, sf, "embeddings").withColumn("again", F.reverse("embedding")), "embedding", "again")
    return rounded(both.select("vec_id", F.size("features").cast("long").alias("n"), norm("features").alias("norm")), n=5)


@query("WITH e AS (SELECT vec_id, list_concat(embedding, list_reverse(embedding))::DOUBLE[] x FROM embeddings) SELECT vec_id, len(x)::INT n, round(list_sum(list_transform(x, lambda v, i: v * i)), 4) placed FROM e")
def fea4_hstack(spark, sf):
    """The length of both vectors side by side, and the sum of all values times their places."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = lambda c: array_to_vector(c.cast("array<double>"))
    e = table(spark, sf, "embeddings").select("vec_id", vector(F.col("embedding")).alias("v"), vector(F.reverse("embedding")).alias("w"))
    both = FE.hstack_sparse(e, "v", "w").withColumn("x", vector_to_array("features"))
    placed = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rounded(both.select("vec_id", F.size("x").alias("n"), placed.alias("placed")), n=4)


@query("SELECT (i - 1)::INT i, round(avg(x), 5) mean, round(stddev_pop(x), 5) std, round(max(abs(x))::DOUBLE, 5) max_abs FROM (SELECT unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY i")
def fea5_standard_stats(spark, sf):
    return rounded(FE.column_stats(table(spark, sf, "embeddings")), n=5)


@query("WITH c AS (SELECT unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) i, vec_id FROM embeddings), m AS (SELECT i, max(abs(x)) m FROM c GROUP BY i) SELECT vec_id, round(sum(CASE WHEN m > 0 THEN x / m ELSE 0 END * i), 4) placed FROM c JOIN m USING (i) GROUP BY vec_id")
def fea6_max_abs(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    scaled = FE.fit_scaler(e, "max_abs").transform(e)
    placed = F.aggregate(F.transform(vector_to_array("scaled"), lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rounded(scaled.select("vec_id", placed.alias("placed")), n=4)


@query(f"WITH {TRUTH} SELECT page_id, (dense_rank() OVER (ORDER BY category) - 1)::DOUBLE \"label\" FROM truth")
def fea7_label_index(spark, sf):
    t = truth(spark, sf)
    return FE.label_index(t).transform(t).select("page_id", "label")


@query(f"WITH {TRUTH}, c AS (SELECT category, count(*) n FROM truth GROUP BY 1) SELECT category, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) weight FROM c")
def fea8_class_weights(spark, sf):
    return rounded(FE.class_weights(truth(spark, sf), "category"))


def letters(texts):
    """A small encoder: shares of the letters of each text; raises for empty ones."""
    import numpy as np

    out = np.zeros((len(texts), 26))
    for i, t in enumerate(texts):
        at = np.frombuffer(t.lower().encode("ascii", "ignore"), np.uint8)
        at = at[(at >= 97) & (at < 123)] - 97
        out[i] = np.bincount(at, minlength=26) / max(1, len(at))
    return out


@query("SELECT doc_id, 'letters' backbone, 26::INT n, len(list_distinct(regexp_extract_all(lower(text), '[a-z]')))::INT seen, true whole FROM documents WHERE text IS NOT NULL")
def fea9_embed(spark, sf):
    """Each text's number of different letters, and whether their shares add up to one within half precision."""
    e = FE.embed(table(spark, sf, "documents"), letters, "letters", key="doc_id", content="text")
    seen = F.size(F.filter("embedding", lambda x: x > 0)).alias("seen")
    whole = F.abs(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x) - 1) < 0.01
    return e.select("doc_id", "backbone", F.size("embedding").alias("n"), seen, (whole | (F.col("seen") == 0)).alias("whole"))


def letter_features(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = FE.embed(table(spark, sf, "documents"), letters, "letters", key="doc_id", content="text")
    return e.select(F.col("doc_id").alias("page_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def head_rows(spark, sf):
    """Labelled pages with sides and letter features, written once: a head reads them many times, and texts not again."""
    rows = scored(spark, sf).select("page_id", "permit_num", "category", "keep", "side")
    return materialize(rows.join(letter_features(spark, sf), "page_id"), "rows")


def heads(spark, sf, head, task):
    rows = head_rows(spark, sf)
    model = M.fit_head(rows.where("side = 'train'"), head, task)
    return M.score(model, rows.where("side = 'eval'"), ("floor_plan", "finish_plan", "finish_schedule", "demo_plan")).select("page_id", "permit_num", "score")


@query()
def mod1_logistic(spark, sf):
    return heads(spark, sf, "logreg", "binary")


@query()
def mod2_collapse_head(spark, sf):
    return heads(spark, sf, "logreg", "collapse")


@query(f"WITH {TRUTH} SELECT page_id, round(({hash_sql('page_id', 1)} + {hash_sql('page_id', 3)}) / 4, 6) score FROM truth")
def mod2_collapse(spark, sf):
    probs = F.array(*[hash_frac("page_id", s) / 4 for s in range(1, 5)])
    return rounded(truth(spark, sf).withColumn("p", probs).select("page_id", E.collapse("p", ["a", "b", "c", "d"], {"a", "c"}).alias("score")))


@query()
def mod3_mlp(spark, sf):
    return heads(spark, sf, "mlp", "binary")


@query()
def mod4_trees(spark, sf):
    return heads(spark, sf, "trees", "binary")


@query(f"WITH {TRUTH} SELECT 'single keep class' reason, count(*) n FROM truth WHERE keep")
def mod5_guard(spark, sf):
    kept = truth(spark, sf).where("keep")
    return kept.agg(F.lit(M.fit_guard(kept, "binary")).alias("reason"), F.count("*").alias("n"))


def lengths(texts):
    """Shares of words by length up to 16; raises for texts without words."""
    import numpy as np

    return [np.bincount([min(len(w), 16) for w in t.split()], minlength=17) / len(t.split()) for t in texts]


def marks(texts):
    """Shares of the bytes by their upper half; raises for empty texts."""
    import numpy as np

    return [np.bincount(np.frombuffer(t.encode(), np.uint8) >> 4, minlength=16) / len(t.encode()) for t in texts]


@query()
def mod6_sweep(spark, sf):
    """18 combinations of three encoders, three heads and two tasks, and the 22 of the text variants, on one split."""
    from pyspark.ml.functions import array_to_vector

    rows = materialize(scored(spark, sf).select("page_id", "permit_num", "text", "category", "keep", "finish", "floordemo", "side"), "truth")
    own = {f.__name__: materialize(FE.embed(rows, f, f.__name__, content="text"), f.__name__) for f in (letters, lengths, marks)}
    dense = {n: e.select("page_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")) for n, e in own.items()}
    texts, heads_ = M.text_variants(rows, rows.where("side = 'train'"), own)
    options = {"keep_classes": ("floor_plan", "finish_plan", "finish_schedule", "demo_plan"), "workers": 8}
    return M.sweep(rows.drop("text"), dense | texts, {n: M.HEADS for n in dense} | heads_, **options)


@query()
def mod7_triage(spark, sf):
    """Every page with a route: a head fitted on train scores all, and only the uncertain band is checked again."""
    rows = head_rows(spark, sf)
    model = M.fit_head(rows.where("side = 'train'"), "logreg", "binary")
    return M.triage(model, rows, ()).select("page_id", "side", "route", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT page_id FROM scored WHERE score >= 0.3 AND score < 0.7")
def mod7_band(spark, sf):
    return M.band(scored(spark, sf), 0.3, 0.7).select("page_id")


@query(f"WITH {SCORED} SELECT {metrics_sql('score >= 0.5')} FROM scored WHERE side = 'eval'")
def evl1_micro_metrics(spark, sf):
    return flagship(spark, sf)


def _avg(pred: str) -> str:
    names_ = ("finish_recall", "floordemo_recall", "keep_recall", "fp_rate", "keep_precision", "frac_kept")
    return ", ".join(f"round(avg({n}), 5) {n}" for n in names_)


@query(f"WITH {SCORED}, p AS (SELECT permit_num, {metrics_sql('score >= 0.5').replace(', 6)', ', 12)')} FROM scored GROUP BY 1) SELECT {_avg('')} FROM p")
def evl2_packet_metrics(spark, sf):
    return rounded(E.packet_metrics(scored(spark, sf)), n=5)


@query(f"WITH {SCORED} SELECT round(min(score) FILTER (WHERE finish), 9) thr FROM scored")
def evl3_full_recall_threshold(spark, sf):
    return rounded(E.full_recall_threshold(scored(spark, sf)), n=9)


@query(f"WITH {SCORED}, t AS (SELECT min(score) FILTER (WHERE finish) thr FROM scored) SELECT round(thr, 6) thr, {metrics_sql('score >= thr')} FROM scored, t GROUP BY thr")
def evl4_full_recall_point(spark, sf):
    return rounded(E.full_recall_point(scored(spark, sf)))


@query(f"WITH {SCORED} SELECT t::DOUBLE thr, {metrics_sql('score >= t::DOUBLE')} FROM scored, {GRID_SQL} GROUP BY t")
def evl5_threshold_table(spark, sf):
    return rounded(E.threshold_table(scored(spark, sf)))


@query(f"WITH {SCORED} SELECT t::DOUBLE thr, {metrics_sql('score >= t::DOUBLE')} FROM scored, {GRID_SQL} GROUP BY t")
def jn12_score_grid(spark, sf):
    return rounded(E.threshold_table(scored(spark, sf)))


@query(f"WITH {SCORED}, tt AS (SELECT t::DOUBLE thr, {metrics_sql('score >= t::DOUBLE')} FROM scored, {GRID_SQL} GROUP BY t) SELECT * FROM tt WHERE finish_recall >= 0.8 ORDER BY fp_rate, thr DESC LIMIT 1")
def evl6_best_operating_point(spark, sf):
    return rounded(J.best_operating_point(E.threshold_table(scored(spark, sf)), 0.8))


@query(f"WITH {SCORED} SELECT permit_num, count(*) FILTER (WHERE finish) n_finish, count(*) FILTER (WHERE finish AND score >= 0.5) n_caught, round(n_caught / n_finish, 6) recall FROM scored GROUP BY 1 HAVING n_finish > 0")
def evl7_packet_table(spark, sf):
    return rounded(E.packet_table(scored(spark, sf)))


@query(f"WITH {SCORED}, p AS (SELECT permit_num, count(*) FILTER (WHERE finish) n, count(*) FILTER (WHERE finish AND score >= 0.5) c FROM scored GROUP BY 1) SELECT count(*) packets, count(*) FILTER (WHERE n > 0) finish_packets, count(*) FILTER (WHERE n > 0 AND n = c) full_packets FROM p")
def evl8_packet_summary(spark, sf):
    return E.packet_summary(scored(spark, sf))


@query(f"WITH {SCORED} SELECT page_id, category, permit_num FROM scored WHERE finish AND score < 0.5")
def evl9_misses(spark, sf):
    return E.misses(scored(spark, sf)).select("page_id", "category", "permit_num")


_ROUTED = f"{SCORED}, tuned AS (SELECT branch, min(score) FILTER (WHERE finish) t FROM scored WHERE side = 'train' AND branch <> 'neither' GROUP BY 1), routed AS (SELECT s.*, CASE WHEN s.branch = 'neither' THEN 2.0 ELSE score END >= CASE WHEN s.branch = 'neither' THEN 0.5 ELSE coalesce(t, 0.5) END pred FROM scored s LEFT JOIN tuned USING (branch) WHERE side = 'eval')"


@query(f"WITH {_ROUTED} SELECT page_id, branch, pred FROM routed WHERE branch <> 'neither'")
def evl10_router(spark, sf):
    rows = scored(spark, sf).where("branch <> 'neither'")
    return E.router(rows.where("side = 'train'"), rows.where("side = 'eval'")).select("page_id", "branch", "pred")


@query(f"WITH {_ROUTED} SELECT {metrics_sql('pred')} FROM routed")
def evl11_router_metrics(spark, sf):
    rows = scored(spark, sf)
    return rounded(E.routed_metrics(E.router(rows.where("side = 'train'"), rows.where("side = 'eval'"))))


_EXP = f"exp AS (SELECT '0.' || k config, {metrics_sql('score >= k / 10.0::DOUBLE')} FROM scored, range(1, 10) r(k) GROUP BY k)"


def experiments(spark, sf):
    table_ = E.threshold_table(scored(spark, sf), [k / 10 for k in range(1, 10)])
    return rounded(table_).select(F.concat(F.lit("0."), F.round(F.col("thr") * 10).cast("int").cast("string")).alias("config"), *E.METRICS)


@query(f"WITH {SCORED} SELECT 'demo' run, {metrics_sql('score >= 0.5')}, 'finish_recall=' || printf('%.3f', round(count(*) FILTER (WHERE score >= 0.5 AND finish)::DOUBLE / count(*) FILTER (WHERE finish), 6)) || '; fp_rate=' || printf('%.3f', round(count(*) FILTER (WHERE score >= 0.5 AND NOT keep)::DOUBLE / count(*) FILTER (WHERE NOT keep), 6)) notes FROM scored")
def evl12_experiment_row(spark, sf):
    path = scratch_path(spark, "experiments")
    io.log_experiment(E.experiment_row(rounded(E.micro_metrics(scored(spark, sf))), run="demo"), path)
    return spark.read.parquet(path)


@query(f"WITH {SCORED}, {_EXP} SELECT config, finish_recall, fp_rate, row_number() OVER (ORDER BY finish_recall DESC NULLS LAST, coalesce(fp_rate, 1), config)::INT rank FROM exp QUALIFY rank <= 5")
def srt2_leaderboard(spark, sf):
    return J.leaderboard(experiments(spark, sf), 5, tie="config").select("config", "finish_recall", "fp_rate", "rank")


@query(f"WITH {SCORED}, v AS (SELECT permit_num, {metrics_sql('score >= 0.3')} FROM scored GROUP BY 1) SELECT permit_num, finish_recall, floordemo_recall, coalesce(finish_recall, 1) = 1 AND coalesce(floordemo_recall, 1) >= 0.95 accepted FROM v")
def evl14_verdict(spark, sf):
    return rounded(E.verdict(scored(spark, sf), 0.3))


@query(f"WITH {SCORED} SELECT side, count(*) pages, count(*) FILTER (WHERE finish) finish_pages FROM scored WHERE page_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def evl15_excluded(spark, sf):
    return E.excluded(scored(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id")))


@query("WITH log AS (SELECT o_orderkey % 40 cycle, round(avg(o_totalprice), 3) m FROM orders GROUP BY 1), b AS (SELECT *, max(m) OVER (ORDER BY cycle ROWS UNBOUNDED PRECEDING) best FROM log) SELECT cycle, best, coalesce(best <= lag(best, 3) OVER (ORDER BY cycle), false) plateau FROM b")
def evl16_plateau(spark, sf):
    log = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 40).alias("cycle")).agg(F.round(F.avg("o_totalprice"), 3).alias("m"))
    return E.plateau(log, metric="m").select("cycle", "best", "plateau")


@query(f"WITH {SCORED}, {_EXP}, a AS (SELECT *, row_number() OVER (ORDER BY finish_recall DESC NULLS LAST, coalesce(fp_rate, 1), config) rank FROM exp WHERE config <> '0.2'), b AS (SELECT *, row_number() OVER (ORDER BY keep_recall DESC NULLS LAST, coalesce(fp_rate, 1), config) rank FROM exp WHERE config <> '0.3') SELECT coalesce(a.config, b.config) config, round(b.finish_recall - a.finish_recall, 6) d_finish_recall, (b.rank - a.rank)::INT d_rank FROM a FULL JOIN b ON a.config = b.config")
def evl17_compare(spark, sf):
    e = materialize(experiments(spark, sf), "experiments")
    a, b = J.leaderboard(e.where("config <> '0.2'"), 20, tie="config"), J.leaderboard(e.where("config <> '0.3'"), 20, recall="keep_recall", tie="config")
    return rounded(E.compare_leaderboards(a, b, ["config"]).select("config", "d_finish_recall", "d_rank"))


@query(f"WITH {SCORED}, c AS (SELECT score, sum(finish::INT) p, sum(1 - finish::INT) f FROM scored GROUP BY 1) SELECT round(score, 9) score, (sum(p) OVER w)::BIGINT tp, (sum(f) OVER w)::BIGINT fp, round(sum(p) OVER w / (sum(p) OVER w + sum(f) OVER w), 6) \"precision\", round(sum(p) OVER w / (SELECT sum(p) FROM c), 6) recall FROM c WINDOW w AS (ORDER BY score DESC)")
def win10_pr_curve(spark, sf):
    return rounded(rounded(W.pr_curve(scored(spark, sf)), "score", n=9), "precision", "recall")


@query(f"WITH {LABELS} SELECT id, page_id FROM labels_ WHERE id % 2 = 1 AND page_id NOT IN (SELECT page_id FROM labels_ WHERE id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY id) = 1")
def inc1_insert_or_ignore(spark, sf):
    log = labels(spark, sf)
    return I.insert_or_ignore(log.where("id % 2 = 0"), log.where("id % 2 = 1"), "page_id", "id").select("id", "page_id")


_OLD = "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'downloaded' ELSE 'rendered' END"
_NEW = "CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'rendered' WHEN 2 THEN 'error' ELSE 'pending' END END"
_LEGAL = "(old || '>' || new) IN ('pending>downloaded', 'pending>error', 'downloaded>rendered', 'downloaded>error')"


def statuses(spark, sf):
    o = table(spark, sf, "orders")
    old = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "downloaded").otherwise("rendered")
    new = F.element_at(F.array(*[F.lit(x) for x in ("downloaded", "rendered", "error", "pending")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), old.alias("status")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), new.alias("status"))


@query(f"SELECT id, CASE WHEN {_LEGAL} THEN new ELSE old END status FROM (SELECT o_orderkey id, {_OLD} old, {_NEW} AS new FROM orders)")
def inc2_transition(spark, sf):
    return I.transition(*statuses(spark, sf))[0]


@query(f"SELECT id, new status, old old_status FROM (SELECT o_orderkey id, {_OLD} old, {_NEW} AS new FROM orders) WHERE new IS NOT NULL AND NOT {_LEGAL}")
def inc2_rejected(spark, sf):
    return I.transition(*statuses(spark, sf))[1]


@query(f"WITH {LABELS} SELECT page_id, id, source FROM labels_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {PRIORITY_SQL} DESC, created_at DESC, id DESC) = 1")
def inc3_append_labels(spark, sf):
    log = labels(spark, sf)
    return I.append_labels(log.where("id % 2 = 0"), log.where("id % 2 = 1")).select("page_id", "id", "source")


@query("SELECT name, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 3 = 0) + row_number() OVER (ORDER BY name) id FROM (SELECT c_name AS name FROM customer WHERE c_custkey % 3 <> 0)")
def inc4_delta_copy(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return I.delta_copy(c, c.where("id % 3 = 0"), "name")


@query("SELECT lang status, count(*) pages, count(l.doc_id) labeled, count(*) - count(l.doc_id) remaining FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)")
def inc5_progress(spark, sf):
    d = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "page_id", "lang": "status"})
    return I.progress(d, table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id"))


@query("WITH w AS (SELECT *, ('0x' || substr(sha256(l_orderkey::VARCHAR), 1, 8))::BIGINT p FROM lineitem), r AS (SELECT *, p % 4 worker, row_number() OVER (PARTITION BY p % 4 ORDER BY p, l_orderkey, l_linenumber, l_partkey, l_suppkey) rn FROM w) SELECT l_orderkey, l_linenumber, l_partkey, worker::INT worker, ((rn + 79) // 80)::BIGINT batch FROM r")
def inc6_cut_batches(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return I.cut_batches(li, 4, 80, "l_orderkey", "line").select("l_orderkey", "l_linenumber", "l_partkey", "worker", "batch")


@query("SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING n > 1")
def inc7_check_unique(spark, sf):
    return I.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'quality' AS \"column\", count(*) FILTER (WHERE quality IS NULL) nulls FROM documents LEFT JOIN labels USING (doc_id)")
def inc7_check_not_null(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return I.check_not_null(d, ["doc_id", "quality"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def inc8_check_fk(spark, sf):
    return I.check_fk(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey").select("c_custkey")


_JSON = "CASE event_id % 6 WHEN 0 THEN '{' WHEN 1 THEN '{\"category\":\"mep\"}' WHEN 2 THEN '{\"category\":\"mep\",\"confidence\":1.5}' WHEN 3 THEN '{\"category\":\"zzz\",\"confidence\":0.5}' WHEN 4 THEN '{\"category\":\"mep\",\"confidence\":0.5,\"x\":1}' ELSE '{\"category\":\"mep\",\"confidence\":0.5}' END"
_REASON = "CASE event_id % 6 WHEN 0 THEN 'not_json' WHEN 1 THEN 'missing_key' WHEN 2 THEN 'bad_confidence' WHEN 3 THEN 'bad_category' WHEN 4 THEN 'extra_key' END"


def json_labels(spark, sf):
    cases = ['{', '{"category":"mep"}', '{"category":"mep","confidence":1.5}', '{"category":"zzz","confidence":0.5}', '{"category":"mep","confidence":0.5,"x":1}', '{"category":"mep","confidence":0.5}']
    return table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c in cases]), (F.col("event_id") % 6 + 1).cast("int")).alias("value"))


@query(f"SELECT event_id, {_REASON} reason FROM events WHERE event_id % 6 < 5")
def inc9_quarantine(spark, sf):
    return I.validate_labels(json_labels(spark, sf), CATEGORIES)[1].select("event_id", "reason")


@query("SELECT event_id, 'mep' category, 0.5::DOUBLE confidence FROM events WHERE event_id % 6 = 5")
def inc9_valid(spark, sf):
    return I.validate_labels(json_labels(spark, sf), CATEGORIES)[0].select("event_id", "category", "confidence")


def event_stream(spark, sf, parts: int = 4):
    """The events as a stream of files, read one at a time."""
    path = scratch_path(spark, "stream")
    e = labels(spark, sf)
    e.repartition(parts, "id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _memory(spark, start):
    import uuid

    name = "stream_" + uuid.uuid4().hex
    q = start(name, scratch_path(spark, "checkpoint"))
    q.awaitTermination()
    return spark.table(name)


@query("SELECT user_id page_id, count(*) > 0 seen FROM events GROUP BY 1")
def str1_stream_ingest(spark, sf):
    sink = scratch_path(spark, "sink")
    e = event_stream(spark, sf)
    ST.stream_ingest(e, sink, "page_id", scratch_path(spark, "checkpoint"), seq="id").awaitTermination()
    return keyed.read(spark, sink, e.schema).groupBy("page_id").agg((F.count("*") == 1).alias("seen"))


@query(f"WITH {LABELS} SELECT page_id, id, source FROM labels_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {PRIORITY_SQL} DESC, created_at DESC, id DESC) = 1")
def str2_stream_truth(spark, sf):
    sink, e = scratch_path(spark, "truth"), event_stream(spark, sf)
    ST.stream_truth(e, sink, scratch_path(spark, "checkpoint")).awaitTermination()
    return keyed.read(spark, sink, e.schema).select("page_id", "id", "source")


@query(f"WITH {LABELS} SELECT source, count(*) n FROM labels_ GROUP BY 1")
def str3_stream_counts(spark, sf):
    return _memory(spark, lambda n, c: ST.stream_counts(event_stream(spark, sf), "source", n, c))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def src2_last_log_row(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select("user_id", "event_id")
    return W.first_per_key(e, ["user_id"], "event_id", last=True)


@query("SELECT user_id::VARCHAR doc_id, 'ok' status, event_id bytes, 'a, \"' || event_type || '\".pdf' AS name FROM events WHERE event_type <> 'error' AND event_id % 10 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def src2_download_log(spark, sf):
    """Events written as a log without header, with failed rows, and with rows that broke off after three cells."""
    path = scratch_path(spark, "log")
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    name = F.concat(F.lit('"a, ""'), "event_type", F.lit('"".pdf"'))
    cells = F.concat_ws(",", F.col("user_id").cast("string"), status, F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 > 0, name))
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select(cells).write.text(path)
    return io.read_download_log(spark, path)


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 1")
def src4_append_new(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    path = scratch_path(spark, "jsonl")
    io.append_new(e.where("event_id % 2 = 0"), path, ["event_id"])
    return io.append_new(e, path, ["event_id"])


@query("SELECT o_orderkey::VARCHAR AS \"permitNum\", o_orderstatus AS \"permitType\", 'a, \"b\"' || o_orderpriority description FROM orders")
def src1_read_permits(spark, sf):
    path = scratch_path(spark, "csv")
    p = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("permitNum"), F.col("o_orderstatus").alias("permitType"), F.concat(F.lit('a, "b"'), "o_orderpriority").alias("description"))
    p.write.option("header", True).option("escape", '"').csv(path)
    return io.read_permits(spark, path, "permitNum string, permitType string, description string")


@query("SELECT event_id, event_type FROM events")
def src3_read_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "events").select("event_id", "event_type").write.json(path)
    return io.read_jsonl(spark, path, "event_id long, event_type string")
