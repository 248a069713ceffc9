"""Scalars, predicates, sources, joins, sets and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P, scalars as S
from ..operators import extract as X, joins as J, windows as W
from ..plans.storage import scratch_path, spread
from ..sources import io
from .registry import LABELS, PERMITS, PRIORITY_SQL, STRATA_SQL, TRUTH, hash_sql, labels, permits, query, rounded, strata, table, truth


@query("""SELECT o_orderkey, round(o_totalprice, 2) money, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey::DOUBLE END odd FROM orders""")
def scl1_parse_money(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" "))
    odd = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("d"))).otherwise(F.col("o_orderkey").cast("string"))
    return rounded(o.select("o_orderkey", S.parse_money(text).alias("money"), S.parse_money(odd).alias("odd")), n=2)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS yr FROM orders")
def scl2_issue_year(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.issue_year(F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("yr"))


@query("SELECT page_id, CASE WHEN starts_with(trim(url), 'http://') THEN 'https://' || substr(trim(url), 8) ELSE trim(url) END url FROM pages")
def scl3_upgrade_https(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.upgrade_https("url").alias("url"))


_UNESC = "regexp_replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


@query(f"SELECT page_id, sha256({_UNESC}) h FROM pages")
def scl4_html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(S.html_unescape("html"), 256).alias("h"))


@query("SELECT c_custkey, chr((160 + c_custkey % 50000)::INT) || 'é’&lt;A&zzz;' || CASE WHEN c_custkey % 2 = 0 THEN chr((65536 + c_custkey % 9000)::INT) ELSE '©x' END t FROM customer")
def scl4_references(spark, sf):
    """Numeric references in both bases, by name, twice escaped, unknown, and an old name without semicolon."""
    k = F.col("c_custkey")
    last = F.when(k % 2 == 0, F.concat(F.lit("&#x"), F.hex(65536 + k % 9000), F.lit(";"))).otherwise("&copyx")
    text = F.concat(F.lit("&#"), (160 + k % 50000).cast("string"), F.lit(";&eacute;&rsquo;&amp;lt;&#65;&zzz;"), last)
    return spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", S.html_unescape(text).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount, 6) fp_rate, round(l_tax, 6) recall, l_returnflag note, 'x' || l_partkey::VARCHAR tag FROM lineitem")
def json1_metrics(spark, sf):
    """Metrics written as JSON and read back: known ones as doubles, others as they are."""
    li = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    other = F.create_map(F.lit("note"), F.col("l_returnflag").cast("variant"), F.lit("tag"), F.concat(F.lit("x"), F.col("l_partkey").cast("string")).cast("variant"))
    written = li.select(*keys, S.metrics_json({"fp_rate": "l_discount", "recall": "l_tax"}, other).alias("j"))
    read = written.select(*keys, S.parse_metrics("j", ("fp_rate", "recall")).alias("m"))
    extra = lambda n: F.element_at("m.other", n).cast("string").alias(n)
    return read.select(*keys, F.round("m.fp_rate", 6).alias("fp_rate"), F.round("m.recall", 6).alias("recall"), extra("note"), extra("tag"))


@query("SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(replace('> ' || p_name || ' &amp;  ' || p_brand || '.pdf', '&amp;', '&'), '\\s+', ' ', 'g')), '^[> ]+', '')) f FROM part")
def scl5_clean_filename(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.clean_filename(F.concat(F.lit("> "), "p_name", F.lit(" &amp;  "), "p_brand", F.lit(".pdf"))).alias("f"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' floor layout.pdf' WHEN 1 THEN p_name || ' site plan.pdf' WHEN 2 THEN 'A-' || p_size::VARCHAR || ' ' || p_name || '.dwg' WHEN 3 THEN p_name || ' mep plans.pdf' ELSE p_name || '.msg' END"


def names(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.concat("p_name", F.lit(" floor layout.pdf")))
        .when(k == 1, F.concat("p_name", F.lit(" site plan.pdf")))
        .when(k == 2, F.concat(F.lit("A-"), F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(".dwg")))
        .when(k == 3, F.concat("p_name", F.lit(" mep plans.pdf")))
        .otherwise(F.concat("p_name", F.lit(".msg")))
    )
    return p.withColumn("name", name)


_WORDS = " OR ".join(f"contains(lower(name), '{w}')" for w in S.PLAN_WORDS)
_OTHER = " OR ".join(f"contains(lower(name), '{w}')" for w in S.PLAN_WORDS if w != "plan")
_SHEET = "regexp_matches(name, '\\bA[-.]?[0-9]', 'i')"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(name, '\\bsite[-\\s]+plans?\\b', 'i') AND NOT {_SHEET} AND NOT ({_OTHER}) THEN 'site_only' WHEN {_SHEET} OR {_WORDS} THEN 'plan' ELSE 'neither' END kind FROM (SELECT *, {_NAME} AS name FROM part)")
def scl6_plan_likeness(spark, sf):
    return names(spark, sf).select("p_partkey", S.plan_likeness("name").alias("kind"))


@query(f"SELECT page_id, nullif(regexp_extract({_UNESC}, 'track\\((\\d+)\\)', 1), '') id FROM pages")
def scl7_extract_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.extract_id("html", r"track\((\d+)\)").alias("id"))


@query("SELECT doc_id, 'x/data/pagetext/' || doc_id::VARCHAR || '/page_0001.txt' p FROM documents")
def scl8_text_path(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.text_path(F.format_string("x/data/pages/%s/page_0001.png", F.col("doc_id").cast("string"))).alias("p"))


@query("SELECT p_partkey, replace(replace(p_name || ';' || p_brand || '|' || p_type, ';', ','), '|', '/') e FROM part")
def scl9_escape_pair(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.escape_pair(F.concat("p_name", F.lit(";"), "p_brand", F.lit("|"), "p_type")).alias("e"))


@query("SELECT p_type, CASE WHEN count(*) FILTER (WHERE p_size > 200) = 0 THEN '' ELSE 'x' END none, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE p_size > 25) / count(*)) pct FROM part GROUP BY p_type")
def scl10_pct(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type").agg(F.count_if(F.col("p_size") > 200).alias("z"), F.count_if(F.col("p_size") > 25).alias("a"), F.count("*").alias("n"))
    return g.select("p_type", S.pct("a", "z").alias("none"), S.pct("a", "n").alias("pct"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN event_id ELSE 0 END::BIGINT n FROM events")
def scl11_int_or_zero(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5x")))
    return e.select("event_id", S.int_or_zero(text).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '/page_' || lpad((l_linenumber + 1)::VARCHAR, 4, '0') k FROM lineitem")
def scl12_page_key(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.page_key(F.col("l_orderkey").cast("string"), "l_linenumber", 1).alias("k"))


@query(f"SELECT c_custkey, round({hash_sql('c_custkey')}, 9) f FROM customer")
def scl13_hash_frac(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(S.hash_frac("c_custkey"), 9).alias("f"))


_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN length({_STRIP}) > 50 THEN sha256(substr({_STRIP}, 1, 20000)) END h, substr({_STRIP}, 1, 300) preview FROM documents")
def scl14_text_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.text_gate("text"), 256).alias("h"), F.substring(S.strip("text"), 1, 300).alias("preview"))


@query("SELECT doc_id, substr(text, 1, 500) note FROM documents")
def scl16_clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.clip("text").alias("note"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'NA' ELSE printf('%.3f', (event_id % 1000) / 8.0) END m FROM events")
def scl17_fmt3(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.fmt3(F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 1000) / 8.0)).alias("m"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 5) s, round(embedding[1]::DOUBLE / n, 5) first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) n FROM embeddings)")
def scl18_l2_normalize(spark, sf):
    unit = table(spark, sf, "embeddings").withColumn("u", S.l2_normalize("embedding"))
    return rounded(unit.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("s"), F.element_at("u", 1).alias("first")), n=5)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def scl19_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(b, "vec_id").select("vec_id", S.cosine("embedding", "other").alias("c")), n=5)


@query(f"SELECT p_partkey, ends_with(lower({_NAME}), '.pdf') pdf FROM part")
def scl20_has_ext(spark, sf):
    return names(spark, sf).select("p_partkey", S.has_ext("name").alias("pdf"))


@query("SELECT p_partkey, p_partkey::VARCHAR || '_' || CASE WHEN p_partkey % 6 = 0 THEN p_partkey::VARCHAR || '.pdf' ELSE regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9._-]+', '_', 'g') END s FROM part")
def scl22_storage_name(spark, sf):
    p = table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 6 == 0, " ").otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return p.select("p_partkey", S.storage_name("p_partkey", name).alias("s"))


@query(f"WITH {PERMITS} SELECT \"permitNum\", list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in STRATA_SQL)}], lambda x: x IS NOT NULL)::VARCHAR[] strata FROM permits")
def flt1_strata(spark, sf):
    return P.stratum_flags(permits(spark, sf), strata()).select("permitNum", "strata")


@query("SELECT o_orderkey, o_totalprice >= 100000 AND o_totalprice < 250000 inside FROM orders")
def flt2_cost_between(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.cost_between("o_totalprice", 100_000, 250_000).alias("inside"))


@query(f"WITH {PERMITS} SELECT count(*) FILTER (WHERE yr >= 1998) since, count(*) FILTER (WHERE yr < 1998) before, count(*) FILTER (WHERE yr IS NULL) empty FROM permits")
def flt3_era(spark, sf):
    d = "issueDate"
    return permits(spark, sf).agg(F.count_if(P.issue_from(d, 1998)).alias("since"), F.count_if(P.issue_before(d, 1998)).alias("before"), F.count_if(P.issue_empty(d)).alias("empty"))


_INC = P.INCLUDE.removeprefix("(?i)")
_EXC = P.EXCLUDE.removeprefix("(?i)")


@query(f"SELECT p_partkey, name FROM (SELECT *, {_NAME} AS name FROM part) WHERE regexp_matches(name, '{_INC}', 'i') AND NOT regexp_matches(name, '{_EXC}', 'i')")
def flt4_screen_names(spark, sf):
    return P.screen_names(names(spark, sf)).select("p_partkey", "name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'F')")
def flt5_in_list(spark, sf):
    return P.subset(table(spark, sf, "orders"), ["P", "F"], "o_orderstatus").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size * 100000 BETWEEN 500000 AND 3000000")
def flt6_size_range(spark, sf):
    return table(spark, sf, "part").where((F.col("p_size") * 100_000).between(500_000, 3_000_000)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1")
def flt7_claim(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.claim(table(spark, sf, "orders"), "P", done, "o_orderkey", "o_orderkey", "o_orderstatus").select("o_orderkey")


@query(f"WITH {TRUTH} SELECT page_id, keep, finish, floordemo FROM truth")
def flt8_flags(spark, sf):
    return truth(spark, sf).select("page_id", "keep", "finish", "floordemo")


@query(f"WITH {LABELS} SELECT id, reason FROM (SELECT *, CASE WHEN coalesce(confidence < 0.1, true) THEN 'low_confidence' WHEN coalesce(flag_reason, '') <> '' THEN 'flagged' WHEN {hash_sql('id')} < 0.1 THEN 'audit' END reason FROM labels_) WHERE reason IS NOT NULL")
def flt9_review_queue(spark, sf):
    return P.review_queue(labels(spark, sf), thr=0.1, id_="id").select("id", "reason")


@query(f"SELECT p_partkey, nullif(lower(regexp_extract({_NAME}, '{P.SKIP.removeprefix('(?i)')}', 1, 'i')), '') reason FROM part")
def flt10_skip_reason(spark, sf):
    return names(spark, sf).select("p_partkey", P.skip_reason("name").alias("reason"))


@query("SELECT count(*) FILTER (WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0) n FROM documents")
def flt11_has_text(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(P.has_text("text")).alias("n"))


_PROBE = """probe AS (SELECT user_id k, event_id seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_found' ELSE 'ok' END status, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE '' END ids, CASE WHEN event_id % 4 = 0 THEN 'a|b' ELSE '' END pairs FROM events)"""


def probe(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "not_found").otherwise("ok")
    return e.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("").alias("ids"), F.when(F.col("event_id") % 4 == 0, "a|b").otherwise("").alias("pairs"))


_SETTLED = f"WITH {_PROBE} SELECT k, seq, status FROM probe WHERE status IN ('ok', 'not_found') AND NOT (status = 'ok' AND ids <> '' AND pairs = '') QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1"


@query(_SETTLED)
def flt12_settled(spark, sf):
    return P.settled(probe(spark, sf), "k", "seq").select("k", "seq", "status")


@query(_SETTLED)
def src11_compact_results(spark, sf):
    return io.compact_results(probe(spark, sf), scratch_path(spark, "results"), "k", "seq").select("k", "seq", "status")


@query("SELECT source, count(*) FILTER (WHERE regexp_matches(text, 'licen[cs]e|token', 'i')) hits, count(*) pages FROM documents GROUP BY source HAVING hits > 0")
def flt13_target_by_vocab(spark, sf):
    return P.target_by_vocab(table(spark, sf, "documents"), r"(?i)licen[cs]e|token", group="source")


@query(f"WITH {TRUTH} SELECT page_id, {hash_sql('page_id')} >= 0.5 pred FROM truth")
def flt14_predict(spark, sf):
    return P.predict(truth(spark, sf).withColumn("score", S.hash_frac("page_id")), 0.5).select("page_id", "pred")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3")
def flt15_cap_pages(spark, sf):
    return P.cap_pages(table(spark, sf, "lineitem"), 3, "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE value / 500 >= 0.2")
def flt17_training_grade(spark, sf):
    return P.training_grade(labels(spark, sf), 0.2).select(F.col("id").alias("event_id"))


@query("SELECT page_id, regexp_matches(html, 'captcha|verify|access denied|the that', 'i') blocked FROM pages")
def flt18_block_page(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.is_block_page("html", r"(?i)captcha|verify|access denied|the that").alias("blocked"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 2, 3, 5, 8, 13) ORDER BY doc_id LIMIT 4")
def flt19_subset(spark, sf):
    return J.take(P.subset(table(spark, sf, "documents"), [1, 2, 3, 5, 8, 13], "doc_id"), 4, "doc_id").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def jn1_label_context(spark, sf):
    li, o, c = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    return J.label_context(li.withColumnRenamed("l_orderkey", "o_orderkey"), o.withColumnRenamed("o_custkey", "c_custkey"), c, "o_orderkey", "c_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("c_custkey").alias("o_custkey"), "c_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn2_using(spark, sf):
    return table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey").join(table(spark, sf, "nation"), "n_nationkey").select("s_suppkey", "n_name")


@query(f"WITH {TRUTH}, e AS (SELECT vec_id page_id, 1 seq, label FROM embeddings UNION ALL SELECT vec_id, vec_id % 3 * 2, -label FROM embeddings), last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) = 1) SELECT t.page_id, last.seq::BIGINT seq, last.label FROM truth t JOIN last USING (page_id)")
def jn3_join_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    emb = e.select(F.col("vec_id").alias("page_id"), F.lit(1).cast("long").alias("seq"), "label").union(e.select("vec_id", F.col("vec_id") % 3 * 2, -F.col("label")))
    return J.join_embeddings(truth(spark, sf), emb, seq="seq").select("page_id", "seq", "label")


@query("SELECT doc_id, label FROM labels JOIN embeddings ON vec_id = doc_id")
def jn4_align(spark, sf):
    emb = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return J.align(emb, J.restrict(table(spark, sf, "labels"), emb, "doc_id"), "doc_id").select("doc_id", "label")


@query("SELECT d.doc_id, coalesce(l.quality, -1) quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn5_left_default(spark, sf):
    return J.left_default(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "quality", -1).select("doc_id", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn6_todo(spark, sf):
    return J.todo(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jn7_restrict(spark, sf):
    return J.restrict(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id")


_VIEW = f"WITH {LABELS} SELECT page_id, id, source, category FROM labels_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (source = 'human') DESC, confidence DESC NULLS LAST, id DESC) = 1"


@query(_VIEW)
def jn8_view_truth_join(spark, sf):
    return W.view_truth_join(labels(spark, sf)).select("page_id", "id", "source", "category")


@query("SELECT l_orderkey, l_linenumber, p_name, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def jn10_log_lookup(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    return table(spark, sf, "lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_size")


@query(f"WITH {TRUTH} SELECT page_id, category FROM truth WHERE page_id IN (SELECT vec_id FROM embeddings WHERE label < 3 UNION SELECT vec_id FROM embeddings WHERE label > 7)")
def jn13_usable(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "page_id")
    return J.usable(truth(spark, sf), e.where("label < 3"), e.where("label > 7")).select("page_id", "category")


@query("SELECT DISTINCT concat_ws('-', source, lang) g, count(*) n FROM documents WHERE concat_ws('-', source, lang) NOT IN (SELECT concat_ws('-', source, lang) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY 1")
def set1_new_groups(spark, sf):
    from ..operators.splits import new_groups

    d = table(spark, sf, "documents").withColumn("g", F.concat_ws("-", "source", "lang"))
    toxic = table(spark, sf, "labels").where("toxic = 1")
    return new_groups(d, d.join(toxic, "doc_id", "left_semi").select("g").distinct(), "g").select("g", F.col("pages").alias("n"))


@query("SELECT event_type, count(*) n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def set2_unknown_values(spark, sf):
    return J.unknown_values(table(spark, sf, "events"), "event_type", ["view", "click"])


@query("SELECT vec_id FROM embeddings WHERE label = 1 UNION SELECT doc_id FROM labels")
def set3_union_ids(spark, sf):
    return J.union_ids(table(spark, sf, "embeddings").where("label = 1").select("vec_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), key="vec_id")


@query("SELECT vec_id FROM embeddings INTERSECT SELECT doc_id FROM labels")
def set4_common_ids(spark, sf):
    return J.common_ids(table(spark, sf, "embeddings"), table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id"), "vec_id")


@query("SELECT count(*) n FROM labels")
def set5_disjoint(spark, sf):
    all_ = table(spark, sf, "labels")
    a, b = all_.where("doc_id % 2 = 0"), all_.where("doc_id % 2 = 1")
    J.assert_disjoint(a, b, "doc_id")
    return a.union(b).agg(F.count("*").alias("n"))


@query(f"WITH {TRUTH} SELECT CASE WHEN n_chars > 1500 THEN 'text' WHEN page_id IN (SELECT vec_id FROM embeddings) THEN 'image' ELSE 'neither' END branch, count(*) n FROM truth GROUP BY 1")
def set6_populations(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(True).alias("has"))
    rows = truth(spark, sf).join(e, "page_id", "left").withColumn("branch", J.populations(F.col("n_chars") > 1500, F.coalesce("has", F.lit(False))))
    return rows.groupBy("branch").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE value < 5 UNION SELECT event_id FROM events WHERE event_id % 37 = 0")
def set7_review_union(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return J.review_union(e.where("value < 5").select("event_id"), e.where("event_id % 37 = 0").select("event_id"))


@query("SELECT event_type k, count(*) n, NULL::DOUBLE v FROM events GROUP BY 1 UNION ALL SELECT 'baseline', NULL, round(avg(value), 6) FROM events")
def set8_append_results(spark, sf):
    e = table(spark, sf, "events")
    return J.append_results(e.groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n")), e.agg(F.lit("baseline").alias("k"), F.round(F.avg("value"), 6).alias("v")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def srt1_ordered(spark, sf):
    return J.ordered(table(spark, sf, "orders"), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT rn, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber)::INT rn FROM lineitem) ORDER BY rn, l_returnflag LIMIT 50")
def srt3_interleave(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return W.interleave(li, "l_returnflag", "l_extendedprice", "id", 50).select("rn", "l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def srt6_take(spark, sf):
    return J.take(J.todo(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id"), 20, "doc_id").select("doc_id")


@query("WITH c AS (SELECT source, count(*) n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT doc_id, coalesce(c.n, 0) n_labels FROM documents LEFT JOIN c USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def srt7_diversity_queue(spark, sf):
    return J.diversity_queue(table(spark, sf, "documents"), table(spark, sf, "labels"), "source", "doc_id", "doc_id").select("doc_id", "n_labels")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def src5_read_table(spark, sf):
    return io.read_table(spark, {"format": "parquet", "path": f"{sf}/events.parquet"}, "SELECT event_id, user_id FROM source WHERE event_type = 'click'")


@query("SELECT count(*) src, count(*) dst FROM orders")
def src6_copy_table(spark, sf):
    path = scratch_path(spark, "copy")
    a, b = io.copy_table(table(spark, sf, "orders"), lambda df: df.write.parquet(path), lambda: spark.read.parquet(path), ["o_orderkey", "o_totalprice"])
    return spark.read.parquet(path).agg(F.count("*").alias("src"), F.lit(b).cast("long").alias("dst"))


@query("SELECT page_id, coalesce(length(text), 0) n FROM pages LEFT JOIN documents ON doc_id = page_id AND doc_id % 3 = 0")
def src7_load_page_text(spark, sf):
    texts = table(spark, sf, "documents").where("doc_id % 3 = 0").withColumnRenamed("doc_id", "page_id")
    return io.load_page_text(table(spark, sf, "pages"), texts).select("page_id", F.length("text").cast("long").alias("n"))


@query("SELECT vec_id, 'demo' backbone, len(embedding)::INT n FROM embeddings")
def src8_read_embeddings(spark, sf):
    return io.read_embeddings(spark, f"{sf}/embeddings.parquet", "demo", key="vec_id").select("vec_id", "backbone", F.size("embedding").alias("n"))


@query(f"SELECT source permit_num, CASE WHEN {hash_sql('source')} < 0.2 THEN 'eval' ELSE 'train' END side FROM (SELECT DISTINCT source FROM documents)")
def src9_split_round_trip(spark, sf):
    from ..operators.splits import hash_split

    split = hash_split(table(spark, sf, "documents").groupBy(F.col("source").alias("permit_num")).agg(F.count("*").alias("pages")), "permit_num")
    split = split.withColumns({"finish_pages": F.lit(0), "whale": F.lit(False), "moved": F.lit(False)})
    path = scratch_path(spark, "split")
    io.write_split(split, path)
    return io.read_split(spark, path)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id")
def src14_export_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    io.export_manifest(table(spark, sf, "documents"), path, "doc_id", "source")
    return spark.read.schema("doc_id long, source string").option("header", True).csv(path)


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'empty' WHEN doc_id % 2 = 1 THEN 'block_page' WHEN doc_id % 3 = 0 THEN 'not_pdf' WHEN strlen(text) + 9 < 1024 THEN 'too_small' WHEN strlen(text) + 9 > 20000 THEN 'too_large' END reason FROM documents")
def src13_triage_binary(spark, sf):
    d = table(spark, sf, "documents")
    content = F.concat(F.when(F.col("doc_id") % 2 == 1, F.lit("<html>")).when(F.col("doc_id") % 3 == 0, "plain ").otherwise(F.lit("%PDF-1.7 ")), "text").cast("binary")
    return io.triage_binary(d.select("doc_id", content.alias("content")), least=1024, most=20_000).select("doc_id", "reason")


_ANCHORS = "len(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1))"


@query(f"SELECT page_id, {_ANCHORS} n FROM pages WHERE {_ANCHORS} > 0")
def ext1_extract_links(spark, sf):
    found = X.extract_links(table(spark, sf, "pages"), anchor_re=r'<a href="/([^"]*)"', name_re=r">([^<>]{1,300})<", window=300, unescape=False)
    return found.groupBy("page_id").agg(F.count("*").alias("n"))


_EXPL = "SELECT doc_id, (i - 1)::INT page_index, length(regexp_replace(p, '^\\s+|\\s+$', '', 'g'))::INT n_chars, CASE WHEN i - 1 >= 20 THEN 'out_of_range' WHEN length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) > 50 THEN 'written' ELSE 'short' END status FROM (SELECT doc_id, unnest(string_split(text, chr(10))) p, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents)"


@query(_EXPL)
def ext2_explode_pages(spark, sf):
    return X.explode_pages(table(spark, sf, "documents"), "doc_id", splitter="\n", cap=20).select("doc_id", "page_index", "n_chars", "status")


@query(f"SELECT status, count(*) pages, sum(n_chars)::BIGINT chars FROM ({_EXPL}) GROUP BY status")
def ext3_extraction_report(spark, sf):
    return X.extraction_report(X.explode_pages(table(spark, sf, "documents"), "doc_id", splitter="\n", cap=20))


@query(f"WITH {LABELS} SELECT page_id, id, source, category FROM labels_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {PRIORITY_SQL} DESC, created_at DESC, id DESC) = 1")
def win1_current_truth(spark, sf):
    return W.current_truth(labels(spark, sf)).select("page_id", "id", "source", "category")


@query(f"WITH {LABELS} SELECT page_id, id, source, category FROM labels_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {PRIORITY_SQL} DESC, created_at DESC, id DESC) = 1")
def agg10_current_truth_maxby(spark, sf):
    return W.current_truth_maxby(labels(spark, sf)).select("page_id", "id", "source", "category")


@query(_VIEW)
def win2_view_truth(spark, sf):
    return W.view_truth(labels(spark, sf)).select("page_id", "id", "source", "category")


@query("SELECT user_id, min(event_id) f, max(event_id) l FROM events GROUP BY 1")
def win3_first_per_key(spark, sf):
    e = table(spark, sf, "events")
    last = W.first_per_key(e, ["user_id"], "event_id", last=True).select("user_id", F.col("event_id").alias("l"))
    return W.first_per_key(e, ["user_id"], "event_id").select("user_id", F.col("event_id").alias("f")).join(last, "user_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def win4_largest_per_group(spark, sf):
    return W.largest_per_group(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey)::INT rn FROM part")
def win5_rank_in_group(spark, sf):
    return J.rank_in_group(table(spark, sf, "part"), "p_type", "p_size", "p_partkey").select("p_partkey", "rn")


