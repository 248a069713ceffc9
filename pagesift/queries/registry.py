"""The list of registered queries, and the driver tables seen as permits, labels, pages and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.predicates import with_flags
from ..functions.scalars import hash_frac
from ..sources.schemas import CATEGORIES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: event_type -> label source; other types have no priority.
SOURCES = {"purchase": "human", "signup": "adjudicate", "click": "review", "view": "labeler"}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{{", "{").replace("}}", "}") if "{{" in sql else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark, sf) -> DataFrame:
    """Events as an append-only label log."""
    e = table(spark, sf, "events")
    source = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("event_type")], F.lit("other"))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("event_id") % 16 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("page_id"), source.alias("source"), category.alias("category"), (F.col("value") / 500).alias("confidence"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 37 == 0, "unclear").alias("flag_reason"))


def _list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


LABELS = f"""labels_ AS (SELECT event_id id, user_id page_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items())} ELSE 'other' END AS source,
 ([{_list(CATEGORIES)}])[event_id % 16 + 1] category, value / 500 confidence, ts created_at, CASE WHEN event_id % 37 = 0 THEN 'unclear' END flag_reason FROM events)"""
PRIORITY_SQL = "CASE source WHEN 'human' THEN 4 WHEN 'adjudicate' THEN 3 WHEN 'review' THEN 2 WHEN 'labeler' THEN 1 ELSE 0 END"


def hash_sql(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || ({key})::VARCHAR), 1, 8))::BIGINT / 4294967295::DOUBLE)"


def truth(spark, sf) -> DataFrame:
    """Labelled documents as pages with a category: (quality, toxic) and the id decide it."""
    four = F.col("doc_id") % 4 == 0
    category = (
        F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "finish_plan").otherwise("finish_schedule"))
        .when(F.col("quality") == 1, F.when(four, "floor_plan").otherwise("other"))
        .otherwise(F.when(four, "demo_plan").otherwise("other"))
    )
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return with_flags(joined.select(F.col("doc_id").alias("page_id"), F.concat_ws("-", "source", "lang").alias("permit_num"), "text", "n_chars", category.alias("category")))


TRUTH = """truth AS (SELECT *, category IN ('floor_plan','finish_plan','finish_schedule','demo_plan') keep, category IN ('finish_plan','finish_schedule') finish, category IN ('floor_plan','demo_plan') floordemo FROM (
 SELECT d.doc_id page_id, concat_ws('-', source, lang) permit_num, text, n_chars, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'finish_plan' ELSE 'finish_schedule' END
 WHEN quality = 1 THEN CASE WHEN d.doc_id % 4 = 0 THEN 'floor_plan' ELSE 'other' END ELSE CASE WHEN d.doc_id % 4 = 0 THEN 'demo_plan' ELSE 'other' END END category FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""


def scored(spark, sf) -> DataFrame:
    """Truth with a deterministic score, a side by group hash, and a router branch."""
    from ..operators.splits import hash_split

    rows = truth(spark, sf).withColumn("score", hash_frac("page_id"))
    branch = F.when(F.col("n_chars") > 1500, "text").when(F.col("page_id") % 3 > 0, "image").otherwise("neither")
    return hash_split(rows, "permit_num", eval_frac=0.5).withColumn("branch", branch)


SCORED = f"""{TRUTH}, scored AS (SELECT *, {hash_sql('page_id')} score, CASE WHEN {hash_sql('permit_num')} < 0.5 THEN 'eval' ELSE 'train' END side,
 CASE WHEN n_chars > 1500 THEN 'text' WHEN page_id % 3 > 0 THEN 'image' ELSE 'neither' END branch FROM truth)"""


def metrics_sql(pred: str) -> str:
    ratio = lambda a, b, n: f"round(count(*) FILTER (WHERE {a})::DOUBLE / nullif(count(*) FILTER (WHERE {b}), 0), 6) {n}"
    return ", ".join([
        ratio(f"({pred}) AND finish", "finish", "finish_recall"), ratio(f"({pred}) AND floordemo", "floordemo", "floordemo_recall"), ratio(f"({pred}) AND keep", "keep", "keep_recall"),
        ratio(f"({pred}) AND NOT keep", "NOT keep", "fp_rate"), ratio(f"({pred}) AND keep", pred, "keep_precision"), ratio(pred, "true", "frac_kept")])


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Double columns (all of them by default) rounded, so that engines agree."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, n) for c in names})


def permits(spark, sf) -> DataFrame:
    """Orders as permits: all raw texts."""
    o = table(spark, sf, "orders")
    kind = F.create_map(F.lit("P"), F.lit("NEWC"), F.lit("F"), F.lit("RNVS"), F.lit("O"), F.lit("RNVN"))[F.col("o_orderstatus")]
    date = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    money = F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice"))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("Tenant build-out "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("permitNum"), kind.alias("permitType"), money.alias("estProjectCost"), date.alias("issueDate"), text.alias("description"))


PERMITS = """permits AS (SELECT o_orderkey AS "permitNum", CASE o_orderstatus WHEN 'P' THEN 'NEWC' WHEN 'F' THEN 'RNVS' ELSE 'RNVN' END AS "permitType", o_totalprice cost,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) END yr, o_orderkey % 5 = 0 tenant FROM orders)"""
BANDS = (50_000, 100_000, 250_000, 400_000)


def strata():
    from ..functions.predicates import build_strata

    return build_strata(bands=BANDS, pivot=1998)


STRATA_SQL = [
    ("01 NEWC top any era", "\"permitType\" = 'NEWC' AND cost >= 400000"),
    ("02 NEWC high recent", "\"permitType\" = 'NEWC' AND cost >= 250000 AND cost < 400000 AND yr >= 1998"),
    ("03 NEWC high old", "\"permitType\" = 'NEWC' AND cost >= 250000 AND cost < 400000 AND yr < 1998"),
    ("04 RNVS high recent", "\"permitType\" = 'RNVS' AND cost >= 250000 AND cost < 400000 AND yr >= 1998"),
    ("05 RNVS high old", "\"permitType\" = 'RNVS' AND cost >= 250000 AND cost < 400000 AND yr < 1998"),
    ("06 RNVS mid recent", "\"permitType\" = 'RNVS' AND cost >= 100000 AND cost < 250000 AND yr >= 1998"),
    ("07 RNVN high recent", "\"permitType\" = 'RNVN' AND cost >= 250000 AND cost < 400000 AND yr >= 1998"),
    ("08 RNVN mid recent", "\"permitType\" = 'RNVN' AND cost >= 100000 AND cost < 250000 AND yr >= 1998"),
    ("09 RNVN mid old", "\"permitType\" = 'RNVN' AND cost >= 100000 AND cost < 250000 AND yr < 1998"),
    ("10 RNVN low recent", "\"permitType\" = 'RNVN' AND cost >= 50000 AND cost < 100000 AND yr >= 1998"),
    ("11 no date", "yr IS NULL"),
    ("12 RNVN mid tenant", "\"permitType\" = 'RNVN' AND cost >= 100000 AND cost < 250000 AND tenant"),
]
