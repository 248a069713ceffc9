"""Reports: yield, coverage, agreement, duplicates, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import escape_pair, has_ext, int_or_zero, pct, plan_likeness


def yield_table(results: DataFrame, strata: DataFrame, stratum="stratum", docs="docCount", plans="planLikeCount", pdfs="pdfCount") -> DataFrame:
    """For each stratum: rows, share with documents, share with a plan-like one, median of PDFs.

    Strata without rows are listed with 0 and blanks; strata that ``strata`` does not name are listed too.
    """
    rows = results.groupBy(stratum).agg(
        F.count("*").alias("n"),
        F.count_if(int_or_zero(docs) > 0).alias("_docs"),
        F.count_if(int_or_zero(plans) > 0).alias("_plans"),
        F.median(int_or_zero(pdfs)).alias("median_pdfs"),
    )
    out = strata.select(stratum).distinct().join(rows, stratum, "full").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(stratum, "n", pct("_docs", "n").alias("pct_docs"), pct("_plans", "n").alias("pct_plans"), "median_pdfs")


def status_counts(log: DataFrame, status="status") -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))


def permit_stats(truth: DataFrame, group="permit_num", finish="finish") -> DataFrame:
    """Pages and must-not-miss pages of each group."""
    return truth.groupBy(group).agg(F.count("*").alias("pages"), F.count_if(finish).alias("finish_pages"))


def coverage(pages: DataFrame, flag: str, side: str) -> DataFrame:
    """Rows, rows with ``flag`` and their share, by side and over all (side null)."""
    return pages.rollup(side).agg(F.count("*").alias("total"), F.count_if(flag).alias("covered"), F.try_divide(F.count_if(flag).cast("double"), F.count("*")).alias("share"))


def coverage_delta(before: DataFrame, after: DataFrame, flag: str, side: str) -> DataFrame:
    """Coverage before and after, and what it gained."""
    a = coverage(before, flag, side).select(F.col(side).alias("_s"), F.col("share").alias("share_before"))
    b = coverage(after, flag, side).select(side, "total", F.col("share").alias("share_after"))
    return b.join(a, F.col(side).eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("gain", F.col("share_after") - F.col("share_before"))


def missing_by_doc(pages: DataFrame, missing: str, doc="document_id") -> DataFrame:
    """Documents with missing pages, the worst first."""
    return pages.groupBy(doc).agg(F.count_if(missing).alias("missing"), F.count("*").alias("pages")).where("missing > 0").orderBy(F.desc("missing"), doc)


def next_id(df: DataFrame, id_="id") -> DataFrame:
    return df.agg((F.coalesce(F.max(id_), F.lit(0)) + 1).cast("long").alias("next_id"))


def label_summary(truth: DataFrame, category="category", keep="keep", confidence="confidence") -> DataFrame:
    """Pages, share kept and mean confidence by category and over all (category null)."""
    return truth.rollup(category).agg(F.count("*").alias("pages"), F.avg(F.col(keep).cast("double")).alias("keep_rate"), F.avg(confidence).alias("mean_confidence"))


def doc_rollup(links: DataFrame, group="permit_num", pos="pos", id_="doc_id", name="filename") -> DataFrame:
    """Counts and delimited lists of the documents of each group, in order of ``pos``.

    docs, pdfs, plans and site_only counts; ``names`` of plan-like ones, ``ids`` and ``pairs`` (id|name, escaped).
    """
    kind = plan_likeness(name)
    rows = links.withColumn("_kind", kind)
    listed = F.array_sort(F.collect_list(F.struct(pos, F.col(id_).cast("string").alias("i"), F.coalesce(name, F.lit("")).alias("f"), F.col("_kind").alias("k"))))
    out = rows.groupBy(group).agg(
        F.count("*").alias("docs"),
        F.count_if(has_ext(name)).alias("pdfs"),
        F.count_if(F.col("_kind") == "plan").alias("plans"),
        F.count_if(F.col("_kind") == "site_only").alias("site_only"),
        listed.alias("_l"),
    )
    return out.select(
        group, "docs", "pdfs", "plans", "site_only",
        F.array_join(F.transform(F.filter("_l", lambda x: x["k"] == "plan"), lambda x: escape_pair(x["f"])), ";").alias("names"),
        F.array_join(F.transform("_l", lambda x: x["i"]), ";").alias("ids"),
        F.array_join(F.transform("_l", lambda x: F.concat_ws("|", x["i"], escape_pair(x["f"]))), ";").alias("pairs"),
    )


def agreement(labels: DataFrame, a: str, b: str, key="page_id", source="source", category="category") -> DataFrame:
    """Confusion counts of two sources on the pages that both labelled, with the overall rate on each row."""
    pairs = _pairs(labels, a, b, key, source, category)
    counts = pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    rate = pairs.agg(F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("agreement"))
    return counts.join(F.broadcast(rate))


def adjudication_queue(labels: DataFrame, a="labeler", b="review", judge="adjudicate", key="page_id", source="source", category="category") -> DataFrame:
    """Pages on which two sources differ and that no judge has settled."""
    differ = _pairs(labels, a, b, key, source, category).where("label_a <> label_b")
    return differ.join(labels.where(F.col(source) == judge).select(key).distinct(), key, "left_anti")


def _pairs(labels, a, b, key, source, category):
    """The latest label (by id) of each of two sources for each page with both."""
    wanted = labels.where(F.col(source).isin(a, b)).groupBy(key).agg(
        F.max_by(F.when(F.col(source) == a, F.col(category)), F.when(F.col(source) == a, F.col("id"))).alias("label_a"),
        F.max_by(F.when(F.col(source) == b, F.col(category)), F.when(F.col(source) == b, F.col("id"))).alias("label_b"),
    )
    return wanted.where("label_a IS NOT NULL AND label_b IS NOT NULL")


def duplicate_rows(labels: DataFrame, *keys: str) -> DataFrame:
    return labels.groupBy(*(keys or ("page_id", "source", "category"))).agg(F.count("*").alias("n")).where("n > 1")
