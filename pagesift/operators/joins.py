"""Joins, set operations, orders and limits over ids, queues and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import first_per_key, ranked


def label_context(labels: DataFrame, pages: DataFrame, docs: DataFrame, page="page_id", doc="document_id") -> DataFrame:
    """Labels with their page and its document, inner."""
    return labels.join(pages, page).join(docs, doc)


def join_embeddings(truth: DataFrame, emb: DataFrame, key="page_id", seq: str | None = None) -> DataFrame:
    """Truth with vectors; of a repeated id the last vector in the order of ``seq``."""
    return truth.join(first_per_key(emb, [key], seq, last=True) if seq else emb, key)


def missing_from(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks."""
    return df.join(other.select(*_keys(key)).distinct(), _keys(key), "left_anti")


todo = missing_from


def align(emb: DataFrame, ids: DataFrame, key="page_id") -> DataFrame:
    """The rows of ``emb`` for each of ``ids``; raises if one is missing."""
    lost = missing_from(ids, emb, key).limit(1).count()
    if lost:
        raise ValueError(f"ids without a row by {key}")
    return ids.select(key).distinct().join(emb, key)


def left_default(df: DataFrame, dim: DataFrame, key, column: str, default) -> DataFrame:
    """Left join with a default for keys that ``dim`` lacks."""
    return df.join(dim.select(*_keys(key), column), _keys(key), "left").withColumn(column, F.coalesce(column, F.lit(default)))


def restrict(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    return df.join(keys.select(*_keys(key)).distinct(), _keys(key), "left_semi")


def usable(truth: DataFrame, *embs: DataFrame, key="page_id") -> DataFrame:
    """Truth restricted to ids that have a vector in any space."""
    return restrict(truth, union_ids(*embs, key=key), key)


def union_ids(*dfs: DataFrame, key) -> DataFrame:
    return reduce(DataFrame.union, (d.select(*_keys(key)) for d in dfs)).distinct()


def common_ids(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.select(*_keys(key)).intersect(b.select(*_keys(key)))


def unknown_values(df: DataFrame, column: str, known: list) -> DataFrame:
    """Distinct values not in ``known``, with their rows; null is unknown."""
    return df.where(~F.coalesce(F.col(column).isin(*known), F.lit(False))).groupBy(column).agg(F.count("*").alias("n"))


def assert_disjoint(a: DataFrame, b: DataFrame, key) -> None:
    both = common_ids(a, b, key).take(3)
    if both:
        raise AssertionError(f"shared keys, for example {[tuple(r) for r in both]}")


def populations(has_text: Column, has_embedding: Column) -> Column:
    """Which branch serves a page: text, image or neither."""
    return F.when(has_text, "text").when(has_embedding, "image").otherwise("neither")


def review_union(*reasons: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reasons).distinct()


def append_results(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def ordered(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*keys)


def take(df: DataFrame, n: int | None, *order) -> DataFrame:
    """The first ``n`` rows in an order; all for none or 0."""
    out = df.orderBy(*order)
    return out.limit(n) if n else out


def diversity_queue(pages: DataFrame, labels: DataFrame, group: str, order: str, page="page_id") -> DataFrame:
    """Unlabelled pages, those of the groups with the fewest labelled pages first."""
    done = labels.select(page).distinct()
    counts = pages.join(done, page, "left_semi").groupBy(group).agg(F.count("*").alias("n_labels"))
    rest = pages.join(done, page, "left_anti").join(counts, group, "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0).cast("long")))
    return rest.orderBy("n_labels", group, order)


def leaderboard(results: DataFrame, top: int = 10, baseline: DataFrame | None = None, recall="finish_recall", fp="fp_rate", tie: str | None = None) -> DataFrame:
    """The best ``top`` rows with their rank: recall down (null last), then fp up (null as 1)."""
    rows = append_results(results, baseline) if baseline is not None else results
    order = [F.desc_nulls_last(recall), F.coalesce(F.col(fp), F.lit(1.0)).asc(), *([F.asc(tie)] if tie else [])]
    best = rows.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_operating_point(table: DataFrame, min_recall: float, eps: float = 1e-9, recall="finish_recall", fp="fp_rate", thr="thr") -> DataFrame:
    """Of the thresholds that reach a recall, the one with the lowest fp; the highest threshold of ties."""
    return table.where(F.col(recall) >= min_recall - eps).orderBy(F.asc_nulls_last(fp), F.desc(thr)).limit(1)


def rank_in_group(df: DataFrame, group: str, size: str, id_: str) -> DataFrame:
    return ranked(df, [group], F.desc_nulls_last(size), F.asc(id_))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)
