"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from . import decontaminate, exact_dedup, license_scan, line_dedup, mixing, quality, ranked_search, repair, simhash, substring_dedup, token_count, token_output, warc
from .common import table
from .oracles import ORACLES


def op1_license_scan(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op4_token_count(spark, sf_dir):
    return token_count.report(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op6_token_output(spark, sf_dir):
    return token_output.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repair(spark, sf_dir):
    return repair.report(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_warc, op4_token_count, op5_substring_dedup, op6_token_output, op7_simhash, op8_line_dedup, op9_mixing, op10_quality, op11_exact_dedup, op12_ranked_search, op13_repair, pipeline)}
__all__ = ["ORACLES", "QUERIES"]
