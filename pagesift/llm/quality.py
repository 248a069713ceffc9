"""Quality rules judged with the help of each document's host.

Base rules fail a document by itself. Failures of base and softer rules are added up by host, each host's rate is
shrunk towards the corpus by a beta prior fitted to all hosts' rates, and the host's verdict is joined back to its
documents: in a watched host documents that break a soft rule go, in a bad one, where most documents fail, all do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.storage import lookup_join, materialize
from .common import ROWS, as_bytes, fresh

SYMBOLS = b"#*$%&|<>"
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Shrunk failure rates above which a host is watched, and above which it is bad.
WATCHED = 0.25
BAD = 0.5


def metrics_of(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(words, their code points, symbols, repeated lines, words in repeated 3-word windows) of one UTF-8 text."""
    import numpy as np

    if not text:
        return 0, 0, 0, 0, 0
    own = text.split()
    n = len(own)
    chars = len(b"".join(own).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    repeated = len(lines) - len(set(lines))
    covered = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        number = ids.setdefault
        word = np.fromiter((number(w, len(ids)) for w in own), np.int64, n)
        pair = np.unique(word[:-1] * len(ids) + word[1:], return_inverse=True)[1]
        _, which, counts = np.unique(pair[:-1] * len(ids) + word[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        mask = np.zeros(n, bool)
        for k in range(3):
            mask[k : k + len(twice)] |= twice
        covered = int(mask.sum())
    return n, chars, symbols, repeated, covered


def metrics(text: Column | str) -> Column:
    """The metrics of a text column; null and empty texts have zeros."""

    @arrow_udf(METRICS)
    def measure(column):
        import numpy as np
        import pyarrow as pa

        rows = np.array([metrics_of(t) for t in as_bytes(column)], np.int64).reshape(-1, 5)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return measure.asNondeterministic()(text)  # so that no rewrite evaluates it more than once


def base_failed(q: str) -> Column:
    """Under 50 words, or over half of them in repeated 3-word windows."""
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def soft_failed(q: str) -> Column:
    """Over 10 symbols in 100 words, over 3 repeated lines in 1000 words and at least 3, or words of under 2 or over 12 code points on average."""
    n, chars = F.col(f"{q}.n_words"), F.col(f"{q}.word_chars")
    return (10 * F.col(f"{q}.n_symbols") > n) | ((F.col(f"{q}.n_dup_lines") >= 3) & (1000 * F.col(f"{q}.n_dup_lines") > 3 * n)) | (chars < 2 * n) | (chars > 12 * n)


def host_rates(judged: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """One row for each host: documents, failures, and the failure rate shrunk by an empirical beta prior.

    The prior has the mean of all hosts' rates and, by the method of moments, their variance less what counting
    alone would cause. The prior weighs 2 to 1000 documents: 1000 where hosts do not differ beyond counting, and 2,
    a flat prior's weight, where they differ by more than any beta prior with one mode. The rate is
    (failures + a) / (documents + a + b). A null host is a host of its own. An empty table gives no hosts.
    """
    hosts = judged.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = prior["m"] or 0.0
    strength = prior_strength(mean, prior["v"], prior["inv"] or 0.0)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", shrunk)


def prior_strength(mean: float, variance: float, inverse: float, least: float = 2.0, most: float = 1000.0) -> float:
    """a + b of the beta prior: mean (1 - mean) / (variance beyond sampling) - 1, kept within bounds."""
    spread = mean * (1 - mean)
    beyond = variance - spread * inverse
    return most if beyond <= 0 else min(most, max(least, spread / beyond - 1))


def judge(docs: DataFrame, host: str = "source", out: str = "quality") -> DataFrame:
    """Add ``out`` to each row of ``docs``: the metrics, ``base_failed``, ``soft_failed``, ``host_rate``, ``host_verdict`` and ``kept``.

    Needs ``text`` and ``host``; keeps all other columns, but replaces an own column named ``out``. Texts are
    measured once: rows and metrics are written, failures counted by host, and hosts joined to the written rows.
    ``host_verdict`` is good, watched or bad. A document goes if it fails a base rule, if it breaks a soft rule in a
    watched host, or if its host is bad; so a document that breaks no rule goes only where most of its host fails.
    Null, empty and blank texts have no words and fail; a null host is a host; equal rows are judged alike.
    """
    return judge_measured(materialize(docs.drop(out).withColumn(out, metrics("text")), "metrics", batch=ROWS), host, out)


def judge_measured(measured: DataFrame, host: str, out: str) -> DataFrame:
    """As ``judge``, for written rows whose ``out`` holds the metrics."""
    hosts = materialize(host_rates(measured.select(F.col(host).alias("host"), (soft_failed(out) | base_failed(out)).alias("failed"))), "hosts")
    own = fresh(measured, "_host")
    side = hosts.select(F.struct("host", "rate").alias(own))
    joined = lookup_join(measured, side, F.col(host).eqNullSafe(F.col(f"{own}.host")), "left")
    rate = F.col(f"{own}.rate")
    verdict = F.when(rate > BAD, "bad").when(rate > WATCHED, "watched").otherwise("good")
    kept = ~base_failed(out) & ~(soft_failed(out) & (rate > WATCHED)) & (rate <= BAD)
    names = [x.split()[0] for x in METRICS.split(", ")]
    made = F.struct(*(F.col(f"{out}.{n}") for n in names), base_failed(out).alias("base_failed"), soft_failed(out).alias("soft_failed"), rate.alias("host_rate"), verdict.alias("host_verdict"), kept.alias("kept"))
    return joined.withColumn(out, made).drop(own)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document row: counts, base verdict, host verdict, verdict."""
    measured = materialize(docs.select("doc_id", "source", metrics("text").alias("quality")), "metrics", batch=ROWS)
    return judge_measured(measured, "source", "quality").select("doc_id", "quality.*").drop("host_rate")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their own columns as they are."""
    out = fresh(docs, "quality")
    return judge(docs, out=out).where(f"`{out}`.kept").select(*docs.columns)
