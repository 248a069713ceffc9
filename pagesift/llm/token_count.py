"""Token counts by a two-tier lookup on the map side.

A text is cut where no piece of the vocabulary can cross (before a run of blanks, around line ends), so the counts
of its pre-tokens add up to its own. Lengths of the corpus's frequent pre-tokens are broadcast in one table of
bounded size; others are encoded by the library when first met and kept in a bounded cache of the worker.
No pre-token is shuffled: finding the frequent ones moves one bounded summary for each task.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.storage import materialize
from .common import once

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Entries of the broadcast table (about 3 MB) and of each task's summary.
FREQUENT = 30_000
#: Entries of a worker's cache; it is emptied when full.
CACHE = 400_000
#: Longer pre-tokens are encoded but not kept.
LONGEST = 64
BLANK = "▁"
_UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


def units(text: str) -> list[str]:
    """The pre-tokens of a text, blanks written as the library does, the blank it puts in front included."""
    if "  " in text or text[:1] in ("", " ") or BLANK in text:
        return _UNITS.findall(BLANK + text.replace(" ", BLANK)) if text else []
    marked = (BLANK + text.replace(" ", " " + BLANK)).replace("\n", " \n ")
    return [u for u in marked.split(" ") if u]


class Lengths(dict):
    """Pre-token to number of tokens; encodes what it lacks."""

    def __init__(self, model_file: str, known: dict[str, int] = {}, most: int = CACHE):
        import sentencepiece

        super().__init__(known)
        self.known, self.most = known, most + len(known)
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model_file).encode

    def __missing__(self, unit: str) -> int:
        if unit[0] == BLANK:  # the library puts one blank in front
            n = len(self.encode(unit[1:])) if len(unit) > 1 else len(self.encode("\n")) - 1
        else:
            n = len(self.encode("\n" + unit)) - 2
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.known)
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, units(text))) if text else 0


def frequent_units(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The ``most`` most frequent pre-tokens of all texts: each task counts its own with a bounded summary."""

    def summarize(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(units(text))
                    if len(seen) > 12 * most:
                        seen = Counter({u: n for u, n in seen.most_common(4 * most) if len(u) <= LONGEST})
        top = [(u, n) for u, n in seen.most_common(most) if len(u) <= LONGEST and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    counts = materialize(docs.select("text").mapInArrow(summarize, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")), "units")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") * (10 * most) >= total)  # at most ten times ``most`` rows, whatever the corpus
    return [r.unit for r in often.orderBy(F.desc("n"), "unit").limit(most).select("unit").collect()]


def with_counts(docs: DataFrame, model_file: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Add ``n_tokens`` to each row of ``docs`` (from ``text``); other columns are kept, an own ``n_tokens`` is replaced.

    Equal to the library's own count of the whole text without begin, end or added tokens. Null and empty texts
    have none. The frequent table only saves time: any table gives the same counts.
    """
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path(MODEL)
    spark = docs.sparkSession
    start = Lengths(model_file)
    known = spark.sparkContext.broadcast((model_file, {u: start[u] for u in frequent_units(docs, frequent)}))

    @arrow_udf("long")
    def count(text):
        import pyarrow as pa

        lengths = once(known.value, lambda own: Lengths(*own))  # with a cache that outlives the task
        return pa.array(map(lengths.count, text.to_pylist()), pa.int64())

    return docs.withColumn("n_tokens", count("text"))


def report(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each document row: doc_id, n_bytes, n_tokens, over_limit."""
    counted = with_counts(docs.select("doc_id", "text"), model_file)
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
