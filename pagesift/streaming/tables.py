"""Streams that keep tables up to date. Each gives what the batch operator gives on all rows so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import PRIORITY, best_per_key, current_truth_maxby
from . import keyed


def _merging(src: DataFrame, sink: str, key: str, checkpoint: str, combine, buckets: int) -> StreamingQuery:
    def merge(batch: DataFrame, number: int) -> None:
        keyed.upsert(batch, sink, key, combine, checkpoint, number, buckets)

    return src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(src: DataFrame, sink: str, key: str, checkpoint: str, seq: str | None = None, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Keep the first row of each id in the keyed table ``sink`` (``keyed.read``); ids are remembered for ever, as the table itself.

    Of a batch's rows of one id the first by ``seq`` counts; a stored row stays as it is. A batch reads the buckets of
    its ids alone; one that is run again after a failure adds none.
    """
    combine = lambda rows: best_per_key(rows, [key], F.asc("_new"), F.asc(seq or key))
    return _merging(src, sink, key, checkpoint, combine, buckets)


def stream_truth(src: DataFrame, sink: str, checkpoint: str, priority: dict[str, int] = PRIORITY, key: str = "page_id", buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Keep the best label of each page in the keyed table ``sink``, which has the label's columns.

    The best of the stored row and a batch's rows is the best of all rows so far, in whatever order they come, so late
    rows need no watermark and no state is held but the table.
    """
    combine = lambda rows: current_truth_maxby(rows, priority, key)
    return _merging(src, sink, key, checkpoint, combine, buckets)


def stream_counts(src: DataFrame, column: str, name: str, checkpoint: str) -> StreamingQuery:
    """Rows by value of a column, kept complete in memory on the driver: for columns of few values, as a status."""
    counts = src.groupBy(column).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
