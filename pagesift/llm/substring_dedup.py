"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes cuts each text where the hash of the last 16 bytes falls below a bound, so cuts
depend on nothing but the bytes around them: a passage is cut alike wherever it stands, and insertions shift no
cuts after it. Chunks are compared by 96-bit digest; neighbouring chunks that other documents have too make up a repeated
span, and spans of a minimal length are reported or removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.storage import materialize
from .common import as_bytes, fresh

#: Mean bytes between cuts; the longest chunk; the shortest span that counts (about 18 words).
MEAN = 24
LONGEST = 4096
SPAN = 120
CHUNK = "doc_id long, start int, size int, high long, low int"
#: The first 96 bits of a chunk's XXH3: 10**12 different chunks have two alike with a chance of one in 100,000.
DIGEST = ["high", "low"]
#: Digests with more than this part of all repeated chunks are hot, so there are fewer of them than this.
HOT = 20_000
#: A hot digest is joined in so many parts.
PARTS = 32


def _gear():
    """The 256 gear values, 16 bits each, from a multiplicative rule."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.uint16)


def cuts(text: bytes, mean: int = MEAN, longest: int = LONGEST, gear=None):
    """Ends of the chunks of one text, the last one its length.

    The hash after byte i is the sum of gear[byte i-k] << k, in 16 bits; doubling adds up 2, 4, 8, 16 bytes at once.
    """
    import numpy as np

    gear = _gear() if gear is None else gear
    h = gear[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8):
        if len(h) > k:
            more = h[:-k] << k
            h = h.copy()
            h[k:] += more
    ends = np.flatnonzero(h < 65536 // mean) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > longest:
        ends = np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends.tolist(), gaps.tolist())])
    return ends


def chunks(docs: DataFrame, mean: int = MEAN) -> DataFrame:
    """Rows ``doc_id, start, size, high, low`` of all chunks; starts and sizes are in UTF-8 bytes. Null texts have none.

    ``doc_id`` is cast to long.
    """

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        gear = _gear()
        for batch in batches:
            for some in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                ids, starts, sizes, digests = [], [], [], []
                for doc, text in zip(some.column("doc_id").to_pylist(), as_bytes(some.column("text"))):
                    if not text or doc is None:
                        continue
                    ends = cuts(text, mean, gear=gear)
                    begins = np.concatenate([[0], ends[:-1]])
                    digests += [xxh3_128_digest(text[s:e]) for s, e in zip(begins.tolist(), ends.tolist())]
                    ids.append(np.full(len(ends), doc, np.int64))
                    starts.append(begins)
                    sizes.append(ends - begins)
                if ids:
                    bits = np.frombuffer(b"".join(digests), [("high", ">i8"), ("low", ">i4"), ("rest", "V4")])
                    columns = [np.concatenate(ids), np.concatenate(starts).astype(np.int32), np.concatenate(sizes).astype(np.int32), bits["high"].astype(np.int64), bits["low"].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "size", *DIGEST])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, CHUNK)


def repeated_chunks(docs: DataFrame, mean: int = MEAN) -> DataFrame:
    """The chunks that more than one document has, with ``first_id``, the smallest doc_id that has them.

    A digest's documents are only counted as minimum and maximum, which combine before the shuffle; the chunks
    then join the written list of repeated digests. A digest that holds much of them is joined in several parts, dealt
    by document and place, so that no task has all its chunks.
    """
    cut = chunks(docs, mean)
    seen = cut.groupBy(*DIGEST).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))
    shared = materialize(seen.where("first_id < last_id").drop("last_id"), "digests")
    bound = max(1000.0, (shared.agg(F.sum("n")).first()[0] or 0) / HOT)
    hot = F.broadcast(shared.where(F.col("n") > bound).select(*DIGEST, F.lit(True).alias("hot")))  # fewer than HOT rows
    parts = F.when(F.col("n") > bound, F.lit(PARTS)).otherwise(F.lit(1))
    dealt = shared.select(*DIGEST, "first_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    mine = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    # the part stands in the last bits of the digest, so that chunks carry no more columns
    cut = cut.join(hot, DIGEST, "left").select("doc_id", "start", "size", "high", F.col("low").bitwiseXOR(mine).alias("low"))
    return cut.join(dealt.select("high", F.col("low").bitwiseXOR(F.col("part")).alias("low"), "first_id"), DIGEST).drop("low")


def spans(docs: DataFrame, mean: int = MEAN, least: int = SPAN) -> DataFrame:
    """Repeated spans of at least ``least`` bytes, one row each; documents without one have no row.

    Columns: doc_id, span_start and span_end (UTF-8 bytes), n_bytes, first_id (the smallest doc_id that shares a
    part of the span), ``later`` (array of start, end: the parts that a smaller doc_id has too), removed_bytes (their
    sum). Rows with a null doc_id or text are left out; rows that share a doc_id count as one document.
    """
    found = repeated_chunks(docs, mean).dropDuplicates(["doc_id", "start", "size", "high"])
    by_doc = Window.partitionBy("doc_id").orderBy("start", "high", "size")
    fresh = F.coalesce(F.lag(F.col("start") + F.col("size")).over(by_doc) != F.col("start"), F.lit(True))
    marked = found.withColumn("fresh", fresh.cast("int"))
    grouped = marked.withColumn("span", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.col("first_id") < F.col("doc_id")
    out = grouped.groupBy("doc_id", "span").agg(
        F.min("start").alias("span_start"),
        F.max(F.col("start") + F.col("size")).alias("span_end"),
        F.min("first_id").alias("first_id"),
        F.coalesce(F.sum(F.when(later, F.col("size"))), F.lit(0)).alias("removed_bytes"),
        F.array_sort(F.collect_list(F.when(later, F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("later"),
    )
    return out.withColumn("n_bytes", F.col("span_end") - F.col("span_start")).where(F.col("n_bytes") >= least).drop("span")


def report(docs: DataFrame) -> DataFrame:
    """One row for each repeated span: doc_id, span_start, span_end, n_bytes, first_id, removed_bytes."""
    return spans(docs).select("doc_id", F.col("span_start").cast("long"), F.col("span_end").cast("long"), F.col("n_bytes").cast("long"), "first_id", F.col("removed_bytes").cast("long"))


def _without(text, starts, ends):
    """Texts without the given byte ranges, which are in order; cut characters are dropped."""

    @arrow_udf("string")
    def cut(texts, firsts, lasts):
        import pyarrow as pa

        out = []
        for data, s, e in zip(as_bytes(texts), firsts.to_pylist(), lasts.to_pylist()):
            if data is not None and s:
                kept, at = [], 0
                for a, b in zip(s, e):
                    kept.append(data[at:a])
                    at = max(at, b)
                data = b"".join([*kept, data[at:]])
            out.append(None if data is None else data.decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    return cut(text, starts, ends)


def remove(docs: DataFrame, mean: int = MEAN, least: int = SPAN) -> DataFrame:
    """The documents with repeated spans removed from ``text`` in all but the smallest doc_id that has them.

    Other columns and rows are kept as they are. ``n_chars``, where there is one, is not recounted.
    """
    own = fresh(docs, "_later")
    gone = spans(docs.select("doc_id", "text"), mean, least).where("removed_bytes > 0").groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("later"))).alias("later"))
    joined = docs.join(gone.select(F.struct("doc_id", "later").alias(own)), F.col("doc_id") == F.col(f"{own}.doc_id"), "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(_without("text", F.col(f"{own}.later.start"), F.col(f"{own}.later.end")))
    return joined.withColumn("text", text).select(*docs.columns)
