"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of all benchmark items (13 words each, or a whole shorter item) are the patterns. For patterns of one
length, a table gives for each block of three words how far the search may jump when it stands on that block;
where the jump is zero, the block's bucket holds the windows that end in it, and comparing all words confirms.
Most of a clean text is skipped eleven words at a time.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.storage import materialize
from .common import ROWS, as_bytes, fresh, once

WINDOW = 13
BLOCK = 3
#: Benchmark words searched in one pass, the bound on what one broadcast holds (about 1 KB a window).
WORDS_PER_PASS = 400_000
#: Longer items are sent in pieces of so many words, each with the first words of the next, so that passes are of one size.
PIECE = 10_000

HIT = "n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"

#: Upper case A-Z to lower case; letters, digits and all bytes of non-ASCII characters stay; the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words of a UTF-8 text; none for null."""
    return text.translate(_TABLE).split() if text else []


class Patterns:
    """Shift tables and buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set[str]], block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[window[-self.block :]][window] = items

    def search(self, text: list[bytes]):
        """Yield (start, end, items) of each occurrence, in order of start."""
        shift, default, length, block = self.shift.get, self.default, self.length, self.block
        at, n = length, len(text)  # at: one past the window's last word
        while at <= n:
            key = tuple(text[at - block : at])
            jump = shift(key, default)
            if jump:
                at += jump
                continue
            window = tuple(text[at - length : at])
            items = self.buckets[key].get(window)
            if items:
                yield at - length, at, items
            at += 1


def build(items: list[tuple[str, bytes]], window: int = WINDOW, block: int = BLOCK) -> list[Patterns]:
    """Searchers for the windows of ``(item_id, text)`` pairs, one for each window length that occurs."""
    by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            by_length[size][tuple(own[i : i + size])].add(item)
    return [Patterns(n, dict(found), block) for n, found in sorted(by_length.items())]


def find(searchers: list[Patterns], text: bytes | None) -> tuple[int, int, list[int], list[int], list[str]]:
    """(words, hit words, starts and ends of merged hit spans, items found) of one text."""
    own = words(text)
    found = [hit for s in searchers for hit in s.search(own)]
    starts, ends, items = [], [], set()
    for start, end, named in sorted(found, key=lambda x: x[:2]):
        items |= named
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return len(own), sum(ends) - sum(starts), starts, ends, sorted(items)


def _searching(spark, items: list[tuple[str, bytes]], window: int):
    """A column function that searches texts for the windows of ``items``."""
    sent = spark.sparkContext.broadcast((items, window))

    @arrow_udf(HIT)
    def search(text):
        import pyarrow as pa

        searchers = once(sent.value, lambda own: build(own[0], own[1]))
        n, hit, starts, ends, found = zip(*(find(searchers, t) for t in as_bytes(text))) if len(text) else ((),) * 5
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
            names=["n_words", "n_hit", "starts", "ends", "items"],
        )

    return search.asNondeterministic()  # so that no rewrite evaluates it more than once


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Rows ``(i, p, n, t)``: item id, number, words and text of the pieces that together have all windows of each item."""
    own = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), own.alias("w")).where("size(w) > 0")
    cut = items.select("i", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0), {PIECE})")).alias("p"))
    part = cut.select("i", "p", F.slice("w", F.col("p") + 1, F.lit(PIECE + window - 1)).alias("w"))
    return part.select("i", "p", F.size("w").alias("n"), F.array_join("w", " ").cast("binary").alias("t"))


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_pass: int = WORDS_PER_PASS, out: str = "hit") -> DataFrame:
    """Add ``out``: a struct of n_words, n_hit, the merged hit spans (word positions) and the item ids, sorted as strings.

    ``benchmark`` has ``item_id`` and ``text``; its words are counted first. It is searched in blocks of about
    ``words_per_pass`` words, a stated query set against all rows: one map-side pass with no shuffle for each block.
    With several blocks the rows that a pass hits are written, and spans of a document's passes are merged by
    ``doc_id`` and text hash. Null texts have no words; items with a null id or without words are ignored; a repeated
    item counts once; equal rows get equal results; an empty benchmark gives no hits. Other columns are kept, an own
    column named ``out`` is replaced.
    """
    spark, docs = docs.sparkSession, docs.drop(out)
    asked = materialize(_pieces(benchmark, window), "pieces")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-total // words_per_pass))
    searching = lambda p: _searching(spark, [(r.i, bytes(r.t)) for r in asked.where(F.pmod(F.xxhash64("i", "p"), F.lit(passes)) == p).collect()], window)("text")
    if passes == 1:
        return docs.withColumn(out, searching(0))
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    parts = [materialize(docs.select("doc_id", text_hash.alias("t"), searching(p).alias("h")).where("h.n_hit > 0").distinct(), "hits", batch=ROWS) for p in range(passes)]
    found = reduce(DataFrame.union, parts)
    merged = found.groupBy("doc_id", "t").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("h.starts", "h.ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"),
    )
    joined_spans = F.expr(
        "aggregate(spans, cast(array() as array<struct<s:int,e:int>>), (a, x) -> "
        "if(size(a) > 0 and x.starts <= element_at(a, -1).e, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.ends)))), "
        "concat(a, array(named_struct('s', x.starts, 'e', x.ends)))))"
    )
    m = fresh(docs, "_merged")
    side = merged.withColumn("spans", joined_spans).select(F.struct("doc_id", "t", "spans", "items").alias(m))
    counted = docs.withColumn(out, _searching(spark, [], window)("text"))
    joined = counted.join(side, F.col("doc_id").eqNullSafe(F.col(f"{m}.doc_id")) & (text_hash == F.col(f"{m}.t")), "left")
    hit = F.struct(
        F.col(f"{out}.n_words").alias("n_words"),
        F.coalesce(F.expr(f"aggregate({m}.spans, 0L, (a, x) -> a + x.e - x.s)"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.col(f"{m}.spans.s"), F.col(f"{out}.starts")).alias("starts"),
        F.coalesce(F.col(f"{m}.spans.e"), F.col(f"{out}.ends")).alias("ends"),
        F.coalesce(F.col(f"{m}.items"), F.col(f"{out}.items")).alias("items"),
    )
    return joined.withColumn(out, hit).drop(m)


def contaminated(hit: str = "hit", share: int = 20):
    """Whether at least one in ``share`` words of a document is hit."""
    return (F.col(f"{hit}.n_hit") > 0) & (F.col(f"{hit}.n_hit") * share >= F.col(f"{hit}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row: counts, the digest of its items and the verdict."""
    found = search(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        F.col("hit.n_hit").alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their own columns as they are."""
    out = fresh(docs, "hit")
    return search(docs, benchmark, out=out).where(~contaminated(f"`{out}`")).select(*docs.columns)
