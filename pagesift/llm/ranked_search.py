"""Ranked lexical search: the best documents of each query item, by presence masks.

Documents are written once as an index of the queries' terms. A task takes blocks of documents; for each item the
bitmaps of its terms give every document a mask of the terms that it has, documents of one mask form a group, and a
group's maximum score is the sum of its terms' highest contributions in the block. Groups are scored by descending
maximum until it falls below the item's tenth best score so far; only then is every better document known. Each task
returns its best rows for each item, which holds the best of all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.storage import discard, materialize
from .common import ROWS, as_bytes, once

TOP = 10
#: Pairs of an item and a term that are searched in one pass: the bound on what is broadcast (about 100 bytes each).
PAIRS_PER_PASS = 400_000
#: Documents of a block.
BLOCK = 4096

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case; letters, digits and all bytes of non-ASCII characters stay; the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def asked_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, c)``: the terms of each item and how often it has them. Equal rows count once."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(1))
    return items.select("item_id", "text").distinct().select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("c"))


def weight(n: int, df: int) -> int:
    """A term's weight from the documents with terms and those that hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Rows of doc_id, all its terms ``n``, and the numbers and counts of those in ``terms``, from whole texts; one map-side pass, not written."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def look(batches):
        import numpy as np
        import pyarrow as pa

        number = once(sent.value, lambda own: {t: i for i, t in enumerate(own)})
        get, width = number.get, max(1, len(number))
        for batch in batches:
            found, sizes = [], []
            for doc, text in enumerate(as_bytes(batch.column(1))):
                words = text.translate(_TABLE).split() if text else []
                ids = np.fromiter((i for i in map(get, words) if i is not None), np.int64)
                found.append(ids + doc * width)
                sizes.append(len(words))
            keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            at = np.searchsorted(keys, np.arange(len(sizes) + 1, dtype=np.int64) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, INDEX)


class Block:
    """Some documents' contributions by document and by term, in numbers of the queries' terms."""

    def __init__(self, ids, lengths, offsets, terms, tfs, weights, n_docs, n_terms):
        import numpy as np

        m = 25 + (75 * lengths * n_docs) // n_terms
        of = np.repeat(np.arange(len(ids)), np.diff(offsets))
        worth = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[of]))
        some = worth > 0
        self.ids, self.of, self.term, self.worth = ids, of[some], terms[some], worth[some]
        self.start = np.searchsorted(self.of, np.arange(len(ids) + 1))
        order = np.argsort(self.term, kind="stable")
        self.by_term = self.of[order]
        self.terms, begin = np.unique(self.term[order], return_index=True)
        self.bounds = np.append(begin, len(order))
        self.most = np.maximum.reduceat(self.worth[order], begin) if len(begin) else begin

    def masks(self, terms, counts):
        """(documents with any of ``terms``, their group, each group's maximum score)."""
        import numpy as np

        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        at, counts = at[here], counts[here]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = np.zeros((-(-len(at) // 64), len(self.ids)), np.uint64)
        for j, t in enumerate(at):
            words[j // 64, self.by_term[self.bounds[t] : self.bounds[t + 1]]] |= np.uint64(1 << (j % 64))
        docs = np.flatnonzero(words.any(axis=0))
        words = words[:, docs]
        group, n = np.zeros(len(docs), np.int64), 1
        for w in words:  # one word of the mask after the other refines the groups
            distinct, own = np.unique(w, return_inverse=True)
            found, group = np.unique(group * len(distinct) + own, return_inverse=True)
            n = len(found)
        first = np.zeros(n, np.int64)
        first[group[::-1]] = np.arange(len(docs))[::-1]
        most = np.zeros(n, np.int64)
        for j, t in enumerate(at):
            has = (words[j // 64, first] >> np.uint64(j % 64)) & np.uint64(1)
            most += has.astype(np.int64) * (counts[j] * self.most[t])
        return docs, group, most

    def scores(self, docs, counted):
        """Exact scores of documents; ``counted`` has the item's repeats of each term number."""
        import numpy as np

        size = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(self.start[docs], size)
        total = np.concatenate(([0], np.cumsum(counted[self.term[at]] * self.worth[at])))
        return total[ends] - total[ends - size]


def best_of(block: Block, terms, counts, best: list[tuple], counted, top: int) -> list[tuple]:
    """``best``, the (-score, id is null, id) of the best documents so far, with those of a block.

    Masks are taken by descending maximum; it stops when the next cannot even tie with the last of ``top`` rows.
    """
    import numpy as np

    docs, group, most = block.masks(terms, counts)
    if not len(docs):
        return best
    order = np.argsort(-most[group], kind="stable")
    bound, counted[terms] = most[group][order], counts
    done, step = 0, 4 * top
    while done < len(order):
        least = -best[-1][0] if len(best) == top else 1
        if bound[done] < least:
            break
        few = docs[order[done : done + step]]
        score = block.scores(few, counted)
        good = score >= least
        best = sorted(best + [(-s, x is None, x) for s, x in zip(score[good].tolist(), (block.ids[d] for d in few[good]))], key=lambda r: (r[0], r[1], r[2] or 0))[:top]
        done, step = done + step, 2 * step
    counted[terms] = 0
    return best


def _searching(spark, asked: list[tuple], weights: list[int], n_docs: int, n_terms: int, top: int):
    """A map over index rows to each task's best rows ``(item, doc_id, score)``."""
    sent = spark.sparkContext.broadcast((asked, weights))

    def find(batches):
        import numpy as np
        import pyarrow as pa

        own, w = once(sent.value, lambda v: ([(np.array(t, np.int64), np.array(c, np.int64)) for t, c in v[0]], np.array(v[1], np.int64)))
        best: list[list[tuple]] = [[] for _ in own]
        counted = np.zeros(len(w), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, tfs = batch.column(2), batch.column(3)
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            flat = [x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs)]
            block = Block(batch.column(0).to_pylist(), batch.column(1).to_numpy(), offsets, *flat, w, n_docs, n_terms)
            for k, (t, c) in enumerate(own):
                best[k] = best_of(block, t, c, best[k], counted, top)
        rows = [(k, x, -s) for k, found in enumerate(best) for s, _, x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return find


def _pass(docs: DataFrame, asked: list, schema, top: int, block: int) -> DataFrame:
    """The best rows of the items in ``asked``, rows of (item_id, terms with counts)."""
    spark = docs.sparkSession
    terms = sorted({t for r in asked for t in r.terms})
    number = {t: i for i, t in enumerate(terms)}
    built = materialize(index(docs, [t.encode() for t in terms]), "index", batch=ROWS)
    total = built.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = {r.t: r.n for r in built.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weights = [weight(total[0], held.get(i, 0)) for i in range(len(terms))]
    items = [(sorted(number[t] for t in r.terms), [c for _, c in sorted((number[t], c) for t, c in zip(r.terms, r.counts))]) for r in asked]
    found = built.mapInArrow(_searching(spark, items, weights, total[0], max(1, total[1]), top), "item int, doc_id long, score long")
    found = materialize(found, "found", batch=block)
    discard(built)
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(asked)], schema)
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs_per_pass: int = PAIRS_PER_PASS, block: int = BLOCK) -> DataFrame:
    """Rows ``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item with a score above zero.

    ``items`` has ``item_id`` and ``text``. They are a stated query set: their terms are counted first and searched in
    passes of about ``pairs_per_pass`` pairs of item and term, each of which reads all documents. Equal scores rank by
    ascending doc_id, which is cast to long, null last. Null texts have no terms; items without terms and an empty
    table give no rows; rows of ``items`` that share an id are one item, equal ones count once; repeated documents each
    take a rank. A task gives at most ``top`` rows for each item, whatever the size of its part.
    """
    from pyspark.sql.types import IntegerType, StructField, StructType

    asked = materialize(asked_terms(items), "asked")
    passes = max(1, -(-asked.count() // pairs_per_pass))
    schema = StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
    parts = []
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("c").alias("counts"))
        parts.append(_pass(docs, mine.collect(), schema, top, block))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item."""
    return search(docs, items)
