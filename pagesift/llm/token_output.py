"""Token ids as Parquet list columns, in document order.

Texts are range-partitioned and sorted by doc_id, then encoded map-side straight into the written rows. Ids are
32-bit list elements with dictionary encoding (16 bits an id), row groups of a set size and page indexes, so readers
can take single documents, or counts alone, without reading other ids.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.running import running_sum
from ..plans.storage import arrow_batches, lookup_join, materialize, scratch_path
from .common import ROWS

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Entries, and characters of all keys for each entry, that a worker's cache of encoded units may hold.
CACHE = 300_000
KEY_CHARS = 32
#: Units of one string handed to the library.
JOINED = 32
#: Texts without these have words with one blank or one line end between them, and nothing else.
UNEVEN = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]\z"
#: What Parquet is told: row groups of 64 MB, pages of 1 MB or 20,000 rows, dictionary for ids, column indexes.
PARQUET = {
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "20000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "compression": "zstd",
}
#: Text bytes for one written file.
FILE_BYTES = 64 << 20
WRITTEN = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


class Encoder:
    """Encodes whole texts unit by unit; equal to the library's encoding of the whole text.

    A unit is a word with the blank or the line end in front of it. The byte-level pre-tokenizer always starts a new
    token there and a line end is a token of its own, so no token crosses units. Ids of units met before come from a
    flat array; new units are encoded by the library, many in one string, and cut apart where a token starts with
    the blank. Texts with other blanks or with special strings are encoded whole.
    """

    def __init__(self, file: str, most: int = CACHE):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(file)
        self.encode_all = lambda texts: [np.array(e.ids, np.uint32) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.special = [t.content for t in model.get_added_tokens_decoder().values()]
        (self.line_end,) = self.encode_all(["\n"])[0].tolist()
        mark = model.id_to_token(int(self.encode_all([" "])[0][0]))
        starts = [t for name, t in model.get_vocab().items() if name[0] == mark]
        self.blank_first = np.zeros(model.get_vocab_size(), bool)
        self.blank_first[starts] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        import numpy as np

        self.slot: dict[str, int] = {}  # in order of slots; a unit after a blank is its word, else "\n" and the word
        self.chars = 0
        self.ends = np.zeros(1, np.int64)  # ends[k]: where the ids of slot k begin and those of slot k - 1 end
        self.flat = np.zeros(0, np.uint32)
        self.used = np.zeros(0, bool)

    def _ids(self, slots):
        """The ids of many slots, one after another, and how many each has."""
        import numpy as np

        first, n = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        to = np.cumsum(n)
        return self.flat[np.repeat(first - to + n, n) + np.arange(to[-1] if len(to) else 0)], n

    def make_room(self, keep: int) -> None:
        """Keep ``keep`` of the units that were met again since the last time, the oldest first; none if they are too long."""
        import numpy as np

        kept = np.flatnonzero(self.used)[:keep]
        keys = list(self.slot)
        flat, n = self._ids(kept)
        self.slot = {keys[k]: i for i, k in enumerate(kept.tolist())}
        self.chars = sum(map(len, self.slot))
        self.flat, self.ends, self.used = flat, np.concatenate([[0], np.cumsum(n)]), np.zeros(len(kept), bool)
        if self.chars > self.most * KEY_CHARS // 2:
            self._clear()

    def _learn(self, new: list[str]) -> None:
        """Encode new units, those after a blank before those after a line end."""
        import numpy as np

        spaced, bare = [u for u in new if u[0] != "\n"], [u for u in new if u[0] == "\n"]
        ids, cuts, at = [self.flat], [], len(self.flat)
        for units, lead, starts in ((spaced, " ", self.blank_first.__getitem__), (bare, "", lambda x: x == self.line_end)):
            made = self.encode_all([lead + lead.join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)])
            if made:
                joined = np.concatenate(made)
                first = np.flatnonzero(starts(joined))
                if len(first) != len(units):
                    raise ValueError("the tokenizer does not start a token at each blank")
                ids.append(joined)
                cuts += [first[1:] + at, [at + len(joined)]]
                at += len(joined)
        self.slot.update(zip(spaced + bare, range(len(self.slot), len(self.slot) + len(new))))
        self.chars += sum(map(len, new))
        self.flat, self.ends = np.concatenate(ids), np.concatenate([self.ends, *cuts])
        self.used = np.concatenate([self.used, np.zeros(len(new), bool)])

    def _even(self, texts, end: int):
        """Ids of texts that have single blanks and line ends only, each followed by ``end``; and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # with a line end in front, so that the first word is like the first of any line
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        units = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), " ")
        words = pc.dictionary_encode(units.flatten())
        named = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(named) > self.most or self.chars > self.most * KEY_CHARS:
            self.make_room(self.most // 2)
        found = np.fromiter(map(self.slot.get, named, repeat(-1)), np.int64, len(named))
        new = np.flatnonzero(found < 0)
        self.used[found[found >= 0]] = True
        if len(new):
            # units at a line's start go last, in one string of their own
            new = new[np.argsort([named[k][0] == "\n" for k in new.tolist()], kind="stable")]
            found[new] = len(self.slot) + np.arange(len(new))
            self._learn([named[k] for k in new.tolist()])
        ids, n = self._ids(found[words.indices.to_numpy()])
        to = np.concatenate([[0], np.cumsum(n)])[np.cumsum(units.value_lengths().to_numpy())]
        out = np.append(ids[1:], np.uint32(end))  # without the line end in front, all move up by one
        out[to - 1] = end
        return out, np.diff(to, prepend=0)

    def encode(self, texts, end: int = END):
        """Ids of an Arrow array of texts, each followed by ``end``, and how many each has. Null texts are empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        even = pc.invert(pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.equal(texts, "")))
        for s in self.special:
            even = pc.and_not(even, pc.match_substring(texts, s))
        is_even = even.to_numpy(zero_copy_only=False)
        n = np.zeros(len(texts), np.int64)
        rest = [np.append(x, np.uint32(end)) for x in self.encode_all(texts.filter(pc.invert(even)).to_pylist())]
        n[~is_even] = list(map(len, rest))
        if is_even.any():
            ids, n[is_even] = self._even(texts.filter(even), end)
        out, here = np.empty(n.sum(), np.uint32), np.repeat(is_even, n)
        if is_even.any():
            out[here] = ids
        if rest:
            out[~here] = np.concatenate(rest)
        return out, n


@lru_cache(maxsize=2)
def encoder_of(file: str) -> Encoder:
    """The worker's encoder, whose cache outlives a task."""
    return Encoder(file)


def write(docs: DataFrame, path: str, tokenizer_file: str | None = None, end: int = END, files: int | None = None) -> None:
    """Encode ``doc_id, text`` rows and write them to ``path`` in ascending doc_id order.

    Each file holds a range of doc_ids; rows carry ``shard`` (the file's place in the order) and ``shard_start``
    (ids before the row in its file). Null and empty texts are written with the end id alone. Rows with a null
    doc_id come first; rows of one doc_id are in order of their text. Other columns are not written.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(TOKENIZER)
    if files is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(1, -(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, at, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer_file)
        for batch in batches:
            for some in (batch.slice(i, 400) for i in range(0, batch.num_rows, 400)):
                ids, n = encoder.encode(some.column("text"), end)
                to = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + to - n), pa.array(n), lists], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                at += int(n.sum())
            pa.default_memory_pool().release_unused()
        encoder.make_room(encoder.most // 6)  # the worker lives on into stages of other kinds

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = own.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_batches(docs.sparkSession, ROWS):
        ordered.mapInArrow(encode, WRITTEN).write.options(**PARQUET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows ``doc_id, start, n_tokens, ids``; start counts the ids of all rows before.

    One total for each file is added up over ranges of files and joined; only counts are read for that.
    """
    rows = spark.read.schema(WRITTEN).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    summed = running_sum(totals, "n", ["shard"], F.floor(F.col("shard") / 1000), out="upto")
    bases = materialize(summed.select(F.col("shard").alias("_shard"), (F.col("upto") - F.col("n")).alias("_base")), "bases")
    based = lookup_join(rows, bases, F.col("shard") == F.col("_shard"))
    return based.select("doc_id", (F.col("_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def crc32(ids):
    """Unsigned CRC-32 of each list's ids as little-endian 32-bit integers."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def compute(column):
        import numpy as np
        import pyarrow as pa

        flat, at = np.ascontiguousarray(column.flatten().to_numpy(), "<u4"), 0
        out = np.empty(len(column), np.int64)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            out[i] = zlib.crc32(flat[at : at + n])
            at += n
        return pa.array(out)

    return compute(ids)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs``, read the files back; one row for each written row: doc_id, start, n_tokens, ids_crc32.

    These rows are written too, so that the ids meet Python in batches of bounded rows, whoever reads the result.
    """
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write(docs, path)
    counted = read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", crc32("ids").alias("ids_crc32"))
    return materialize(counted, "token-counts", batch=ROWS)
