"""Line deduplication by an exact set-similarity join.

Lines are sets of lower-case words. Each line's words are ordered from the rarest to the most frequent; two lines
with a Jaccard similarity of 0.8 or more must share a word among the first few of both (prefix filter). Lines that
meet on such a word are compared by length, by the words' places and by a 64-bit parity map of the whole sets, all
of which only drop pairs that cannot be similar; what is left is verified on the words themselves. A line is
removed if an earlier line is equal or similar to it.

Near copies are not compared pair by pair. A line joins the group of one line that it is like, its pivot; within
a group two lines differ in the words in which exactly one of them differs from the pivot. So links between lines that are
near enough to the pivot are counted from a histogram of the group, and others need a common change; see ``grouped``.

Only DataFrame functions are used. Equal lines are one class, represented by its first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.storage import discard, lookup_join, materialize
from .common import WORD, fresh

#: Entries of the table of word frequencies: words are hashed to them.
BUCKETS = 1 << 18
_LOW = (1 << 56) - 1
#: Lines of more words get a second parity map, as the first alone passes one in 10,000 other lines or more.
FULL = 80
#: Pairs are verified in so many parts, one after another, as each pair carries a line's words through a shuffle.
PARTS = 4


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of all lines that have a word; line_no counts all lines of the text from 0."""
    cut = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.where(F.col("line").rlike(WORD))


def _spaced(text: Column, blanks: str = "\t\x0b\x0c\r") -> Column:
    """The text with other blanks as spaces."""
    for b in blanks:
        text = F.replace(text, F.lit(b), F.lit(" "))  # gives back texts without any, nearly all, as they are
    return text


def word_hashes(line: Column) -> Column:
    """The distinct words of a line as 64-bit hashes."""
    words = F.split(F.lower(_spaced(line)), " ")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def line_key() -> list[Column]:
    """Two independent hashes of a line, 128 bits together."""
    bare = F.trim(_spaced(F.col("line")))
    return [F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2")]


def frequency_table(docs: DataFrame, buckets: int = BUCKETS) -> bytes:
    """One byte for each hash bucket of words: 4 log2(1 + occurrences in all texts), plus 1.

    Tasks send at most one count for each bucket; the table has a fixed size. A word with capitals is counted by
    itself, which only shifts the order of words.
    """
    words = docs.select(F.explode(F.split(_spaced(F.col("text"), "\n\t\x0b\x0c\r"), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(buckets - 1).alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.union(docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n")))
    ranks = every.groupBy("bucket").agg(F.least(F.floor(4 * F.log2(1.0 + F.sum("n"))), F.lit(126)).alias("rank"))
    joined = ranks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "rank"))), lambda x: F.char(x["rank"] + 1)), "").alias("t"))
    return joined.first().t.encode("ascii")


def ordered_words(line: Column, table: bytes) -> Column:
    """The distinct words of a line, rarest first, as longs: 7 bits of frequency, 56 of hash."""
    ranks = F.from_json(F.lit(str([b - 1 for b in table])), "array<bigint>")  # folded into one literal
    low = len(table) - 1

    def key(h):
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(low).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(rank, 56).bitwiseOR(h.bitwiseAND(_LOW))

    return F.sort_array(F.transform(word_hashes(line), key))


def _parity(shift: int) -> Column:
    """64 bits, each the parity of the number of words whose hash has its place in six bits from ``shift``."""
    one = F.lit(1).cast("long")
    place = lambda w: (F.shiftright(w, shift) if shift else w).bitwiseAND(63).cast("int")
    return F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one, place(w))))


def representatives(cut: DataFrame, table: bytes) -> DataFrame:
    """The first line of each class: ``doc_id, line_no, k1, k2, n`` (words), ``map`` and ``wide`` (parity), ``prefix`` (words to meet on)."""
    keyed = cut.select("doc_id", "line_no", *line_key(), ordered_words(F.col("line"), table).alias("words"))
    n = F.size("words")
    prefix = F.slice("words", F.lit(1), n - F.ceil(n * 4 / F.lit(5)).cast("int") + 1)
    short = F.transform(prefix, lambda w: w.bitwiseAND((1 << 31) - 1).cast("int"))  # equal words stay equal; verification comes last
    made = keyed.select("doc_id", "line_no", "k1", "k2", n.alias("n"), _parity(0).alias("map"), F.when(n > FULL, _parity(6)).otherwise(F.lit(0)).alias("wide"), short.alias("prefix"))
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc_id", "line_no"))
    return made.withColumn("_r", first).where("_r = 1").drop("_r")


def pivots(reps: DataFrame) -> DataFrame:
    """For lines that may be like the first line with many of their prefix's words: ``d, l`` and that line ``gd, gl``.

    It must lead a third of the words of the line's prefix; of several such lines the one that leads most is taken. A
    word's first line comes from an aggregate that combines before its shuffle, and each line has one row at most. Which
    lines are tied changes the work, not the result.
    """
    met = reps.select("doc_id", "line_no", "n", F.size("prefix").alias("k"), F.explode("prefix").alias("word"))
    first = met.groupBy("word").agg(F.min(F.struct("doc_id", "line_no", "n")).alias("p"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    possible = F.expr("(doc_id <> p.doc_id OR line_no <> p.line_no) AND 4 * n <= 5 * p.n AND 4 * p.n <= 5 * n")
    tried = met.join(first, "word").where(possible).groupBy("doc_id", "line_no", F.col("p.doc_id").alias("gd"), F.col("p.line_no").alias("gl"))
    often = tried.agg(F.count("*").alias("c"), F.first("k").alias("k")).where("3 * c >= k")
    best = often.groupBy("doc_id", "line_no").agg(F.max(F.struct("c", -F.col("gd"), -F.col("gl"), "gd", "gl")).alias("b"))
    return best.select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "b.gd", "b.gl")


def words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, line_no, words`` of the wanted lines ``d, l``, read from the texts again."""
    listed = materialize(wanted.groupBy("d").agg(F.collect_set("l").alias("ls")), "wanted")
    texts = lookup_join(docs.select("doc_id", "text"), listed, F.col("doc_id") == F.col("d"), max_rows=500_000)
    lined = texts.select("doc_id", F.explode("ls").alias("line_no"), F.split("text", "\n").alias("all"))
    made = lined.select("doc_id", "line_no", word_hashes(F.get("all", F.col("line_no"))).alias("words")).dropDuplicates(["doc_id", "line_no"])
    made = materialize(made, "lines")
    discard(listed)
    return made


def members(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Lines with a pivot, and these pivots: ``d, l, gd, gl, changes`` (hashes of the words in which the two differ), ``s``.

    A line may differ from its pivot in twice as many words as similar lines do: what holds in a group holds for any pivot.

    ``s`` is 9 times their number less the line's words, so that two lines whose sets differ in x words are similar if
    9 x is no more than their words together. A pivot that has one itself stays with that.
    """
    tied = materialize(pivots(reps), "pivots")
    words = words_of(docs, tied.select("d", "l").union(tied.select("gd", "gl")))
    one = words.select(F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.col("words").alias("w1"))
    two = words.select(F.col("doc_id").alias("gd"), F.col("line_no").alias("gl"), F.col("words").alias("w2"))
    changes = F.concat(F.array_except("w1", "w2"), F.array_except("w2", "w1"))
    both = tied.join(one, ["d", "l"]).join(two, ["gd", "gl"])
    told = both.select("d", "l", "gd", "gl", F.sort_array(changes).alias("changes"), F.size("w1").alias("n"), F.size("w2").alias("m"))
    near = told.where(9 * F.size("changes") <= 2 * (F.col("n") + F.col("m"))).select("d", "l", "gd", "gl", "changes", (9 * F.size("changes") - F.col("n")).alias("s"))
    near = materialize(near, "near")
    heads = near.select("gd", "gl").distinct().join(near.select(F.col("d").alias("gd"), F.col("l").alias("gl")), ["gd", "gl"], "left_anti")
    sized = heads.join(reps.select(F.col("doc_id").alias("gd"), F.col("line_no").alias("gl"), "n"), ["gd", "gl"])
    alone = sized.select(F.col("gd").alias("d"), F.col("gl").alias("l"), "gd", "gl", F.array().cast("array<bigint>").alias("changes"), (-F.col("n")).alias("s"))
    found = materialize(near.union(alone), "members")
    for used in (tied, words, near):
        discard(used)
    return found


def grouped(own: DataFrame) -> DataFrame:
    """Links between lines of one group: ``d, l, n_links, later``.

    Two lines of a group differ in as many words as both have changes, less twice the changes they share. So if their ``s``
    add up to 0 or less they are similar: such lines are counted by running sums over the group's values of ``s``. If
    not, they must share a change, and 18 times the changes they share must reach that sum; those pairs meet at the
    first change that they share.
    """
    at = F.struct("d", "l")
    counts = own.groupBy("gd", "gl", "s").agg(F.count("*").alias("n"), F.min(at).alias("least"))
    # a line asks at -s for all lines up to there: lines come before questions of the same place
    steps = counts.select("gd", "gl", F.col("s").alias("place"), F.lit(0).alias("asks"), "n", "least")
    steps = steps.union(counts.select("gd", "gl", (-F.col("s")).alias("place"), F.lit(1).alias("asks"), F.lit(0).cast("long"), F.lit(None).cast(counts.schema["least"].dataType)))
    upto = Window.partitionBy("gd", "gl").orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = steps.select("gd", "gl", (-F.col("place")).alias("s"), "asks", F.sum("n").over(upto).alias("n"), F.min("least").over(upto).alias("least")).where("asks = 1").drop("asks")
    itself = (F.col("s") <= 0).cast("long")
    sure = own.select("d", "l", "gd", "gl", "s").join(told, ["gd", "gl", "s"]).select("d", "l", (F.col("n") - itself).alias("n"), F.coalesce(F.col("least") < at, F.lit(False)).alias("later"))
    changed = own.where("size(changes) > 0").select("d", "l", "gd", "gl", "s", "changes", F.explode("changes").alias("change"))
    meet = F.expr(
        """a.gd = b.gd AND a.gl = b.gl AND a.change = b.change AND (a.d < b.d OR (a.d = b.d AND a.l < b.l)) AND a.s + b.s > 0
        AND 18 * least(size(a.changes), size(b.changes)) >= a.s + b.s
        AND 18 * size(array_intersect(a.changes, b.changes)) >= a.s + b.s AND array_intersect(a.changes, b.changes)[0] = a.change"""
    )
    other = changed.alias("a").join(changed.alias("b"), meet).select(F.col("a.d").alias("d1"), F.col("a.l").alias("l1"), F.col("b.d").alias("d2"), F.col("b.l").alias("l2"))
    ends = ends_of(materialize(other, "changed"))
    return sure.union(ends.select("d", "l", F.lit(1).cast("long"), "later")).groupBy("d", "l").agg(F.sum("n").alias("n_links"), F.bool_or("later").alias("later"))


def candidates(reps: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of representatives ``(d1, l1, d2, l2)`` that are not of one group, the first one earlier, that pass all filters.

    At the first word that two lines share, no more words are shared than either has from there on; so that bound is
    the filter, and many pairs that meet again on later words fail it there.
    """
    named = lookup_join(reps, own.select(F.col("d").alias("doc_id"), F.col("l").alias("line_no"), "gd", "gl"), ["doc_id", "line_no"], "left")
    met = named.select("doc_id", "line_no", "gd", "gl", "n", "map", "wide", F.posexplode("prefix").alias("i", "word"))  # dealt out by the join, which splits hot words
    need = "((4 * (a.n + b.n) + 8) div 9)"
    filters = F.expr(
        f"""a.word = b.word AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line_no < b.line_no))
        AND NOT (a.gd <=> b.gd AND a.gl <=> b.gl AND a.gd IS NOT NULL)
        AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n AND least(a.n - a.i, b.n - b.i) >= {need}
        AND bit_count(a.map ^ b.map) <= a.n + b.n - 2 * {need}
        AND (least(a.n, b.n) <= {FULL} OR bit_count(a.wide ^ b.wide) <= a.n + b.n - 2 * {need})"""
    )
    ends = (F.col(f"{x}.{c}").alias(f"{c[0]}{k}") for k, x in ((1, "a"), (2, "b")) for c in ("doc_id", "line_no"))
    return met.alias("a").join(met.alias("b"), filters).select(*ends).distinct()


def links(docs: DataFrame, reps: DataFrame, own: DataFrame) -> DataFrame:
    """All pairs of different classes, not of one group, with a Jaccard similarity of 0.8 or more, by representatives: d1, l1, d2, l2."""
    pairs = materialize(candidates(reps, own), "candidates")
    words = words_of(docs, pairs.select(F.col("d1").alias("d"), F.col("l1").alias("l")).union(pairs.select("d2", "l2")))
    one = words.select(F.col("doc_id").alias("d1"), F.col("line_no").alias("l1"), F.col("words").alias("w1"))
    two = words.select(F.col("doc_id").alias("d2"), F.col("line_no").alias("l2"), F.col("words").alias("w2"))
    found = None
    for k in range(PARTS):
        mine = F.pmod(F.xxhash64("d1", "l1"), F.lit(PARTS)) == k
        both = pairs.where(mine).join(one.where(mine), ["d1", "l1"]).join(two, ["d2", "l2"])
        similar = both.where(9 * F.size(F.array_intersect("w1", "w2")) >= 4 * (F.size("w1") + F.size("w2"))).select("d1", "l1", "d2", "l2")
        similar = materialize(similar, "links")
        found = similar if found is None else found.union(similar)
    for used in (pairs, words):
        discard(used)
    return found


def ends_of(found: DataFrame) -> DataFrame:
    """Both ends ``d, l`` of each link, and whether that one is the later."""
    return found.select(F.col("d1").alias("d"), F.col("l1").alias("l"), F.lit(False).alias("later")).union(found.select("d2", "l2", F.lit(True)))


def judged_lines(docs: DataFrame) -> DataFrame:
    """Each line with a word: ``doc_id, line_no, n_links`` (similar classes) and ``removed``."""
    cut = lines(docs)
    reps = materialize(representatives(cut, frequency_table(docs)), "representatives")
    own = members(docs, reps)
    ends = ends_of(links(docs, reps, own)).select("d", "l", F.lit(1).cast("long").alias("n_links"), "later")
    linked = ends.union(grouped(own)).groupBy("d", "l").agg(F.sum("n_links").alias("n_links"), F.bool_or("later").alias("later"))
    firsts = reps.select("k1", "k2", F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    classes = materialize(firsts.join(linked, ["d", "l"], "left"), "classes")
    out = cut.select("doc_id", "line_no", *line_key()).join(classes, ["k1", "k2"])
    again = (F.col("d") != F.col("doc_id")) | (F.col("l") != F.col("line_no"))
    return out.select("doc_id", "line_no", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (again | F.coalesce("later", F.lit(False))).alias("removed"))


def report(docs: DataFrame) -> DataFrame:
    """One row for each doc_id that has a line with a word: n_lines (those lines), n_removed, n_links, removed_lines."""
    judged = judged_lines(docs.select("doc_id", "text"))
    gone = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.array_join(F.transform(gone, lambda x: x.cast("string")), ",").alias("removed_lines"),
    )


def remove(docs: DataFrame) -> DataFrame:
    """The documents without removed lines; other lines, rows and columns stay as they are.

    Rows with a null doc_id or text stay whole. Blank lines are never removed.
    """
    own = fresh(docs, "_gone")
    gone = judged_lines(docs.select("doc_id", "text")).where("removed").groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")).select(F.struct("doc_id", "lines").alias(own))
    joined = docs.join(gone, F.col("doc_id") == F.col(f"{own}.doc_id"), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(f"{own}.lines", i))
    return joined.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
