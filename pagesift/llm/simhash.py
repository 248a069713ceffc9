"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less share a point that is at distance 1 or less from both. So each distinct
fingerprint emits itself and its 64 one-bit variants; rows are shuffled on the variant, and fingerprints that meet
are tied to the smallest of them. A variant has at most 65 fingerprints, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.graph import connected_components
from ..plans.storage import arrow_batches, discard, lookup_join, materialize
from .common import ROWS, as_bytes

SEED = 42
RADIUS = 2
#: Shingles are counted into so many buckets to take rare ones first; the order changes the work, not the result.
BUCKETS = 1 << 18
#: Rounds in which classes that share a shingle are tied to one of them, before all possible pairs left are tried.
STARS = 4
#: After a round that leaves more than this share of the rows of shared shingles, the rounds left are not worth their shuffles.
WORTH = 0.95
#: Ids of dropped documents that may be broadcast; 16 MB of them.
GONE_ROWS = 2_000_000
#: Bits of the parity map by which pairs of sets that differ too much are told before their shingles are read. Sets of
#: more shingles, which fill it, have a second one that grows with them.
MAP_BITS = 1 << 9
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 15


def _majority(every) -> int:
    """A bit is set if it is set in over half of the unsigned 64-bit hashes."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for i in range(0, len(every), _BLOCK):
        counts += np.unpackbits(every[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(every), bitorder="little").view("<u8")[0])


def fingerprint_of(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text: a bit is set if it is set in over half the shingles' XXH64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    own = text.translate(_LOWER).split() if text else []
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends, at = [], -1
        for w in own:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]
    return _majority(np.array(hashes, dtype="<u8"))


def fingerprint(text: Column | str, width: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null and blank texts have zero."""

    @arrow_udf("long")
    def compute(column):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.array([fingerprint_of(t, width) for t in as_bytes(column)], dtype=np.uint64).view(np.int64))

    return compute(text)


def _variants(fp: str) -> Column:
    """A fingerprint and all that differ from it in one bit."""
    one = F.lit(1).cast("long")
    return F.concat(F.array(F.col(fp)), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col(fp).bitwiseXOR(F.call_function("shiftleft", one, i))))


def links(prints: DataFrame) -> DataFrame:
    """Verified links ``(a, b, distance)`` that connect all values of ``fp``, one row each, within distance 2.

    Of the fingerprints that meet on a variant each is tied to the smallest; all of them are within distance 2 of
    one another, so no component is split and no pairs of a group are emitted beyond those.
    """
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("fp").repartition(spread, "fp")  # 65 rows come out of each
    met = distinct.select("fp", F.explode(_variants("fp")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = met.select("fp", least.alias("a")).where("fp > a").select("a", F.col("fp").alias("b")).distinct()
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= RADIUS)


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of rows ``node, fp``: rows of a fingerprint tied to its smallest node, those of linked ones to each other."""
    heads = materialize(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    named = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias({"a": "x", "b": "y"}[c]))
    linked = links(heads).join(named("a"), "a").join(named("b"), "b").select("x", "y")
    return equal.union(linked).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows ``(doc_id, fp, component_id)``: component_id is the smallest doc_id reachable over links.

    One row for each row of ``docs``. Texts without words (null, empty, blank) share the fingerprint zero and are
    linked like any other. Rows with a null ``doc_id`` take part; a component of only such rows has a null id.
    """
    prints = materialize(docs.select("doc_id", fingerprint("text", width).alias("fp")), "fingerprints", batch=ROWS)
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    tied = connected_components(links(classes), "a", "b")
    named = classes.join(tied, classes.fp == tied.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    roots = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = materialize(named.join(roots, "component").select("fp", "component_id"), "components")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, fingerprint in hexadecimal, component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(texts, width: int):
    """For each text: the digest of its lower-case word sequence, and its distinct word shingles as sorted hashes.

    The whole sequence is the shingle where it is shorter; a text without words has none.
    """
    import numpy as np
    from xxhash import xxh3_128_digest, xxh64_intdigest

    for text in texts:
        own = text.translate(_LOWER).split() if text else []
        grams = {b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else ()
        yield xxh3_128_digest(b" ".join(own)), np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))).view(np.int64)


def _bucket_counts(docs: DataFrame, width: int):
    """Shingles counted into a table of fixed size by their low bits; a task sends at most one count for each bucket."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, own in _sets(as_bytes(batch.column(0)), width):
                np.add.at(total, own & (BUCKETS - 1), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])

    with arrow_batches(docs.sparkSession, ROWS):
        found = docs.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[found["b"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 31) - 1)
    return counts


def _measured(text: str, width: int, counts, similarity: float) -> Column:
    """Of each text: the digest of its words, the number of shingles, their SimHash and parity maps, and its prefix.

    A bit of a map tells whether an odd number of shingles falls on it, so two maps differ in no more bits than the
    sets in shingles. ``wide`` is a map of as many bits as shingles, up to the next power of two, and null where
    ``map`` has as many. The prefix has the rarest shingles, as many as must hold one that any set of that similarity has
    in its own, as 32-bit hashes: equal ones stay equal, and verification comes last.
    """

    @arrow_udf("key binary, n int, fp long, map array<long>, wide binary, prefix array<int>")
    def compute(column):
        import math

        import numpy as np
        import pyarrow as pa

        def parity(own, bits):
            return np.packbits((np.bincount(own >> 32 & (bits - 1), minlength=bits) & 1).astype(np.uint8))

        keys, sizes, prints, maps, wides, prefixes = [], [], [], [], [], []
        for key, own in _sets(as_bytes(column), width):
            take = len(own) - math.ceil(similarity * len(own) - 1e-6) + 1 if len(own) else 0
            keys.append(key)
            sizes.append(len(own))
            prints.append(_majority(own))
            maps.append(parity(own, MAP_BITS).view(np.int64))
            wides.append(parity(own, 1 << (len(own) - 1).bit_length()).tobytes() if len(own) > MAP_BITS else None)
            prefixes.append(own[np.lexsort((own, counts[own & (BUCKETS - 1)]))[:take]].astype(np.int32))
        made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(maps, pa.list_(pa.int64()))]
        made += [pa.array(wides, pa.binary()), pa.array(prefixes, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(made, names=["key", "n", "fp", "map", "wide", "prefix"])

    return compute.asNondeterministic()(text)  # so that no rewrite evaluates it more than once


def _shingles(text: str, width: int) -> Column:
    """The digest of each text's words and its shingles."""

    @arrow_udf("key binary, grams array<long>")
    def compute(column):
        import pyarrow as pa

        made = list(_sets(as_bytes(column), width))
        return pa.StructArray.from_arrays([pa.array([k for k, _ in made], pa.binary()), pa.array([g for _, g in made], pa.list_(pa.int64()))], names=["key", "grams"])

    return compute.asNondeterministic()(text)


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether two sets' sizes ``n`` and parity maps ``map``, at the prefixes ``a`` and ``b``, leave the similarity possible."""
    apart = F.expr(" + ".join(f"bit_count({a}.map[{i}] ^ {b}.map[{i}])" for i in range(MAP_BITS // 64)))
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-6) & (apart * (1 + similarity) <= (1 - similarity) * (m + n) + 1e-6)


def _wide_apart(a: str, b: str) -> Column:
    """In how many bits two wide maps differ, the longer one folded to the other's length; null where one is missing."""

    @arrow_udf("long")
    def compute(x, y):
        import numpy as np
        import pyarrow as pa

        def differ(p, q):
            p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
            if len(p) < len(q):
                p, q = q, p
            while len(p) > len(q):
                p = p[: len(p) // 2] ^ p[len(p) // 2 :]
            return int(np.bitwise_count(p ^ q).sum(dtype=np.int64))

        both = zip(x.to_pylist(), y.to_pylist())
        return pa.array([None if p is None or q is None else differ(p, q) for p, q in both], pa.int64())

    return compute(a, b)


def _widely_possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` whose wide maps, where both have one, leave the similarity possible."""
    wide = maps.where("wide IS NOT NULL")
    named = lambda x: wide.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    both = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    enough = _wide_apart("wa", "wb") * (1 + similarity) <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-6
    return both.where(F.coalesce(enough, F.lit(True))).select(*pairs.columns)


def _possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs``, from ``a`` to ``b``, whose sizes and parity maps leave the similarity possible."""
    named = lambda x: maps.select(F.col("row").alias(x), F.struct("n", "map").alias(f"m{x}"))
    both = lookup_join(lookup_join(pairs, named("a"), "a"), named("b"), "b")
    return both.where(_fits("ma", "mb", similarity)).select(*pairs.columns)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` of classes whose shingle sets have the similarity; only their texts are read again."""
    nodes = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(classes, F.col("d") == F.col("node")).select("node", F.col("rep").alias("doc_id"), F.col("key").alias("own")), "wanted")
    again = lookup_join(docs, wanted, "doc_id").select("node", "own", _shingles("text", width).alias("v"))
    grams = materialize(again.where("v.key = own").select("node", "v.grams"), "grams", batch=ROWS)
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    good = materialize(both.where(shared >= similarity * (F.size("ga") + F.size("gb") - shared)).select("a", "b"), "good")
    for used in (wanted, grams):
        discard(used)
    return good


def _led(live: DataFrame, k: int, several: bool = False) -> DataFrame:
    """Rows of shared shingles with ``first``, the leader of each shingle in round ``k``; ``several`` keeps shingles of two components or more.

    Both come from one window, so a round shuffles these rows once. All rows of a shingle stay or go together.
    """
    by_gram = Window.partitionBy("g")
    turn = F.lit(0).cast("long") if k == 0 else F.xxhash64("node", "g", F.lit(k))
    led = live.withColumn("first", F.min(F.struct(turn.alias("turn"), "comp", "node", "n", "pos")).over(by_gram))
    if not several:
        return led
    return led.withColumn("_l", F.min("comp").over(by_gram)).withColumn("_m", F.max("comp").over(by_gram)).where("_l < _m").drop("_l", "_m")


def _enough(m: Column, i: Column, n: Column, j: Column, similarity: float) -> Column:
    """Whether sets of ``m`` and ``n`` shingles that share one at places ``i`` and ``j`` can share enough of them.

    At most so many are shared as stand before the common one in both, and after it.
    """
    most = F.least(i, j) + F.least(m - i, n - j)
    return most * (1 + similarity) >= similarity * (m + n) - 1e-6


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows ``(doc_id, component_id)``, one for each doc_id: near-duplicates by shingle similarity share a component.

    Classes whose SimHashes of the distinct shingles differ in 2 bits or fewer (``links``) are verified first. But a SimHash
    moves by many bits where the Jaccard similarity of five-word shingles is still 0.8, far beyond a radius that can be
    emitted. So an exact set-similarity join finds the rest: two sets of that similarity share
    one of their rarest shingles, whose number is fixed by the size, and every pair that does is either already
    connected or verified, unless sizes or parity maps rule it out. Texts of equal words are one class. Classes that
    share a shingle are first tied to one of them, another one in each of a few rounds; then all possible pairs
    between different components are tried, so a large group of near copies is not expanded into its pairs; rounds end early where one joined few classes. Shingles are not written: texts are shingled once
    to count, once for the prefixes, and those of candidates again to verify, and these go once a round is verified. Documents below the similarity are never joined but through others. Rows with a
    null doc_id are left out.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    seen = docs.select("doc_id", _measured("text", width, _bucket_counts(docs, width), similarity).alias("v")).select("doc_id", "v.*")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "shingles", batch=ROWS)
    least = F.min(F.struct("doc_id", "row")).alias("m")
    classes = materialize(seen.groupBy("key").agg(least).select("key", F.col("m.doc_id").alias("rep"), F.col("m.row").alias("node")), "classes")
    maps = seen.select("row", "n", "map", "wide")
    own = lookup_join(seen.select("row", "n", "prefix"), classes.select("node"), F.col("row") == F.col("node"), max_rows=1_000_000)
    each = own.select("node", "n", F.posexplode("prefix").alias("pos", "g"))
    live = materialize(each.withColumn("_c", F.count("*").over(Window.partitionBy("g"))).where("_c > 1").drop("_c").withColumn("comp", F.col("node")), "shared")
    good = tried = tied = None
    rounds, ahead = [*range(-1, STARS + 1)], None
    while rounds:
        k = rounds.pop(0)
        star = k < STARS
        if k < 0:
            prints = materialize(seen.select("row", "fp").join(classes.select("node"), F.col("row") == F.col("node")).select("node", "fp"), "prints")
            pairs = fingerprint_pairs(prints)
        elif star:
            # each shingle has a leader, another one in each round; a class tries 1, 2, 4, 8 leaders of its shingles
            led = live if ahead == k else _led(live.drop("first"), k)
            one = "first."
            met = led.where(F.col("comp") != F.col("first.comp")).where(_enough(F.col("n"), F.col("pos"), F.col(one + "n"), F.col(one + "pos"), similarity))
            pairs = met.select(F.least("node", one + "node").alias("a"), F.greatest("node", one + "node").alias("b"), F.col("node").alias("from"))
        else:
            # sizes and maps are compared inside the join, so a frequent shingle yields no pairs but possible ones
            mapped = live.drop("first").join(maps.select(F.col("row").alias("node"), "map"), "node")
            x, y = mapped.alias("x"), mapped.alias("y")
            enough = _enough(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), similarity)
            met = F.expr("x.g = y.g AND x.node < y.node AND x.comp <> y.comp")
            pairs = x.join(y, met & enough & _fits("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if k < 0:
            pairs = _widely_possible(_possible(pairs, maps, similarity), maps, similarity)
        elif star:
            turn = F.row_number().over(Window.partitionBy("from").orderBy(F.xxhash64("a", "b")))
            pairs = _widely_possible(_possible(pairs, maps, similarity), maps, similarity).withColumn("turn", turn).where(F.col("turn") <= 1 << k)  # the others are tried in the end
            pairs = pairs.select("a", "b").distinct()
        else:
            pairs = _widely_possible(pairs, maps, similarity)
        pairs = materialize(pairs, "pairs", batch=ROWS)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = _verified(pairs, classes, docs, width, similarity)
        if found.isEmpty():
            continue
        good = found if good is None else good.union(found)
        tied = connected_components(good, "a", "b")
        if star:
            renamed = live.drop("comp", "first").join(tied, "node", "left")
            renamed = renamed.withColumn("comp", F.coalesce("component", "node")).drop("component")
            ahead = k + 1
            earlier, live = live, materialize(_led(renamed, ahead, several=True), "shared")
            if k >= 0 and live.count() > WORTH * earlier.count():
                rounds = [STARS]
            discard(earlier)
    named = classes.join(tied, "node", "left") if tied is not None else classes.withColumn("component", F.col("node"))
    named = materialize(named.select("key", "rep", F.coalesce("component", "node").alias("component")), "named")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    keys = materialize(named.join(ids, "component").select("key", "component_id"), "ids")
    groups = materialize(seen.select("doc_id", "key").join(keys, "key").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "groups")
    for used in (seen, classes, live, named, keys):
        discard(used)
    return groups


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one document of each group of ``near_duplicates``: that of its smallest doc_id.

    Rows with a null doc_id are kept; repeated rows of a kept doc_id all stay, as they cannot be told apart by id.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width, similarity)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id"), "gone")
    return lookup_join(docs, gone, "doc_id", "left_anti", max_rows=GONE_ROWS).select(*docs.columns)  # texts stay where they are
