"""Text and vector features: TF-IDF, truncated SVD, block scaling, class weights, batch embedding."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import l2_normalize
from ..plans.storage import CLEANUP, lookup_join, materialize, settings, spread
from .sparse import Rows

TOKEN = r"[\p{L}\p{N}_]{2,}+"  # possessive: the same words without steps to go back
#: Parts by key for each part of the texts, so that a task's terms do not grow with the table.
SHARE = 8


def with_tokens(docs: DataFrame, text="text", out="t") -> DataFrame:
    """Add ``out``: the lower-case words of two or more characters, then the pairs of neighbouring words; none for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    pairs = F.when(F.size(out) > 1, F.zip_with(F.slice(out, F.lit(1), F.size(out) - 1), F.slice(out, F.lit(2), F.size(out) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("cast(array() as array<string>)"))
    return docs.withColumn(out, words).withColumn(out, F.concat(out, pairs))


def token_lists(docs: DataFrame, key="page_id", text="text") -> DataFrame:
    """``key, t``: the words and pairs of each text that is not null."""
    return with_tokens(docs.where(F.col(text).isNotNull()).select(key, text), text).select(key, "t")


def exploded(docs: DataFrame, key="page_id", text="text") -> DataFrame:
    """``key, term``: a row for each word and pair. Spark would filter by the lists' sizes before ``explode``, and so make them twice."""
    return token_lists(docs, key, text).select(key, F.explode_outer("t").alias("term")).where("term IS NOT NULL")


def terms(docs: DataFrame, key="page_id", text="text") -> DataFrame:
    """Long form ``key, term, tf`` of the words and pairs of each text."""
    return exploded(docs, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


@dataclass
class Tfidf:
    """A fitted vocabulary; ``vocab`` has term, tf, df, idf, rank."""

    vocab: DataFrame
    key: str
    text: str

    def cells(self, docs: DataFrame) -> DataFrame:
        """``key, norm, cells``: each text's known terms as ``(rank, w)`` with w = tf * idf, and their norm.

        Terms that the vocabulary lacks go before the only exchange, which is by key: the counts, weights and norm of a
        text are then made in place.
        """
        known = lookup_join(exploded(docs, self.key, self.text), self.vocab.select("term", "idf", "rank"), "term")
        counted = known.select(self.key, "rank", "idf").repartition(SHARE * max(1, docs.rdd.getNumPartitions()), self.key).groupBy(self.key, "rank").agg((F.count("*") * F.max("idf")).alias("w"))
        return counted.groupBy(self.key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("rank", "w")).alias("cells"))

    def transform(self, docs: DataFrame) -> DataFrame:
        """Long form ``key, term, rank, tfidf``, L2-normalised by row; rows without known terms have none."""
        long = self.cells(docs).select(self.key, "norm", F.inline("cells"))
        named = lookup_join(long, self.vocab.select("rank", "term"), "rank")
        return named.select(self.key, "term", "rank", (F.col("w") / F.col("norm")).alias("tfidf"))

    def vectors(self, docs: DataFrame, size: int | None = None) -> DataFrame:
        """Add ``features``, one sparse vector for each row of ``docs``, zero without known terms: all map-side, in the JVM.

        The vocabulary, at most the terms it was fitted for, is sent along; ``size`` widens the vectors.
        """
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        rows = self.vocab.orderBy("rank").select("term", "idf").collect()
        more = max(1, size or 0) - len(rows)
        names, idf = [r.term for r in rows] + [f"\0{k}" for k in range(more)], [r.idf for r in rows] + [0.0] * max(0, more)
        listed = with_tokens(docs, self.text, "_t")
        counted = CountVectorizerModel.from_vocabulary(names, inputCol="_t", outputCol="_tf").transform(listed)
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_x").transform(counted)
        return Normalizer(p=2.0, inputCol="_x", outputCol="features").transform(weighed).drop("_t", "_tf", "_x")


def vocab_stats(train: DataFrame, key="page_id", text="text", min_df: int = 2, top: int = 30_000) -> DataFrame:
    """``term, tf, df, idf, rank`` of the ``top`` terms by total count (ties by term) in at least ``min_df`` rows.

    idf is ln((1 + n) / (1 + df)) + 1 with n the rows of ``train``, each of which is a document of its own. Both counts
    combine before the one exchange, which is by term.
    """
    from pyspark.sql import Window

    n = train.count()
    both = token_lists(train, key, text).select(F.size("t").alias("n"), F.posexplode_outer(F.concat("t", F.array_distinct("t"))).alias("at", "term"))
    counts = both.where("term IS NOT NULL").groupBy("term").agg(F.count_if(F.col("at") < F.col("n")).alias("tf"), F.count_if(F.col("at") >= F.col("n")).alias("df")).where(F.col("df") >= min_df)
    best = counts.orderBy(F.desc("tf"), "term").limit(top)
    out = best.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tf"), "term")))
    return materialize(out, "vocab")


def fit_tfidf(train: DataFrame, key="page_id", text="text", min_df: int = 2, top: int = 30_000) -> Tfidf:
    """Fit on train only."""
    return Tfidf(vocab_stats(train, key, text, min_df, top), key, text)


@dataclass
class Svd:
    """Right singular vectors of the train rows (an array of features x k) and the singular values, not centred."""

    v: object
    singular: list

    def transform(self, df: DataFrame, features="features", out="svd") -> DataFrame:
        """Add the projection of each row as an array of doubles: one Arrow pass over the cells that are not zero."""
        from pyspark.sql.functions import arrow_udf

        sent = df.sparkSession.sparkContext.broadcast(self.v)

        @arrow_udf("array<double>")
        def project(column):
            import numpy as np
            import pyarrow as pa

            v = sent.value
            placed = np.concatenate([np.zeros((0, v.shape[1])), *(part.times(v) for _, part in Rows(column).parts(len(v)))])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(placed) + 1, dtype=np.int32) * v.shape[1]), pa.array(placed.ravel()))

        return df.withColumn(out, project(features))


#: Places of a matrix that are added up and sent as one, and the rows that they are sent as.
SLAB = 512
SLABS = "slab int, z binary"


def summed(parts: DataFrame, shape: tuple[int, int]):
    """The sum of matrices that come in rows ``slab, z`` of ``SLAB`` places each: tasks add up slabs as a stream."""
    import numpy as np

    def added(batches):
        import pyarrow as pa

        slab, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slab", "z"])
        for batch in batches:
            for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(z)
                if k != slab:
                    if slab is not None:
                        yield done()
                    slab, total = k, np.zeros(len(part))
                total += part
        if slab is not None:
            yield done()

    with settings(parts.sparkSession, {CLEANUP: "true"}):
        slabs = parts.repartition("slab").sortWithinPartitions("slab").mapInArrow(added, SLABS).toArrow()
    z = np.zeros(shape)
    for k, part in zip(slabs["slab"].to_pylist(), slabs["z"]):
        z[k * SLAB : (k + 1) * SLAB] = np.frombuffer(part.as_buffer()).reshape(-1, shape[1])
    return z


def in_slabs(z):
    """A task's matrix as batches for ``summed``."""
    import pyarrow as pa

    for k in range(0, len(z), SLAB):
        yield pa.RecordBatch.from_arrays([pa.array([k // SLAB], pa.int32()), pa.array([z[k : k + SLAB].tobytes()], pa.binary())], names=["slab", "z"])


def by_core(rows: DataFrame) -> DataFrame:
    """``rows`` in no more than two parts a core: each part sends a whole matrix, however many rows it has."""
    most = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def _gram_times(rows: DataFrame, v):
    """A'A v for the vectors A of ``rows``: each task adds up its own, tasks are added by slabs of ``SLAB`` places."""
    import numpy as np

    sent = rows.sparkSession.sparkContext.broadcast(v)

    def own(batches):
        v = sent.value
        z = np.zeros(v.shape)
        some = False
        for batch in batches:
            for _, part in Rows(batch.column(0)).parts(len(v)):
                part.add_transposed(part.times(v), z)
                some = True
        if some:
            yield from in_slabs(z)

    z = summed(by_core(rows).mapInArrow(own, SLABS), v.shape)
    sent.destroy()
    return z


def fit_svd(train: DataFrame, features="features", k: int = 256, passes: int = 4, extra: int = 32, seed: int = 42) -> Svd:
    """Truncated SVD of a vector column by randomised block iteration (Halko, Martinsson and Tropp 2011).

    A block of k + ``extra`` random directions is multiplied by A'A in each of ``passes`` passes over the rows and made
    orthonormal on the driver; one more pass gives the values and vectors within that space. The driver and each task
    hold arrays of features x (k + extra), whatever the number of rows.
    """
    import numpy as np

    rows = materialize(spread(train.select(F.col(features).alias("x"))), "matrix")
    first = rows.first()
    size = len(first["x"]) if first else 0
    width = min(size, k + extra)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0] if size else np.zeros((0, 0))
    for _ in range(passes if width < size else 0):
        v = np.linalg.qr(_gram_times(rows, v))[0]
    values, turn = np.linalg.eigh(v.T @ _gram_times(rows, v)) if size else (np.zeros(0), v)
    top = np.argsort(-values)[: min(k, size)]
    singular = np.sqrt(np.maximum(0, values[top]))
    some = singular > 1e-7 * singular[:1]  # beyond the rank of the rows there is only rounding: those places are zero
    return Svd((v @ turn[:, top]) * some, (singular * some).tolist())


def concat_blocks(df: DataFrame, *blocks: str, out="features") -> DataFrame:
    """Array columns, each L2-normalised, as one array."""
    return df.withColumn(out, F.concat(*(l2_normalize(b) for b in blocks)))


def hstack_sparse(df: DataFrame, *vectors: str, out="features") -> DataFrame:
    """Vector columns side by side, sparse where they are."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(vectors), outputCol=out).transform(df)


def column_stats(df: DataFrame, vector="embedding") -> DataFrame:
    """Mean, population deviation and largest absolute value of each place of an array column."""
    cells = df.select(F.posexplode(vector).alias("i", "x"))
    return cells.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max(F.abs("x")).cast("double").alias("max_abs"))


def fit_scaler(train: DataFrame, kind: str = "standard", features="features", out="scaled"):
    """A fitted ``standard`` (centred, unit deviation) or ``max_abs`` (keeps sparsity) scaler."""
    from pyspark.ml.feature import MaxAbsScaler, StandardScaler

    scaler = MaxAbsScaler(inputCol=features, outputCol=out) if kind == "max_abs" else StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(train)


def label_index(train: DataFrame, column="category", out="label"):
    """A fitted indexer of labels in alphabetical order."""
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Each class with its rows and its balanced weight n / (k * n_class)."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(y, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, y: str, out="weight") -> DataFrame:
    """Add each row's balanced weight. The weights, a row for each class, are part of the plan: a broadcast could wait too long where heads are fitted side by side."""
    weights = class_weights(df.where(F.col(y).isNotNull()), y).collect()
    known = F.create_map(*[F.lit(v) for r in weights for v in (r[y], r["weight"])]) if weights else F.lit(None).cast(f"map<{df.schema[y].dataType.simpleString()},double>")
    return df.where(F.col(y).isNotNull()).withColumn(out, F.try_element_at(known, F.col(y)))


def embed(df: DataFrame, encoder, backbone: str, batch_size: int = 64, key="page_id", content="content") -> DataFrame:
    """``key, backbone, embedding`` by a pluggable ``encoder(list of contents) -> array``, in batches.

    Rows that the encoder cannot decode alone (it raises) are skipped. Values are rounded to half precision.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np

        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = pdf.iloc[i : i + batch_size]
                try:
                    ids, out = list(part[key]), encoder(list(part[content]))
                except Exception:
                    ids, out = [], []
                    for k, c in zip(part[key], part[content]):
                        try:
                            out.append(encoder([c])[0])
                            ids.append(k)
                        except Exception:
                            continue
                if len(ids):
                    half = np.asarray(out, np.float16).astype(np.float32)
                    yield pd.DataFrame({key: ids, "backbone": backbone, "embedding": list(half)})

    return df.select(key, content).mapInPandas(run, f"{key} {kind}, backbone string, embedding array<float>")
