"""Tables in and out: CSV, JSON lines, Parquet, JDBC, text and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import hash_frac
from ..operators.windows import first_per_key
from ..plans.storage import scratch_path
from . import schemas


def read_permits(spark: SparkSession, path: str, schema: str = schemas.PERMITS) -> DataFrame:
    """A CSV file with a header as texts only; quoted fields may hold commas and line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_download_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV log without header: rows of fewer than four cells dropped, status ok only, the last row of each id."""
    rows = spark.read.schema(schemas.DOWNLOAD_LOG).option("escape", '"').csv(path).select("*", "_metadata.file_path", F.monotonically_increasing_id().alias("_row"))
    whole = rows.where("name IS NOT NULL AND status = 'ok'").withColumn("_seq", F.struct("file_path", "_row"))
    return first_per_key(whole, ["doc_id"], "_seq", last=True).drop("file_path", "_row", "_seq")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the JSON lines at ``path`` lack; returns what was appended."""
    from ..plans.storage import materialize

    try:
        known = df.sparkSession.read.schema(df.schema).json(path).select(*keys)
        fresh = df.dropDuplicates(keys).join(known, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates(keys)
    fresh = materialize(fresh.select(*df.columns), "fresh")
    fresh.write.mode("append").json(path)
    return fresh


def read_table(spark: SparkSession, options: dict[str, str], query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query on a database, read over JDBC; ``partition`` is (column, lower, upper, partitions).

    With ``format`` in the options, any other Spark source of that format, with the query run on the view ``source``.
    """
    options = dict(options)
    if "format" in options:
        spark.read.format(options.pop("format")).options(**options).load().createOrReplaceTempView("source")
        return spark.sql(query)
    reader = spark.read.format("jdbc").options(**options).option("dbtable", f"({query}) q")
    if partition:
        for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
            reader = reader.option(name, str(value))
    return reader.load()


def copy_table(src: DataFrame, write, read, cols: list[str]) -> tuple[int, int]:
    """Copy columns with ``write(df)`` and return the counts of source and copy (``read()``); raises if they differ."""
    part = src.select(*cols)
    write(part)
    counts = part.count(), read().count()
    if counts[0] != counts[1]:
        raise ValueError(f"copied {counts[1]} of {counts[0]} rows")
    return counts


def jdbc_writer(options: dict[str, str], table: str, batch: int = 1000):
    return lambda df: df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode("append").save()


def load_page_text(pages: DataFrame, texts: DataFrame, key="page_id") -> DataFrame:
    """Pages with their text, empty where there is none."""
    return pages.join(texts.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its path and whole text; undecodable bytes are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("_ok"), F.make_valid_utf8(F.col("content").cast("string")).alias("_any")).select("path", F.coalesce("_ok", F.replace("_any", F.lit("�"), F.lit(""))).alias("text"))


def read_embeddings(spark: SparkSession, path: str, backbone: str, key="page_id") -> DataFrame:
    """Vectors from Parquet (``key``, ``embedding``) or from ``.npz`` files (arrays ``emb`` and ``page_id``).

    Ids become longs, values 32-bit. Raises if vectors differ in length or, in an ``.npz``, arrays in theirs.
    """
    if path.rstrip("/").endswith(".npz"):

        def load(batches):
            import io

            import numpy as np
            import pandas as pd

            for pdf in batches:
                for name, content in zip(pdf["path"], pdf["content"]):
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        if not {"emb", "page_id"} <= set(z.files) or len(z["emb"]) != len(z["page_id"]):
                            raise ValueError(f"{name}: needs emb and page_id of one length")
                        for i in range(0, len(z["emb"]), 1000):
                            yield pd.DataFrame({key: z["page_id"][i : i + 1000].astype(np.int64), "embedding": list(z["emb"][i : i + 1000].astype(np.float32))})

        out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, f"{key} long, embedding array<float>")
    else:
        out = spark.read.parquet(path)
    out = out.select(F.col(key).cast("long").alias(key), F.lit(backbone).alias("backbone"), F.col("embedding").cast("array<float>").alias("embedding"))
    lengths = out.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if lengths.a != lengths.b:
        raise ValueError(f"vectors of {lengths.a} to {lengths.b} places")
    return out


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``permit_num, side`` of a split document (JSON with the lists train and eval)."""
    doc = spark.read.schema("train array<string>, eval array<string>").option("multiLine", True).json(path)
    return doc.select(F.explode("train").alias("permit_num"), F.lit("train").alias("side")).union(doc.select(F.explode("eval"), F.lit("eval")))


def split_document(split: DataFrame, group="permit_num", version="v1", seed: int = 42, rules: str = "", min_groups: int = 8, min_finish: int = 15) -> DataFrame:
    """One row: a frozen split (``frozen_split``) as a document.

    It has sorted lists of the groups of each side and, in ``stats``, permits, pages and finish pages of each side and
    in all, the whales by name, the groups that were moved to meet the floors in the order of their hashes, whether
    the floors are met, and whether the groups ran out before. One name for each group is gathered.
    """
    named = lambda c: F.col(group).alias("permit_num") if c == "permit_num" else F.col(c)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col(group)))).alias(s)
    total = lambda c, s=None: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c)) if s else F.col(c)), F.lit(0)).cast("long")
    stats = lambda s: F.struct(F.count_if(F.col("side") == s).alias("permits"), total("pages", s).alias("pages"), total("finish_pages", s).alias("finish_pages")).alias(s)
    whales = F.array_sort(F.collect_list(F.when(F.col("whale"), F.struct(named("permit_num"), "pages"))))
    moved = F.array_sort(F.collect_list(F.when(F.col("moved"), F.struct(hash_frac(group, seed).alias("h"), named("permit_num"), "pages", "finish_pages"))))
    met = (F.count_if(F.col("side") == "eval") >= min_groups) & (total("finish_pages", "eval") >= min_finish)
    out = split.agg(
        side("train"), side("eval"), stats("train").alias("_train"), stats("eval").alias("_eval"), F.count("*").alias("total_permits"), total("pages").alias("total_pages"),
        total("finish_pages").alias("total_finish_pages"), whales.alias("whales_forced_train"), moved.alias("moved"), met.alias("floors_met"))
    without_hash = F.transform("moved", lambda x: F.struct(x["permit_num"].alias("permit_num"), x["pages"].alias("pages"), x["finish_pages"].alias("finish_pages")))
    return out.select(
        F.lit(version).alias("version"), F.lit(seed).alias("seed"), F.lit(rules).alias("rules"), "train", "eval",
        F.struct(
            F.col("_train").alias("train"), F.col("_eval").alias("eval"), "total_permits", "total_pages", "total_finish_pages", "whales_forced_train",
            without_hash.alias("moved_to_eval_to_meet_floors"), "floors_met", (~F.col("floors_met")).alias("floors_exhausted_without_meeting")).alias("stats"))


def write_split(split: DataFrame, path: str, **kw) -> None:
    """Write the document of a frozen split as one JSON file."""
    split_document(split, **kw).coalesce(1).write.mode("overwrite").json(path)


def read_split_document(spark: SparkSession, path: str) -> DataFrame:
    """The whole document of a split: one row."""
    return spark.read.schema(schemas.SPLIT).option("multiLine", True).json(path)


def log_experiment(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def compact_results(df: DataFrame, path: str, key: str, seq: str, **kw) -> DataFrame:
    """Write the settled rows of a result table to ``path`` by way of a new table, and read them."""
    from ..functions.predicates import settled

    spark = df.sparkSession
    aside = scratch_path(spark, "compact")
    settled(df, key, seq, **kw).write.parquet(aside)
    spark.read.schema(df.schema).parquet(aside).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def triage_binary(df: DataFrame, content="content", least: int = 10_240, most: int = 500 << 20) -> DataFrame:
    """Add ``reason``: null for a PDF of an accepted size, else why it is rejected."""
    head = F.substring(F.col(content), 1, 4)
    page = F.lower(F.substring(F.col(content), 1, 256).cast("string"))
    size = F.length(content)
    return df.withColumn(
        "reason",
        F.when(F.col(content).isNull() | (size == 0), "empty")
        .when((head != F.lit(bytearray(b"%PDF"))) & page.rlike(r"^\s*(<!doctype|<html)"), "block_page")
        .when(head != F.lit(bytearray(b"%PDF")), "not_pdf")
        .when(size < least, "too_small")
        .when(size > most, "too_large"),
    )


def export_manifest(pages: DataFrame, path: str, id_="id", image="image_path") -> None:
    pages.select(id_, image).orderBy(id_).write.mode("overwrite").option("header", True).csv(path)
