"""Exact deduplication as a streaming query with keyed state that never expires.

Texts are equal when identical after lower-casing A-Z. :func:`absorb` streams the files of a table into a grouped
aggregation without watermark: its state, kept on disk by RocksDB and in the checkpoint folder, has one entry per
digest with the stable identifier (``doc_id``) and the content locator (file and row in it) of the row that stays, and the
number of rows seen. Only (digest, id, locator) are shuffled, combined map-side first, so a text that makes up a third of
all rows is one entry per task. A later call with the same folder reads new files only and goes on with the old state.

:func:`resolved` reads the state back and gives each row the entry of its digest. Every hit is then checked: the text
at the entry's locator is fetched and compared with the row's whole text. Entries with many rows are dealt in blocks of
``BLOCK`` rows, each with its copy of the located text, so no task holds a group. If texts of one digest differ anywhere, the
rows of that digest are grouped by their whole texts instead, which is exact.

DataFrame functions only. Defined cases: null text -- empty; null id -- never stays if its group has another; equal ids --
the last locator stays; repeated rows are rows of their own; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecensus.functions.scale import durable
from codecensus.llm.common import lower_az, shared_folder, text_of

BLOCK = 1000
#: files that one micro-batch takes
FILES = 1000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # all stores of an executor share one bounded cache
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # no disk set aside for stores that stay small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised() -> Column:
    text = text_of()
    # pure ASCII has a fast way
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_az(text))


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file, row) of a table read from files."""
    return docs.select(
        "doc_id", normalised().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def absorb(spark: SparkSession, path: str, folder: str, digest: Callable[[Column], Column] = sha, files: int = FILES) -> None:
    """Take all files of ``path`` that the state in ``folder`` has not seen yet into it."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    # as a pattern the path may name a single file as well as a folder
    above, _, name = path.rstrip("/").rpartition("/")
    source = f"{above}/{{{name}}}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(source)
    entries = (
        located(stream).select(digest(F.col("text")).alias("digest"), F.struct("doc_id", "file", "row").alias("entry"))
        .groupBy("digest").agg(F.max("entry").alias("stays"), F.count(F.lit(1)).alias("n"))
    )
    try:
        for key, value in STATE.items():
            spark.conf.set(key, value)
        # the state is the result; what a batch changed goes nowhere
        query = (
            entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder)
            .trigger(availableNow=True).start())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, n): the state in ``folder``."""
    state = spark.read.format("statestore").load(folder)
    stays, n = state.schema["value"].dataType.names
    return state.select(
        "key.digest", F.col(f"value.`{stays}`.doc_id").alias("keep_id"), F.col(f"value.`{stays}`.file").alias("keep_file"),
        F.col(f"value.`{stays}`.row").alias("keep_row"), F.col(f"value.`{n}`").alias("n"))


def marked(rows: DataFrame, state: DataFrame, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """(doc_id, file, row, sha, digest, keep_id, keep_file, keep_row, n): every row with the entry of its digest."""
    text = F.col("text")
    return rows.select("doc_id", "file", "row", sha(text).alias("sha"), digest(text).alias("digest")).join(state, "digest")


def clashes(rows: DataFrame, marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(digest): those for which some row's whole text differs from the text at the entry's locator."""
    texts = rows.select("file", "row", "text")
    blocks = F.ceil(F.col("n") / block).cast("int")
    hits = marks.where("n > 1")
    copies = hits.where("file != keep_file OR row != keep_row").select(
        "digest", "file", "row", F.pmod(F.xxhash64("file", "row"), blocks).cast("int").alias("block"))
    heads = hits.where("file = keep_file AND row = keep_row").select(
        "digest", "file", "row", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    copies = texts.join(copies, ["file", "row"]).select("digest", "block", "text")
    heads = texts.join(heads, ["file", "row"]).select("digest", "block", F.col("text").alias("kept"))
    return copies.join(heads, ["digest", "block"]).where("text != kept").select("digest").distinct()


def by_text(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The columns of ``marks`` for rows of clashing digests, with entries by whole text."""
    texts = rows.select("file", "row", "text").join(marks.drop("keep_id", "keep_file", "keep_row", "n"), ["file", "row"])
    groups = texts.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("n"))
    return texts.join(groups, ["digest", "text"]).select(
        "doc_id", "file", "row", "sha", "digest", F.col("stays.doc_id").alias("keep_id"),
        F.col("stays.file").alias("keep_file"), F.col("stays.row").alias("keep_row"), "n")


def resolved(spark: SparkSession, path: str, folder: str, digest: Callable[[Column], Column] = sha, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locators of every row of the files that ``folder`` has seen."""
    rows = located(spark.read.parquet(path))
    marks = durable(marked(rows, entries(spark, folder), digest))
    wrong = durable(clashes(rows, marks, block))
    if not wrong.isEmpty():
        marks = marks.join(wrong, "digest", "left_anti").unionByName(by_text(rows, marks.join(wrong, "digest", "left_semi")))
    return marks.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "file", "row", "keep_file", "keep_row")


def op11(spark, sf_dir: str) -> DataFrame:
    path, folder = f"{sf_dir}/documents.parquet", shared_folder(spark, "exact-dedup")
    absorb(spark, path, folder)
    return resolved(spark, path, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: the same rows in DuckDB's SQL
OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), groups AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM texts JOIN groups USING (body)
"""
