"""Per-repository attempt memory on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import repo_key
from ..schemas import MEMORY, struct


def scan_memory(spark: SparkSession, path: str, repos: DataFrame) -> DataFrame:
    """Memory of each repository in ``repos`` (repo_url); a missing or unreadable document gives
    the empty memory."""
    stored = (
        spark.read.schema(MEMORY).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        .where(F.col("repo_id").isNotNull())
    )
    return with_defaults(repos, stored)


def with_defaults(repos: DataFrame, stored: DataFrame) -> DataFrame:
    shape = struct(MEMORY)
    empty = {
        f.name: F.array().cast(f.dataType)
        for f in shape.fields if f.dataType.typeName() == "array"
    }
    empty.update({
        name: F.lit(0).cast("bigint")
        for name in ("total_attempts", "successful_attempts", "failed_attempts")
    })
    none = F.lit(None).cast("string")
    empty["user_preferences"] = F.struct(
        F.lit(True).alias("keep_original_paths"), none.alias("preferred_css_framework"),
        none.alias("preferred_frontend_framework"),
        F.array().cast("array<string>").alias("avoid_frameworks"),
    )
    empty["tech_stack"] = F.struct(*[
        none.alias(f.name) for f in shape["tech_stack"].dataType.fields
    ])
    # spellings of one address are one repository; the first of them in order names it
    wanted = repos.groupBy(repo_key(F.col("repo_url")).alias("repo_id")).agg(F.min("repo_url").alias("repo_url"))
    return wanted.join(stored.drop("repo_url"), "repo_id", "left").select(*[
        F.coalesce(F.col(f.name), empty[f.name]).alias(f.name) if f.name in empty else F.col(f.name)
        for f in shape.fields
    ])


def write_memory(memory: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the memory of the given repositories; every bucket holds current versions only.

    Only the buckets that hold given repositories are rewritten.  The rewritten rows are put
    together in a staging folder first, so a lost executor never leaves a bucket half read.
    """
    spark = memory.sparkSession
    bucketed = memory.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int"))
    current = _current(spark, path)
    if current is not None:
        touched = bucketed.select("bucket").distinct()
        kept = current.join(touched, "bucket", "left_semi").join(
            memory.select("repo_id"), "repo_id", "left_anti"
        )
        bucketed = bucketed.unionByName(kept.select(*bucketed.columns))
    _replace_buckets(bucketed, path)


def forget_repo(spark: SparkSession, path: str, repo_ids: DataFrame, buckets: int = 256) -> None:
    """Drop the memory of some repositories; one that has none is fine."""
    current = _current(spark, path)
    if current is None:
        return
    gone = repo_ids.select("repo_id").distinct()
    touched = gone.select(
        F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int").alias("bucket")
    ).distinct()
    left = current.join(touched, "bucket", "left_semi").join(gone, "repo_id", "left_anti")
    # a bucket that loses its last row must be replaced too, so each keeps one marker row
    marker = touched.select(*[
        F.col("bucket") if c == "bucket" else F.lit(None).cast(current.schema[c].dataType).alias(c)
        for c in current.columns
    ])
    _replace_buckets(left.unionByName(marker), path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("repo_id").isNotNull()).drop("bucket")


def without(memory: DataFrame, repo_ids: DataFrame) -> DataFrame:
    """The memory table without some repositories, for stores that are rewritten as a whole."""
    return memory.join(repo_ids.select("repo_id"), "repo_id", "left_anti")


def _current(spark, path):
    # AnalysisException is what a folder that was never written gives
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).where(F.col("repo_id").isNotNull())
    except AnalysisException:
        return None


def _replace_buckets(df: DataFrame, path: str) -> None:
    staging = path.rstrip("/") + "__staging"
    df.write.mode("overwrite").parquet(staging)
    (
        df.sparkSession.read.parquet(staging).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )
