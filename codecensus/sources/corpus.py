"""Corpus tables: file listings, snapshots, contents, env files, staged artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import basename, safe_path, strip
from ..functions.scale import positions_by_range
from .tree import FolderTree, file_bytes

# fixed values: branches in the order they are tried; the repository's own default comes last
BRANCHES = ("main", "master")


def scan_tree(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    """List a folder of repositories (``root/<repository>/<path>``) as file metadata.

    Folders are walked in tasks (``sources.tree``), the driver knows the repositories' names only, and no file is
    opened.  ``file_ord`` is the position of a path in its repository's sorted listing.
    """
    spark.dataSource.register(FolderTree)
    listing = spark.read.format("folder_tree").option("partitions", partitions).load(root)
    named = listing.select(
        "repo_id", "path", F.lit("blob").alias("type"), F.lit(None).cast("string").alias("sha"),
        "size", "modified", "location",
    )
    return positions_by_range(named, ["repo_id"], ["path"], "file_ord").withColumn(
        "file_ord", F.col("file_ord") - 1
    )


def read_contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Raw bytes of the given files below ``root``, and of no others: (repo_id, path, bytes)."""
    location = F.concat_ws("/", F.lit(root.rstrip("/")), "repo_id", "path").alias("location")
    return files.select("repo_id", "path", location).mapInArrow(file_bytes, "repo_id string, path string, bytes binary")


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Blobs of a file table."""
    return spark.read.format(fmt).load(path).where(F.col("type") == "blob")


def resolve_branch(snapshots: DataFrame) -> DataFrame:
    """One snapshot per repository: main, then master, then its default branch.

    ``snapshots`` holds (repo_id, branch, default_branch, …).
    """
    branch = F.col("branch")
    rank = F.when(branch == BRANCHES[0], 1).when(branch == BRANCHES[1], 2).when(
        branch == F.col("default_branch"), 3
    )
    rest = [c for c in snapshots.columns if c != "repo_id"]
    return (
        snapshots.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
        .groupBy("repo_id").agg(F.min(F.struct("_rank", *rest)).alias("_s"))
        .select("repo_id", *[F.col(f"_s.{c}").alias(c) for c in rest])
    )


def lenient_text(raw: Column) -> Column:
    """Bytes as text; bytes that are not valid UTF-8 are left out."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    )


def load_contents(
    files: DataFrame, contents: DataFrame | None = None, raw: DataFrame | None = None,
    blobs: DataFrame | None = None,
) -> DataFrame:
    """Attach text from the first store that has it; files without any stay out.

    * ``contents`` (repo_id, path, base64): read leniently;
    * ``raw`` (repo_id, path, bytes): only valid UTF-8 with at most 10 % NUL characters;
    * ``blobs`` (sha, base64): read leniently.

    Which store serves a file is settled on keys alone; then the bodies of all stores meet the
    files in one join.  A key that a store holds several times gives its smallest text, once.
    """
    stores = []
    if contents is not None:
        side = contents.select(
            F.lit(1).alias("_store"), F.col("repo_id").alias("_k1"), F.col("path").alias("_k2"),
            lenient_text(F.unbase64("base64")).alias("content"))
        stores.append((1, ("repo_id", "path"), side.where(F.col("content") != "")))
    if raw is not None:
        text = F.col("bytes").cast("string")
        nul = F.length(text) - F.length(F.replace(text, F.lit("\0"), F.lit("")))
        ok = F.is_valid_utf8(text) & (nul <= F.length(text) * F.lit(rules.MAX_NUL_SHARE))
        stores.append((2, ("repo_id", "path"), raw.where(ok).select(
            F.lit(2).alias("_store"), F.col("repo_id").alias("_k1"), F.col("path").alias("_k2"), text.alias("content"))))
    if blobs is not None:
        side = blobs.select(
            F.lit(3).alias("_store"), F.col("sha").alias("_k1"), F.lit("").alias("_k2"),
            lenient_text(F.unbase64("base64")).alias("content"))
        stores.append((3, ("sha", None), side.where(F.col("content").isNotNull())))
    picked, bodies = files, None
    serves = F.lit(None).cast("struct<_store:int,_k1:string,_k2:string>")
    for store, keys, side in reversed(stores):
        flag = f"_has{store}"
        own = [F.col(k) if k else F.lit("") for k in keys]
        held = side.select(F.col("_k1").alias("_h1"), F.col("_k2").alias("_h2"), F.lit(True).alias(flag)).distinct()
        picked = picked.join(held, (own[0] == F.col("_h1")) & (own[1] == F.col("_h2")), "left").drop("_h1", "_h2")
        serves = F.when(F.col(flag), F.struct(
            F.lit(store).alias("_store"), own[0].cast("string").alias("_k1"), own[1].cast("string").alias("_k2"))).otherwise(serves)
        bodies = side if bodies is None else side.unionByName(bodies)
    single = bodies.groupBy("_store", "_k1", "_k2").agg(F.min("content").alias("content"))
    # the aggregate deals the bodies by key, and so the join needs no other exchange of them
    return picked.withColumn("_from", serves).select(*[F.col(f"`{c}`") for c in files.columns], "_from.*").join(
        single, ["_store", "_k1", "_k2"]).drop("_store", "_k1", "_k2")


def read_env_pairs(files: DataFrame) -> DataFrame:
    """KEY=VALUE lines of env files: (repo_id, path, line, key, value)."""
    line = F.col("_line")
    return (
        files.where(basename(F.col("path")).startswith(".env") | F.col("path").endswith(".env"))
        .select("repo_id", "path", F.posexplode(F.transform(F.split("content", "\n"), strip))
                .alias("_i", "_line"))
        .where((line != "") & ~line.startswith("#") & line.contains("="))
        .select(
            "repo_id", "path", (F.col("_i") + 1).alias("line"),
            strip(F.regexp_extract(line, r"(?s)^([^=]*)=", 1)).alias("key"),
            strip(F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        )
    )


def artifact_manifest(artifacts: DataFrame, by=("repo_id", "run_id")) -> DataFrame:
    """Staging list of a run's files with git blob ids."""
    body = F.encode("content", "UTF-8")
    head = F.concat(F.lit("blob "), F.octet_length("content").cast("string"), F.lit("\0"))
    return artifacts.select(
        *by, safe_path(F.col("filename")).alias("path"), F.lit("100644").alias("mode"),
        F.lit("blob").alias("type"), F.sha1(F.concat(F.encode(head, "UTF-8"), body)).alias("sha"),
        F.octet_length("content").cast("bigint").alias("bytes"),
    )


def write_artifacts(artifacts: DataFrame, target: str, buckets: int = 64) -> DataFrame:
    """Write a run's files under ``target`` and return the manifest read back from there.

    Rows without a name or text are failures that do not stop the rest; an empty set is an
    error.  Repositories are spread over a fixed number of folders, and within a folder by file,
    so neither many repositories nor one large repository makes a bad layout.
    """
    good = artifacts.where(F.col("filename").isNotNull() & F.col("content").isNotNull())
    if good.limit(1).count() == 0:
        raise ValueError("no files to stage")
    bucket = F.pmod(F.xxhash64("repo_id"), F.lit(buckets)).cast("int")
    good.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(target)
    return artifact_manifest(artifacts.sparkSession.read.parquet(target))
