"""Filters and row flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import (
    any_of, basename, contains_any, extension, strip,
)


def eligible_files(
    files: DataFrame,
    max_bytes: int = rules.MAX_FILE_BYTES,
    extensions=rules.CODE_EXTENSIONS,
    names=rules.IMPORTANT_FILES,
    hints=rules.PATH_HINTS,
    skip_dirs=rules.SKIP_DIRS,
    binary=rules.BINARY_EXTENSIONS,
) -> DataFrame:
    """Every blob with ``eligible`` and the first ``reason`` it was dropped for, if any.

    Only metadata is touched, so a scan with this operator on top reads no contents.
    """
    path = F.col("path")
    ext, low = F.lower(extension(path)), F.lower(path)
    listed = ext.isin(*extensions) | basename(path).isin(*names) | contains_any(low, hints)
    parts = F.split(F.translate(path, "\\", "/"), "/")
    reason = (
        F.when(~listed, "unlisted")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, skip_dirs))), "skip_dir")
        .when(ext.isin(*binary), "binary_ext")
        .when(F.coalesce(F.col("size"), F.lit(0)) > max_bytes, "too_large")
    )
    return (
        files.where(F.col("type") == "blob")
        .withColumn("reason", reason)
        .withColumn("eligible", F.col("reason").isNull())
    )


def drop_binary_like(files: DataFrame, max_share: float = rules.MAX_NUL_SHARE) -> DataFrame:
    """Drop contents in which more than ``max_share`` of the characters are NUL."""
    nul = F.length("content") - F.length(F.replace("content", F.lit("\0"), F.lit("")))
    return files.where(nul <= F.length("content") * F.lit(max_share))


def scan_coverage(files: DataFrame, low: float = rules.LOW_COVERAGE) -> DataFrame:
    """Fetched against total blobs per repository; ``flag`` is zero, low or ok.

    ``files`` carries a boolean ``fetched`` column.
    """
    fetched = F.count_if("fetched")
    total = F.count(F.lit(1))
    return (
        files.groupBy("repo_id")
        .agg(total.alias("total"), fetched.alias("fetched"))
        .withColumn("ratio", F.col("fetched") / F.col("total"))
        .withColumn(
            "flag",
            F.when(F.col("fetched") == 0, "zero")
            .when(F.col("fetched") < F.col("total") * F.lit(low), "low")
            .otherwise("ok"),
        )
    )


def filter_log(log: DataFrame, levels=None, category: str = "ALL", query: str = "") -> DataFrame:
    """Level set, one category or ALL, free text over message, category and details."""
    out = log
    if levels is not None:
        out = out.where(F.col("level").isin(*levels)) if levels else out.where(F.lit(False))
    if category != "ALL":
        out = out.where(F.col("category") == category)
    if query:
        out = out.where(
            any_of(
                F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower())
                for c in ("message", "category", "details")
            )
        )
    return out


def log_since(log: DataFrame, since) -> DataFrame:
    """Entries strictly newer than a cursor.

    The cursor takes the column's own type, so the comparison reaches the file scan.
    """
    return log.where(F.col("ts") > F.lit(since).cast(log.schema["ts"].dataType))


def is_placeholder(src):
    """True for image sources that stand for a picture still to be made."""
    return (
        contains_any(F.lower(src), rules.PLACEHOLDER_SRC)
        | (strip(src) == "")
        | src.startswith("#")
    )


def placeholder_images(image_refs: DataFrame) -> DataFrame:
    return image_refs.where(is_placeholder(F.col("src")))


def conversational_requests(requests: DataFrame, text: str = "text") -> DataFrame:
    """Requests flagged as conversational (a listed phrase) and as too vague to use as is."""
    raw = F.col(text)
    trimmed = strip(raw)
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return requests.withColumn(
        "is_conversational", contains_any(F.lower(raw), rules.CONVERSATIONAL_PHRASES)
    ).withColumn("needs_refine", F.col("is_conversational") | (words < 5))


def browser_side_scripts(files: DataFrame, path: str = "path") -> DataFrame:
    """JavaScript files with ``is_client_side`` telling whether they use browser objects."""
    return files.where(F.col(path).endswith(".js")).withColumn(
        "is_client_side", contains_any(F.col("content"), rules.BROWSER_MARKERS)
    )


def selected_rows(rows: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows whose key is in a selection set."""
    return rows.join(keys, on, "left_semi")


__all__ = [
    "eligible_files", "drop_binary_like", "scan_coverage", "filter_log", "log_since",
    "is_placeholder", "placeholder_images", "conversational_requests", "browser_side_scripts",
    "selected_rows",
]
