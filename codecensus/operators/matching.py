"""Joins between planned, existing, generated and referenced files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.grams import occurrences
from ..functions.paths import basename, lookup

RUN = ("repo_id", "run_id")


def model_budget(repos: DataFrame, model: str = "model") -> DataFrame:
    """Characters that are safe to send per repository's model; a null model is the default."""
    limits = {name: chars for name, (_, chars) in rules.MODEL_LIMITS.items()}
    return repos.withColumn(
        "budget",
        F.coalesce(
            lookup(limits, F.coalesce(F.col(model), F.lit(rules.DEFAULT_MODEL))),
            F.lit(rules.UNKNOWN_MODEL_CHARS),
        ).cast("bigint"),
    )


def missing_files(
    expected: DataFrame, generated: DataFrame, limit: int = rules.RECOVERABLE_MISSING
) -> DataFrame:
    """Expected paths that were generated neither under their path nor under their name.

    ``recoverable`` marks repositories with at most ``limit`` of them.  Only those small
    repositories take part in the join that sets it.
    """
    want = expected.select("repo_id", "path").distinct()
    have = generated.select("repo_id", F.col("filename").alias("path"))
    names = generated.select("repo_id", basename(F.col("filename")).alias("_name")).distinct()
    gone = (
        want.join(have, ["repo_id", "path"], "left_anti")
        .withColumn("_name", basename(F.col("path")))
        .join(names, ["repo_id", "_name"], "left_anti")
        .drop("_name")
    )
    small = (
        gone.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") <= limit)
        .select("repo_id", F.lit(True).alias("_small"))
    )
    return gone.join(small, "repo_id", "left").select(
        "repo_id", "path", F.coalesce("_small", F.lit(False)).alias("recoverable")
    )


def remaining_files(files: DataFrame, assignments: DataFrame) -> DataFrame:
    """Files no planned batch took, under the batch name for leftovers."""
    return files.join(
        assignments.select("repo_id", "path"), ["repo_id", "path"], "left_anti"
    ).withColumn("batch_name", F.lit(rules.REMAINING_BATCH))


def match_plan_paths(plan_lines: DataFrame, files: DataFrame) -> DataFrame:
    """Planned paths resolved to files: (…plan line…, path, file_ord, match_kind).

    An exact path wins.  Otherwise it is the first file in order that ends with the planned
    path, that the planned path ends with, or that has the same file name.  The suffix tests
    never meet as a nested loop: two paths of which one ends with the other share their file
    name unless the shorter one has no slash, so three equality joins cover all cases:

    * same file name;
    * planned path without slash = a suffix of a file's name;
    * a suffix of the planned file name = a file at the top level.

    Each lookup side is reduced to its first file per key before it is joined.
    """
    def first_file(df, key):
        return (
            df.groupBy("repo_id", key)
            .agg(F.min(F.struct("file_ord", "path")).alias("_hit"))
            .select("repo_id", F.col(key).alias("_key"), "_hit")
        )

    keys = plan_lines.columns
    exact_side = files.groupBy("repo_id", F.col("path").alias("planned_path")).agg(
        F.max("file_ord").alias("_exact_ord")
    )
    tried = plan_lines.join(exact_side, ["repo_id", "planned_path"], "left")
    exact = tried.where(F.col("_exact_ord").isNotNull()).select(
        *keys, F.col("planned_path").alias("path"), F.col("_exact_ord").alias("file_ord"),
        F.lit("exact").alias("match_kind"),
    )
    planned = F.col("planned_path")
    planned_name = basename(planned)
    # one search per distinct unmatched path, however many plan lines repeat it
    loose = (
        tried.where(F.col("_exact_ord").isNull()).select("repo_id", "planned_path").distinct()
    )

    def suffixes(name):
        return F.transform(
            F.sequence(F.lit(0), F.length(name)), lambda n: F.right(name, n.cast("int"))
        )

    slashless = loose.where(F.instr(planned, "/") == 0)
    name = basename(F.col("path"))
    by_name = first_file(files.withColumn("_k", name), "_k")
    wanted = slashless.select("repo_id", planned.alias("_k")).distinct()
    # a repository's names are cut only to the lengths its plan asks for
    lengths = wanted.groupBy("repo_id").agg(F.collect_set(F.length("_k")).alias("_lengths"))
    cut = F.transform(
        F.filter("_lengths", lambda n: n <= F.length(name)), lambda n: F.right(name, n)
    )
    by_suffix = first_file(
        files.join(lengths, "repo_id")
        .select("repo_id", "file_ord", "path", F.explode(cut).alias("_k"))
        .join(wanted, ["repo_id", "_k"], "left_semi"),
        "_k",
    )
    top = first_file(files.where(F.instr("path", "/") == 0).withColumn("_k", F.col("path")), "_k")
    hits = (
        loose.withColumn("_key", planned_name).join(by_name, ["repo_id", "_key"])
        .unionByName(
            slashless.withColumn("_key", planned).join(by_suffix, ["repo_id", "_key"])
        )
        .unionByName(
            loose.select("repo_id", "planned_path",
                         F.explode(suffixes(planned_name)).alias("_key"))
            .join(top, ["repo_id", "_key"])
        )
    )
    best = (
        hits.groupBy("repo_id", "planned_path").agg(F.min("_hit").alias("_hit"))
    )
    fuzzy = plan_lines.join(best, ["repo_id", "planned_path"]).select(
        *keys, F.col("_hit.path").alias("path"), F.col("_hit.file_ord").alias("file_ord"),
        F.lit("fuzzy").alias("match_kind"),
    )
    return exact.unionByName(fuzzy)


def locate_content(selections: DataFrame, artifacts: DataFrame, first_src_only: bool = False) -> DataFrame:
    """Artifacts that contain a selected element: (repo_id, sel_id, filename).

    ``selections`` carries (repo_id, sel_id, text, element_id, src).  Texts of 3 to 199
    characters are searched by their first 30 characters, which every longer match contains;
    ids in three spellings; sources as they are.  Python and PowerShell files never match.
    Contents stay where they are: they give the places where a needle of their repository may
    begin, with the bytes that are compared (``functions.grams``).  Rows are dealt by the hash of
    a needle's first bytes, so a repository with most of the files is spread.

    ``first_src_only`` gives the first artifact by order that contains the source instead.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    length = F.length(text)
    ident, src = F.col("element_id"), F.col("src")
    if first_src_only:
        needles = F.array(src)
    else:
        needles = F.array(
            F.when((length > 2) & (length < 200), F.substring(text, 1, 30)),
            F.when(ident != "", F.concat(F.lit('id="'), ident, F.lit('"'))),
            F.when(ident != "", F.concat(F.lit("id='"), ident, F.lit("'"))),
            F.when(ident != "", F.concat(F.lit("id: '"), ident, F.lit("'"))),
            F.when(src != "", src),
        )
    wanted = selections.select(
        "repo_id", "sel_id",
        F.explode(F.filter(needles, lambda n: n.isNotNull() & (n != ""))).alias("needle"),
    )
    searched = artifacts if first_src_only else artifacts.where(
        ~(F.col("filename").endswith(".py") | F.col("filename").endswith(".ps1")))
    hits = occurrences(wanted, searched, ["repo_id"], carry=("filename", "file_ord"))
    if first_src_only:
        firsts = hits.groupBy("repo_id", "needle").agg(
            F.min(F.struct("file_ord", "filename")).alias("_hit")
        )
        return wanted.join(firsts, ["repo_id", "needle"]).select(
            "repo_id", "sel_id", "_hit.filename"
        )
    return wanted.join(hits, ["repo_id", "needle"]).select(
        "repo_id", "sel_id", "filename"
    ).distinct()


def combined_entries(repo_files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Existing files that were not generated, plus generated ones: (repo_id, path, is_new, chars)."""
    old = repo_files.join(
        artifacts.select("repo_id", F.col("filename").alias("path")), ["repo_id", "path"], "left_anti"
    ).select("repo_id", "path", F.lit(False).alias("is_new"), F.col("size").alias("chars"))
    new = artifacts.select(
        "repo_id", F.col("filename").alias("path"), F.lit(True).alias("is_new"),
        F.length("content").cast("bigint").alias("chars"),
    )
    return old.unionByName(new)


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo_id").agg(
        F.count_if("is_new").alias("new_files"), F.count_if(~F.col("is_new")).alias("existing_files")
    )


def upsert_artifacts(artifacts: DataFrame, edits: DataFrame, by=RUN) -> DataFrame:
    """Replace by file name in place, append what is new.

    The last edit of a name gives the content.  If a name was generated more than once, only
    its first row is replaced.  New rows follow the existing ones in the order of the edits;
    ``file_ord`` stays sortable but need not be dense.
    """
    keys = [*by, "filename"]
    last = edits.groupBy(*keys).agg(
        F.max_by("content", "edit_ord").alias("_content"), F.min("edit_ord").alias("_edit_ord")
    )
    # only names that are edited at all look for their first row
    firsts = (
        artifacts.select(*keys, "file_ord").join(last.select(*keys), keys, "left_semi")
        .groupBy(*keys).agg(F.min("file_ord").alias("file_ord"))
    )
    targets = firsts.join(last.select(*keys, "_content"), keys).withColumn("_edited", F.lit(True))
    kept = artifacts.join(targets, [*keys, "file_ord"], "left").select(
        *by, "file_ord", "filename",
        F.when(F.col("_edited"), F.col("_content")).otherwise(F.col("content")).alias("content"),
        F.coalesce("_edited", F.lit(False)).alias("edited"),
    )
    ends = artifacts.groupBy(*by).agg(F.max("file_ord").alias("_end"))
    added = (
        last.join(firsts.select(*keys), keys, "left_anti").join(ends, list(by), "left")
        .select(
            *by,
            (F.coalesce("_end", F.lit(-1)) + 1 + F.col("_edit_ord")).alias("file_ord"),
            "filename", F.col("_content").alias("content"), F.lit(True).alias("edited"),
        )
    )
    return kept.unionByName(added)
