"""Run logs: error classes, outcomes, recovery texts; log rendering and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import contains_any


def classify_errors(logs: DataFrame, log: str = "log", table=rules.ERROR_RULES) -> DataFrame:
    """Error class and surrounding text of each log: the first rule in list order wins.

    Nearly all rules are plain texts; they are searched as substrings of the lower-cased log,
    which is many times cheaper than forty case-insensitive regular expressions.  The offset is
    looked up only for the rule that fired and counted in characters.
    """
    text = F.coalesce(F.col(log), F.lit(""))
    low = F.col("_low")
    rule = None
    for i, (pattern, _) in enumerate(table):
        plain = plain_text(pattern)
        hit = low.contains(plain.lower()) if plain is not None else text.rlike(FLAGS + pattern)
        rule = F.when(hit, i) if rule is None else rule.when(hit, i)
    patterns = F.array(*[F.lit(FLAGS + p) for p, _ in table])
    types = F.array(*[F.lit(t) for _, t in table])
    # a generated column is computed once; a projected one would be computed again inside every
    # filter and expression above that mentions it
    marked = logs.withColumn("_low", F.lower(text)).select(
        *logs.columns, F.explode(F.array(rule)).alias("_rule")
    )
    pattern = F.get(patterns, F.col("_rule"))
    before = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    width = F.length(F.regexp_substr(text, pattern))
    start = F.greatest(before - rules.ERROR_CONTEXT_BEFORE, F.lit(0))
    around = F.substring(text, start + 1, before + width + rules.ERROR_CONTEXT_AFTER - start)
    return (
        marked.withColumn("is_error", F.col("_rule").isNotNull())
        .withColumn("error_type", F.coalesce(F.get(types, F.col("_rule")), F.lit("")))
        .withColumn("error_message", F.when(F.col("_rule").isNotNull(), around).otherwise(""))
        .withColumn("early_crash", contains_any(text, rules.CRASH_INDICATORS))
        .drop("_rule")
    )


# case-insensitive, and a dot that stops at line feeds only
FLAGS = "(?id)"


def plain_text(pattern: str) -> str | None:
    """The text a pattern stands for if it has no operators, else None."""
    if re.fullmatch(r"(?:[^\\.\[\](){}*+?^$|]|\\[^A-Za-z0-9])*", pattern):
        return re.sub(r"\\(.)", r"\1", pattern)
    return None


def error_lesson(
    failures: DataFrame, table=rules.LESSON_RULES, default: str = rules.DEFAULT_LESSON
) -> DataFrame:
    return failures.withColumn("lesson", lesson(F.col("error_type"), table, default))


def lesson(error_type: Column, table=rules.LESSON_RULES, default: str = rules.DEFAULT_LESSON) -> Column:
    """Lesson of the first rule whose key occurs in the error type."""
    out = F.when(error_type.contains(table[0][0]), table[0][1])
    for key, text in table[1:]:
        out = out.when(error_type.contains(key), text)
    return out.otherwise(default)


def run_errors(run_logs: DataFrame) -> DataFrame:
    """Classified errors of the attempts of each run: (repo_id, run_id, attempt, type, message)."""
    return classify_errors(run_logs).where("is_error").select(
        "repo_id", "run_id", "attempt", F.col("error_type").alias("type"),
        F.col("error_message").alias("message"),
    )


def run_outcomes(run_logs: DataFrame) -> DataFrame:
    """One row per run: attempts, retries, error types in order, URLs and status of the last log.

    A run has at most ``MAX_ATTEMPTS`` attempts.  Two columns may come with the logs: ``fallback``, true where the
    attempt gave its built-in answer, makes the run's status that of a fallback if its last attempt has it;
    ``exception``, the text of what ended the run, gives the run one error of type EXCEPTION, no retries, no URLs and
    the status of an error, whatever its logs say.
    """
    none = F.lit(None)
    flagged = F.coalesce(F.col("fallback"), F.lit(False)) if "fallback" in run_logs.columns else F.lit(False)
    ended = F.col("exception") if "exception" in run_logs.columns else none.cast("string")
    # what the last log says is read in every row, so that no log travels through the shuffle
    text = F.coalesce("log", F.lit(""))
    marked = classify_errors(run_logs.withColumns({"_flagged": flagged, "_ended": ended})).select(
        "repo_id", "run_id", "attempt", "is_error", "error_type",
        F.struct(
            F.regexp_extract(text, r"\[PREVIEW_URL\] (https://[^\s]+)", 1).alias("preview_url"),
            F.regexp_extract(text, r"\[BACKEND_URL\] (https://[^\s]+)", 1).alias("backend_url"),
            F.when(F.col("_flagged") | contains_any(text, rules.FALLBACK_MARKERS), rules.STATUS_FALLBACK)
            .otherwise(rules.STATUS_OK).alias("status"),
        ).alias("_says"), F.col("_ended").isNotNull().alias("_ended"),
    )
    last = F.max_by("_says", "attempt")
    return (
        marked.groupBy("repo_id", "run_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if("is_error").alias("errors"),
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("is_error"), F.struct("attempt", "error_type")))),
                lambda x: x["error_type"],
            ).alias("error_types"),
            last.alias("_last"), F.bool_or("_ended").alias("_ended"),
        )
        .withColumns({
            "errors": F.when(F.col("_ended"), F.lit(1).cast("bigint")).otherwise(F.col("errors")),
            "error_types": F.when(F.col("_ended"), F.array(F.lit(rules.EXCEPTION))).otherwise(F.col("error_types")),
            "_last": F.when(F.col("_ended"), F.struct(
                F.lit("").alias("preview_url"), F.lit("").alias("backend_url"), F.lit(rules.STATUS_ERROR).alias("status"),
            )).otherwise(F.col("_last")),
        })
        .withColumn("retries", F.when(F.col("_ended"), F.lit(0).cast("bigint")).otherwise(
            F.least(F.col("errors"), F.lit(rules.MAX_ATTEMPTS - 1).cast("bigint"))))
        .select("*", "_last.*").drop("_last", "_ended")
    )


def error_context(errors: DataFrame) -> DataFrame:
    """One recovery text per run: its errors, numbered in order, messages cut to 1000."""
    rows = F.array_sort(F.collect_list(F.struct("attempt", "type", "message")))
    text = F.array_join(
        F.transform(rows, lambda e, i: F.concat(
            F.lit("### Error "), (i + 1).cast("string"), F.lit(" (Attempt "),
            e["attempt"].cast("string"), F.lit(") - Type: "), e["type"], F.lit("\n```\n"),
            F.substring(e["message"], 1, rules.ERROR_MESSAGE_IN_CONTEXT), F.lit("\n```\n"),
        )), "\n",
    )
    return errors.groupBy("repo_id", "run_id").agg(text.alias("text"))


# ---------------------------------------------------------------- debug log

def log_level_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def log_categories(log: DataFrame) -> DataFrame:
    return log.select("category").distinct()


def newest_entries(log: DataFrame, n: int = rules.LOG_BUFFER) -> DataFrame:
    """Newest n entries; a global sort with limit keeps n rows per partition before the merge."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def log_text(log: DataFrame) -> DataFrame:
    """Log rows as text: time, level, category, message, and details as indented JSON.

    Values that are themselves containers stay on one line.
    """
    entries = F.map_entries(F.from_json("details", "map<string,variant>"))
    # a key is quoted the way a one-element array quotes it
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(
            F.lit("  "), quoted(e["key"]), F.lit(": "), F.coalesce(F.to_json(e["value"]), F.lit("null"))
        )), ",\n",
    )
    head = F.concat(
        F.lit("["), F.date_format("ts", "HH:mm:ss.SSS"), F.lit("] "), F.col("level"), F.lit(" ["),
        F.col("category"), F.lit("] "), F.col("message"),
    )
    return log.withColumn("line", F.when(
        F.coalesce(F.size(entries), F.lit(0)) > 0, F.concat(head, F.lit("\n  {\n"), body, F.lit("\n}"))
    ).otherwise(head))
