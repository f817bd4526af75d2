"""Quality rules: in-text repetition, and lines that too many documents of a host share.

A line's normal form is lower-cased with single blanks. A line is boilerplate of its host (the
``source`` column) when more than ``max_share`` of the host's different texts and at least
``min_docs`` of them hold it, or, however large the host is, when ``many_docs`` of them hold it and it has at least
``many_words`` words: short lines of clean prose recur by chance in a large host. Exact copies count once. Boilerplate lines are removed, and a document
of which fewer than ``min_left`` words or less than ``min_left_share`` of its words then remain is
rejected as depleted. The base rules look at each text alone.

DataFrame functions only. Texts stay in their rows: the shuffles carry line hashes and counts, hot
lines are counted map-side first, and the join that marks lines may be split on hot keys.

Defined cases: null text -- no words, fails the base rules; null source -- a host of its own; rows with
equal id, source and text get equal verdicts; an empty table gives an empty result; other columns
are carried by :func:`kept_documents` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.functions.scale import durable
from codecensus.llm.common import SPACE, WORD, documents, n_words, row_key, text_of, unwrapped, wrapped

NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 5


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))
    out = (
        docs.withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
        .withColumn("word_chars", F.length(F.regexp_replace(text, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("_words", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("_words").cast("long"))
    )
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW))
    out = out.withColumn("_windows", F.transform(
        starts, lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])))
    # only texts that repeat a window pay for sorting: equal hashes become neighbours
    out = out.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get(F.col("_sorted"), j - 1), F.get(F.col("_sorted"), j + 1)
        return (before["h"].eqNullSafe(x["h"])) | (after["h"].eqNullSafe(x["h"]))

    places = F.sort_array(F.transform(F.filter("_sorted", repeated), lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(
            x.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total")),
        lambda acc: acc["total"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(
        "_words", "_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_lines(docs: DataFrame) -> DataFrame:
    """(_key, _host, _text, _at, _line, _words): every line with a word, hashed in normal form."""
    text = text_of()
    rows = docs.select(
        row_key().alias("_key"), F.xxhash64(F.coalesce("source", F.lit("\x00"))).alias("_host"),
        F.xxhash64(text).alias("_text"), F.posexplode(F.split(text, "\n")).alias("_at", "_raw"))
    normal = F.lower(F.trim(F.regexp_replace("_raw", SPACE, " ")))
    return rows.where(F.col("_raw").rlike(NOT_SPACE)).select(
        "_key", "_host", "_text", "_at", F.xxhash64(normal).alias("_line"), n_words(F.col("_raw")).alias("_words"))


def frequent_lines(docs: DataFrame, min_docs: int, max_share: float, many_docs: int, many_words: int) -> DataFrame:
    """(_host, _line) of the lines above the limits."""
    texts = docs.select(
        F.xxhash64(F.coalesce("source", F.lit("\x00"))).alias("_host"), F.xxhash64(text_of()).alias("_text")
    ).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    lines = (
        host_lines(docs).select("_host", "_line", "_text", "_words").distinct()
        # equal lines have equally many words
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"), F.max("_words").alias("_words"))
        .where(F.col("_docs") >= min(min_docs, many_docs))
    )
    in_share = (F.col("_docs") >= min_docs) & (F.col("_docs") > max_share * F.col("_texts"))
    in_number = (F.col("_docs") >= many_docs) & (F.col("_words") >= many_words)
    return lines.join(texts, "_host").where(in_share | in_number).select("_host", "_line")


def removed_lines(docs: DataFrame, *limits) -> DataFrame:
    """(_key, _removed, _at): per document the words and positions of its boilerplate lines."""
    marked = host_lines(docs).select("_key", "_host", "_line", "_at", "_words").join(
        frequent_lines(docs, *limits), ["_host", "_line"], "left_semi")
    return (
        # repeated rows share a key: each of their lines counts once
        marked.groupBy("_key", "_at").agg(F.max("_words").alias("_words"))
        .groupBy("_key").agg(F.sum("_words").alias("_removed"), F.collect_list("_at").alias("_gone"))
    )


def judged(
    docs: DataFrame, min_docs: int = 20, max_share: float = 0.1, min_left: int = 10,
    min_left_share: float = 0.2, carry=("doc_id",), many_docs: int = 200, many_words: int = 5,
) -> DataFrame:
    """Metrics, removed_words, base_failed and kept for every document, with the columns in ``carry``
    and ``removed_at``, the positions of removed lines (lines split at \\n, from 0)."""
    metrics = base_metrics(docs.withColumn("_key", row_key()))
    gone = removed_lines(docs, min_docs, max_share, many_docs, many_words)
    rows = metrics.select("_key", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = rows.join(gone, "_key", "left").withColumn("removed_words", F.coalesce("_removed", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (
        (left < min_left) | (left < min_left_share * F.col("n_words")))
    return (
        rows.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .withColumnRenamed("_gone", "removed_at").drop("_removed", "_key")
    )


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """(_key, kept, removed_at) of every distinct (id, source, text): a narrow table in the shared folder.

    It is written before anything filters on ``kept``. That column is a conjunction over computed arrays; a filter
    pushed below the projections would extract a text's words again for each of them, even once per word.
    """
    rows = docs.select(row_key().alias("_id"), "doc_id", "source", "text")
    found = judged(rows, carry=("_id",), **limits).select(F.col("_id").alias("_key"), "kept", "removed_at")
    return durable(found.dropDuplicates(["_key"]))


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without their boilerplate lines; columns as in ``docs``."""
    passing = verdicts(docs, **limits).where("kept").select("_key", "removed_at")
    # the text travels once, inside the row
    rows = wrapped(docs).select("_row", row_key().alias("_key"))
    carried = rows.join(passing, "_key").withColumn("text", F.col("_row.text"))
    lines = F.split(text_of(), "\n")
    cleaned = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed_at", i)), "\n")
    text = F.when(F.col("removed_at").isNull(), F.col("text")).otherwise(cleaned)
    return unwrapped(carried, docs.columns, text)


def op5(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "removed_words", "base_failed", "kept")


#: the same rows in DuckDB's SQL; lines and windows are compared as texts
OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), lines AS (
  SELECT doc_id, host, body, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS normal,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), repeats AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id
), windows AS (
  SELECT doc_id, place, list_slice(words, place, place + 4) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS place FROM docs)
), covered AS (
  SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) CROSS JOIN range(5) AS ks(k)
  WHERE n > 1 GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT body) AS texts FROM docs GROUP BY host
), frequent AS (
  SELECT host, normal FROM lines JOIN hosts USING (host) GROUP BY host, normal, texts
  HAVING (count(DISTINCT body) >= 20 AND count(DISTINCT body) > 0.1 * texts)
      OR (count(DISTINCT body) >= 200 AND max(words) >= 5)
), removed AS (
  SELECT doc_id, sum(words) AS removed_words FROM lines JOIN frequent USING (host, normal) GROUP BY doc_id
), figures AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures
)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (
         n_words - removed_words < 10 OR n_words - removed_words < 0.2 * n_words)) AS kept
FROM judged
"""
