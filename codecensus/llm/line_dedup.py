"""Line deduplication by overlapping windows of three lines.

Consecutive lines that hold a word are hashed in threes. Of every window that occurs more than once
in the table the first occurrence (smallest id, then smallest place) stays; the lines that later
occurrences cover, merged over overlapping windows, are removed. A passage of n >= 3 lines is thus
removed whole, while single common lines stay.

Windows are counted map-side before they are shuffled, the join that finds later occurrences may be split on hot
windows, and only covered places return to the documents. Removing the lines is one small function
over Arrow batches, linear in the text.

Defined cases: null text -- null stays; fewer than three lines -- unchanged; a null id sorts before all
others; rows with equal id, source and text are one document and stay alike; a removed document's text is
empty, the row stays; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codecensus.llm.common import SPACE, documents, row_key, text_of, unwrapped, wrapped

NOT_SPACE = r"[^\x20\x09-\x0D]"
LINES = 3
REMAINING = StructType([
    StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])


def windows(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, _at, _window): hash of every three consecutive lines; ``_at`` is the place of the first
    among the lines that hold a word."""
    lines = F.filter(F.split(text_of(), "\n"), lambda line: line.rlike(NOT_SPACE))
    hashed = F.transform(lines, lambda line: F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))))
    rows = docs.select(row_key().alias("_key"), "doc_id", hashed.alias("_hashes")).where(
        F.size("_hashes") >= LINES)
    at = F.explode(F.sequence(F.lit(0), F.size("_hashes") - LINES))
    return rows.withColumn("_at", at).select(
        "_key", "doc_id", "_at", F.xxhash64(*[F.get("_hashes", F.col("_at") + k) for k in range(LINES)]).alias("_window"))


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(_key, _starts): per document the places of windows that occurred before, ascending."""
    found = windows(docs)
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("_key").alias("k"), F.col("_at").alias("a"))
    first = (
        found.groupBy("_window").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
        .where("_first < _last").select("_window", "_first")
    )
    later = found.join(first, "_window").where(
        (F.col("_first.k") != F.col("_key")) | (F.col("_first.a") != F.col("_at")))
    return later.groupBy("_key").agg(F.array_sort(F.collect_set("_at")).alias("_starts"))


@F.pandas_udf(REMAINING)
def _without(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    out = []
    for text, places in zip(texts, starts):
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        if places is not None:
            for place in places:
                gone.update(solid[place:place + LINES])
        kept = text if not gone else "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append((kept, len(solid), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """_row (the document), text (what remains), n_lines (with a word), n_removed."""
    # the text travels once, inside the row
    rows = wrapped(docs).select("_row", row_key().alias("_key"))
    joined = rows.join(later_occurrences(docs), "_key", "left")
    # once a row: a filter on its result would run a second copy, with Python workers of its own
    out = joined.withColumn("_new", _without.asNondeterministic()("_row.text", "_starts"))
    return out.select("_row", "_new.text", "_new.n_lines", "_new.n_removed")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Documents with their remaining lines, columns as in ``docs``; one that loses every line goes, since
    each of its passages stands in an earlier document."""
    out = deduplicated(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(NOT_SPACE))
    return unwrapped(out, docs.columns, F.col("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir))
    return out.select("_row.doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


#: the same rows in DuckDB's SQL; windows are compared as texts
OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), solid AS (
  SELECT doc_id, place, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS n,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS normal
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT * FROM (
    SELECT doc_id, n, normal || chr(10) || lead(normal, 1) OVER w || chr(10) || lead(normal, 2) OVER w AS win
    FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY n)
  ) WHERE win IS NOT NULL
), later AS (
  SELECT doc_id, n FROM (
    SELECT doc_id, n, row_number() OVER (PARTITION BY win ORDER BY doc_id, n) AS r FROM windows
  ) WHERE r > 1
), gone AS (
  SELECT DISTINCT s.doc_id, s.place FROM solid s JOIN later l
  ON s.doc_id = l.doc_id AND s.n BETWEEN l.n AND l.n + 2
), counted AS (
  SELECT l.doc_id,
         count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines,
         count(g.place) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, text FROM counted
"""
