"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecensus.functions.scale import durable

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's setting under which a query's shuffle files go as soon as the query has ended (from 4.1 on; other releases pass over it)
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: and the one under which executors and their Python workers hold a few MB of a table at once, however long its rows are
_SLIM = {"spark.sql.execution.arrow.maxBytesPerBatch": "6000000"}


@contextmanager
def freed(spark: SparkSession, slim: bool = False):
    """Queries begun within give their shuffle files back as soon as they have ended; if ``slim``, rows go to Python in small batches.

    By itself Spark removes shuffle files once its driver has collected the objects that stand for them, which may take half an
    hour. This is for queries that write or give a number: they are never run again.
    """
    wanted = _CLEANUP | (_SLIM if slim else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(df: DataFrame, slim: bool = False) -> DataFrame:
    """``df`` written to the shared folder; the shuffle files behind it are given back as soon as it is written."""
    with freed(df.sparkSession, slim):
        # the setting holds for plans that are begun under it
        return durable(df.select("*"))


def table(df: DataFrame, slim: bool = False) -> DataFrame:
    """As :func:`written`, for large tables: what the driver no longer needs, written tables among it, goes as well."""
    spark = df.sparkSession
    out = written(df, slim)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have the driver collect what it no longer needs, so that Spark removes the shuffle files behind it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, or in the warehouse where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_key(columns=("doc_id", "source")) -> Column:
    """128-bit identity of a row (its id, source and whole text) that is never null."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns if c != "text"]
    return F.md5(F.concat_ws("\x1f", *parts, text_of()))


def wrapped(docs: DataFrame) -> DataFrame:
    """id, source and text with the whole row in ``_row``, so that no other column can clash."""
    return docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unwrapped(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The rows in ``_row``; with ``text``, their text is that and n_chars follows it."""
    new = {}
    if text is not None:
        df = df.withColumn("_new", text)
        new = {"text": F.col("_new"), "n_chars": F.length(F.coalesce("_new", F.lit(""))).cast("long")}
    return df.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def null_safe_join(left: DataFrame, right: DataFrame, names, how: str = "inner") -> DataFrame:
    """Equi-join on ``names`` where null meets null; the key columns are the left ones."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(renamed[f"_right_{name}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{name}" for name in names])


# -- memory of a Python worker ------------------------------------------------------------------

@lru_cache(maxsize=1)
def _malloc_trim():
    """glibc's function that gives free memory back to the system; elsewhere one that does nothing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda keep: 0


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def trimmed(function):
    """``function`` of a group or of two, after which the worker gives back what it has freed: it lives on, idle for a minute or
    under the next task, and would count with all that its largest group once took."""
    # Spark asks for the number of arguments
    if function.__code__.co_argcount == 1:
        def run(table):
            try:
                return function(table)
            finally:
                give_back()
    else:
        def run(first, second):
            try:
                return function(first, second)
            finally:
                give_back()
    return wraps(function)(run)


def trimmed_map(function):
    """The same for a function of a task's batches: workers take turns, so each counts with what its last task has left."""
    def run(batches):
        yield from function(batches)
        give_back()
    return run


# -- words and their hashes inside a task -------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True


#: bytes of text that are hashed at once, so that the arrays behind them stay small
HASHED_AT_ONCE = 400_000


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and each text's number of words.

    A-Z are lower-cased (``bytes.lower`` leaves every other byte alone). Texts are hashed in blocks of about
    ``HASHED_AT_ONCE`` bytes; a longer text is a block of its own.
    """
    values, counts, block, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
    for number, text in enumerate(texts):
        block.append(text)
        size += len(text)
        if size >= HASHED_AT_ONCE or number + 1 == len(texts):
            value, count = _hashed_block(block)
            values.append(value)
            counts.append(count)
            block, size = [], 0
    return np.concatenate(values), np.concatenate(counts)


@lru_cache(maxsize=1)
def _common_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * HASHED_AT_ONCE)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    out = []
    for base in (_MULTIPLIER, _INVERSE):
        steps = np.full(size + 1, base)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _word_values(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of all words at once: prefix sums of byte values times powers of an odd number, taken apart at the word ends."""
    power, back = _common_powers() if len(raw) <= 2 * HASHED_AT_ONCE else _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=total[1:])
    value = total[end] - total[start]
    return mixed(value * back[start] + (end - start).astype(np.uint64))


def _hashed_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts).lower()
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[raw].astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, begins))
    return _word_values(raw, start, end), counts.astype(np.int64)


def hashed_spans(texts: list[bytes], breaks: bytes, blanks: bytes) -> tuple[np.ndarray, ...]:
    """Hash, piece, text, start and end of every word. Bytes in ``breaks`` end a piece and bytes in ``blanks`` a word; a text
    ends both. Starts and ends count in the texts joined by one byte."""
    ends_word, ends_piece = np.zeros(256, bool), np.zeros(256, bool)
    ends_piece[list(breaks)] = True
    ends_word[list(breaks + blanks)] = True
    found, block, size, offset, pieces, first = [], [], 0, 0, 0, 0
    for number, text in enumerate(texts):
        block.append(text)
        size += len(text) + 1
        if size < HASHED_AT_ONCE and number + 1 < len(texts):
            continue
        raw = np.frombuffer(b"\n".join([*block, b""]).lower(), dtype=np.uint8)
        edge = np.flatnonzero(np.diff(ends_word[raw].astype(np.int8), prepend=1, append=1))
        start, end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in block])
        text_of_word = np.searchsorted(begins, start, side="right") - 1
        # a text's end is a break of its own, whatever ``breaks`` holds
        before = np.cumsum(ends_piece[raw])[start] + text_of_word if len(start) else np.zeros(0, np.int64)
        found.append((_word_values(raw, start, end), before + pieces, text_of_word + first, start + offset, end + offset))
        offset += size
        pieces += int(ends_piece[raw].sum()) + len(block)
        first += len(block)
        block, size = [], 0
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    return tuple(np.concatenate(x) for x in zip(*found))
