"""Event lines routed by type, the bounded log, and answers to checkpoints."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..schemas import STREAM_EVENT

BAD = "_bad"


def parse_events(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    """One JSON object per line as a wide row; blank lines are dropped, malformed ones too
    unless ``keep_bad`` asks for them (type null, text in ``_bad``).  Works on streams."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = (
        lines.select(text.alias("value")).where(F.col("value") != "")
        .select(F.from_json(
            "value", f"{STREAM_EVENT}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
        ).alias("_e"), "value")
        .select(
            "_e.*", (F.col(f"_e.{BAD}").isNotNull() | ~F.col("value").startswith("{")).alias("_broken"),
            "value",
        )
        .withColumn(BAD, F.when(F.col("_broken"), F.col("value")))
        .drop("_broken", "value")
    )
    return rows if keep_bad else rows.where(F.col(BAD).isNull()).drop(BAD)


def file_list(events: DataFrame) -> DataFrame:
    """Paths carried by listing events, whichever of the two fields holds them."""
    paths = F.coalesce(F.col("files"), F.from_json("data", "array<string>"))
    return events.where(F.col("type").isin("files", "repo_files")).select(
        "session_id", "type", F.posexplode(paths).alias("file_ord", "path")
    )


def route_events(
    lines: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
    on_bad: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None,
):
    """Start a query that hands each type's rows of a micro-batch to its sink.

    A sink gets the batch number and must use it to write idempotently, because a batch is
    replayed after a failure.  The parsed batch is kept while it is fanned out, so its source is
    read once.
    """
    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, sink in sinks.items():
                sink(batch.where(F.col("type") == kind).drop(BAD), batch_id)
            if on_bad is not None:
                on_bad(batch.where(F.col(BAD).isNotNull()).select(BAD), batch_id)
        finally:
            batch.unpersist()

    return (
        parse_events(lines, keep_bad=True).writeStream.foreachBatch(fan_out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


# ---------------------------------------------------------------- bounded log

def recent_log_buffer(
    log: DataFrame, table: str, checkpoint: str, n: int = rules.LOG_BUFFER,
    trigger: dict | None = None,
):
    """Keep the newest n entries of a log stream in ``table``.

    Every micro-batch writes a new version folder from the one before it, named by the batch
    number, so a replayed batch overwrites its own version and nothing is applied twice.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
        before = latest_version(spark, table, below=batch_id)
        if before is not None:
            newest = (
                newest.unionByName(before)
                .orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
            )
        newest.write.mode("overwrite").parquet(f"{table}/version={batch_id}")
        # a replay of this batch needs the version before it, nothing needs older ones
        drop_versions(spark, table, below=batch_id - 1)

    return (
        log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _versions(spark, table: str):
    """(file system, {version: folder}) of the complete versions of a versioned table."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        folder = status.getPath()
        if folder.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found[int(folder.getName().split("=")[1])] = folder
    return fs, found


def latest_version(spark, table: str, below: int | None = None) -> DataFrame | None:
    """Newest complete version of a versioned table, or of those before ``below``."""
    versions = [v for v in _versions(spark, table)[1] if below is None or v < below]
    return spark.read.parquet(f"{table}/version={max(versions)}") if versions else None


def drop_versions(spark, table: str, below: int) -> None:
    fs, found = _versions(spark, table)
    for version, folder in found.items():
        if version < below:
            fs.delete(folder, True)


# ---------------------------------------------------------------- checkpoints

def micros(ts):
    """Microseconds since the epoch of either timestamp type."""
    return F.unix_micros(ts.cast("timestamp"))


def checkpoint_pairing(
    checkpoints: DataFrame, responses: DataFrame, wait: int = rules.CHECKPOINT_WAIT_SECONDS
) -> DataFrame:
    """Each checkpoint with the first response of its session within ``wait`` seconds.

    Unanswered checkpoints get the default action.  Time is cut into slices of ``wait`` seconds,
    so the answer lies in the checkpoint's own slice or the next one: a window per (session,
    slice) finds the next response in the slice, and the first response of the following slice
    is a join on equal keys.  No session is ever compared pairwise or held as a whole.
    """
    def slice_of(ts):
        # whole slices before the epoch do not occur in logs, so truncation is floor
        return F.expr(f"unix_micros(CAST(`{ts}` AS TIMESTAMP)) div {wait * 1_000_000}L")

    none = F.lit(None)
    asked = checkpoints.select(
        "session_id", "checkpoint_id", "ts", slice_of("ts").alias("_slice"),
        F.lit(1).alias("_order"), none.cast("string").alias("action"),
    )
    given = responses.select(
        "session_id", none.cast("string").alias("checkpoint_id"), "ts",
        slice_of("ts").alias("_slice"), F.lit(2).alias("_order"), "action",
    )
    answer = F.when(F.col("_order") == 2, F.struct("ts", "action"))
    ahead = (
        Window.partitionBy("session_id", "_slice").orderBy("ts", "_order", "action")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    inside = (
        asked.unionByName(given)
        .withColumn("_next", F.first(answer, ignorenulls=True).over(ahead))
        .where(F.col("_order") == 1)
    )
    first_of_slice = given.groupBy("session_id", (F.col("_slice") - 1).alias("_slice")).agg(
        F.min(F.struct("ts", "action")).alias("_later")
    )
    near = F.coalesce("_next", F.when(
        micros(F.col("_later.ts")) - micros(F.col("ts")) <= wait * 1_000_000, F.col("_later")
    ))
    return (
        inside.join(first_of_slice, ["session_id", "_slice"], "left")
        .withColumn("_hit", near)
        .select(
            "session_id", "checkpoint_id", "ts",
            F.coalesce("_hit.action", F.lit("continue")).alias("action"),
            F.col("_hit").isNull().alias("timed_out"),
            ((micros(F.col("_hit.ts")) - micros(F.col("ts"))) / F.lit(1_000_000)).alias("wait_s"),
        )
    )


class FirstResponse(StatefulProcessor):
    """State of one session: checkpoints that have no outcome yet, and responses that may still answer one.

    Nothing is decided before the watermark has passed it: a response is final once no earlier one can arrive, and a
    checkpoint has timed out once no response within its time can. A checkpoint leaves the state with its outcome, so later
    responses find nothing to answer; a response leaves once the watermark has passed it, since open checkpoints before
    it have then been answered and new ones are later. An event-time timer wakes the session for its next outcome.
    """

    def __init__(self, wait: int):
        self.wait = wait * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "micros bigint, checkpoint_id string")
        self.given = handle.getListState("given", "micros bigint, action string")

    def handleInputRows(self, key, rows, timerValues):
        asked, given = [], []
        for pdf in rows:
            for micros, is_answer, checkpoint, action in zip(pdf["micros"], pdf["is_answer"], pdf["checkpoint_id"], pdf["action"]):
                (given if is_answer else asked).append((int(micros), action if is_answer else checkpoint))
        if asked:
            self.open.appendList(asked)
        if given:
            self.given.appendList(given)
        yield from self._outcomes(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._outcomes(key, timerValues)

    def _outcomes(self, key, timerValues):
        import pandas as pd

        final = timerValues.getCurrentWatermarkInMs() * 1000
        given = sorted(((t, a) for t, a in self.given.get()), key=lambda x: (x[0], x[1] is not None, x[1]))
        times = [t for t, _ in given]
        out, still = [], []
        for asked, checkpoint in self.open.get():
            at = bisect_left(times, asked)
            answered = at < len(times) and times[at] - asked <= self.wait
            if answered and times[at] < final:
                out.append((key[0], checkpoint, asked, times[at], given[at][1], False))
            elif not answered and asked + self.wait < final:
                out.append((key[0], checkpoint, asked, None, None, True))
            else:
                still.append((asked, checkpoint))
        later = [x for x in given if x[0] >= final]
        for state, held in ((self.open, still), (self.given, later)):
            state.put(held) if held else state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ahead = [t for t, _ in later] + [t + self.wait for t, _ in still]
        if ahead:
            self.handle.registerTimer(max(min(ahead), final) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "checkpoint_id", "asked", "response", "action", "timed_out"]).astype(
                {"response": "Int64"})

    def close(self) -> None:
        pass


def checkpoint_pairing_stream(
    checkpoints: DataFrame, responses: DataFrame, wait: int = rules.CHECKPOINT_WAIT_SECONDS,
    delay: str = "1 minute",
) -> DataFrame:
    """Streaming form: one row per checkpoint, whatever the order of arrival within ``delay`` is.

    It appears once the watermark (the smaller one of the two inputs) has passed its first response, or the end of its time.
    Sessions are keys of their own; what a session holds are its open checkpoints and the responses of the last
    ``delay``. Rows that arrive later than that are dropped. Needs the RocksDB state store provider.
    """
    none = F.lit(None).cast("string")
    asked = checkpoints.withWatermark("ts", delay).select(
        "session_id", "ts", micros(F.col("ts")).alias("micros"), F.lit(False).alias("is_answer"), "checkpoint_id", none.alias("action"))
    given = responses.withWatermark("ts", delay).select(
        "session_id", "ts", micros(F.col("ts")).alias("micros"), F.lit(True).alias("is_answer"), none.alias("checkpoint_id"), "action")
    out = asked.unionByName(given).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=FirstResponse(wait),
        outputStructType="session_id string, checkpoint_id string, asked bigint, response bigint, action string, timed_out boolean",
        outputMode="Append", timeMode="EventTime",
    )
    return out.select(
        "session_id", "checkpoint_id", F.timestamp_micros("asked").alias("ts"), F.timestamp_micros("response").alias("response_ts"),
        F.when(F.col("timed_out"), F.lit("continue")).otherwise(F.col("action")).alias("action"), "timed_out")


def first_responses(pairs: DataFrame) -> DataFrame:
    """Rows of :func:`checkpoint_pairing_stream` with the waiting time; the first response of rows that repeat a checkpoint."""
    return (
        pairs.groupBy("session_id", "checkpoint_id", "ts")
        .agg(F.min(F.struct(F.col("response_ts"), "action", "timed_out")).alias("_f"))
        .select(
            "session_id", "checkpoint_id", "ts", "_f.action", "_f.timed_out",
            ((micros(F.col("_f.response_ts")) - micros(F.col("ts"))) / F.lit(1_000_000)).alias("wait_s"),
        )
    )
