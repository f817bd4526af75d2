"""Attempt memory of repositories as aggregations over the event table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import rules
from ..functions.fifo import push
from ..functions.scale import BUCKET, bucket_of, durable, positions_by_range, top_rows
from .runs import lesson

AT = ("ts", "event_id")


def at() -> Column:
    return F.struct(*AT)


def memory_rollup(events: DataFrame) -> DataFrame:
    """Counters, last run, flags and the last reported stack per repository.

    A start without a stack changes the time only; a start with one sets all three values.
    """
    kind = F.col("kind")
    started = kind == "start"
    with_stack = started & F.col("stack").isNotNull()
    rolled = events.groupBy("repo_id").agg(
        F.count_if(started).alias("total_attempts"),
        F.count_if(kind == "success").alias("successful_attempts"),
        F.count_if(kind == "failure").alias("failed_attempts"),
        F.max(F.when(started, F.col("ts"))).alias("last_run"),
        F.coalesce(
            F.bool_or((kind == "success") & (F.size(F.coalesce("patterns", F.array())) > 0)),
            F.lit(False),
        ).alias("has_learned_patterns"),
        F.max_by("stack", F.when(with_stack, at())).alias("_stack"),
    )
    return rolled.select(
        "repo_id", "total_attempts", "successful_attempts", "failed_attempts", "last_run",
        (F.col("failed_attempts") > 0).alias("has_past_failures"), "has_learned_patterns",
        F.col("_stack.backend").alias("backend"), F.col("_stack.frontend").alias("frontend"),
        F.col("_stack.database").alias("database"),
    )


def recent_failures(events: DataFrame, n: int = rules.KEEP_FAILURES) -> DataFrame:
    """Last n failures per repository, newest first, with capped texts and the lesson."""
    failed = events.where(F.col("kind") == "failure").select(
        "repo_id", "ts", "event_id", "error_type",
        F.substring("error_message", 1, rules.ERROR_MESSAGE_CHARS).alias("error_message"),
        F.substring("context", 1, rules.ERROR_NOTE_CHARS).alias("context"),
        lesson(F.col("error_type")).alias("lesson"),
    )
    return top_rows(failed, ["repo_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)


def decisions_of(events: DataFrame) -> DataFrame:
    """(repo_id, ts, event_id, nth, decision, outcome): every decision, in order of time, event and place in its event.

    An event carries one ``decision`` or, where the table has that column, a list ``decisions``."""
    kind = F.col("kind")
    single = F.when(F.col("decision").isNotNull(), F.array("decision"))
    listed = F.coalesce("decisions", single) if "decisions" in events.columns else single
    return events.where(kind.isin("success", "decision")).select(
        "repo_id", "ts", "event_id", F.when(kind == "success", "success").otherwise("pending").alias("outcome"),
        F.posexplode(listed).alias("nth", "decision"),
    )


def recent_decisions(events: DataFrame, n: int = rules.KEEP_DECISIONS) -> DataFrame:
    """Kept decisions per repository, newest first, with outcome and its symbol.

    The list is cut to ``n`` only when a success adds to it, after all its decisions were added; pending
    decisions taken since the last success stay, however many there are.  So the kept rows are everything
    after that success plus the n last up to it.
    """
    rows = decisions_of(events)
    last_cut = rows.where(F.col("outcome") == "success").groupBy("repo_id").agg(
        F.max(at()).alias("_cut")
    )
    split = rows.join(last_cut, "repo_id", "left").withColumn(
        "_after", F.col("_cut").isNull() | (at() > F.col("_cut"))
    ).drop("_cut")
    kept = top_rows(split.where(~F.col("_after")), ["repo_id"], newest_first(), n).drop("rank")
    out = split.where("_after").unionByName(kept).drop("_after").withColumn(
        "symbol", F.when(F.col("outcome") == "success", "✓").otherwise("○")
    )
    # the place in a list says nothing where events carry one decision each
    return out if "decisions" in events.columns else out.drop("nth")


def newest_first() -> list[Column]:
    return [F.col(c).desc() for c in ("ts", "event_id", "nth")]


def shown_decisions(events: DataFrame, n: int = 5) -> DataFrame:
    """Last n decisions of either outcome, for display."""
    rows = decisions_of(events).select(
        "repo_id", "ts", "event_id", "nth", "decision",
        F.when(F.col("outcome") == "success", "✓").otherwise("○").alias("symbol"),
    )
    out = top_rows(rows, ["repo_id"], newest_first(), n)
    return out if "decisions" in events.columns else out.drop("nth")


def success_history(events: DataFrame, n: int = rules.KEEP_HISTORY) -> DataFrame:
    """Last n successes per repository, newest first."""
    lists = ["decisions"] if "decisions" in events.columns else []
    won = events.where(F.col("kind") == "success").select("repo_id", "ts", "event_id", "decision", *lists)
    return top_rows(won, ["repo_id"], [F.col("ts").desc(), F.col("event_id").desc()], n)


def success_patterns(
    events: DataFrame, n: int = rules.KEEP_PATTERNS, bucket: int = BUCKET
) -> DataFrame:
    """Patterns a repository keeps, newest first: distinct ones in order of entry, the last n.

    A repository that never showed more than n distinct patterns never evicts one, so order of
    first appearance is exact there and is a plain aggregate.  The others are replayed in order
    by :func:`_replayed`.
    """
    rows = events.where(F.col("kind") == "success").select(
        "repo_id", at().alias("_at"), F.posexplode("patterns").alias("_i", "pattern")
    )
    firsts = rows.groupBy("repo_id", "pattern").agg(F.min(F.struct("_at", "_i")).alias("_first"))
    many = firsts.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
    few = top_rows(
        firsts.join(many, "repo_id", "left_anti"), ["repo_id"], [F.col("_first").desc()], n
    ).select("repo_id", "pattern", F.col("_first._at.ts").alias("first_seen"), "rank")
    if many.isEmpty():
        return few
    won = events.where((F.col("kind") == "success") & (F.size("patterns") > 0))
    return few.unionByName(_replayed(won.join(many.select("repo_id"), "repo_id", "left_semi"), n, bucket))


HELD = "array<struct<micros:bigint,event_id:bigint,pattern:string>>"


def _replayed(rows: DataFrame, n: int, bucket: int) -> DataFrame:
    """The kept patterns of repositories that evict, exactly, without one task per repository.

    A repository's successes are cut into segments of ``bucket`` events.  All segments are
    replayed at once, each from the list its predecessor ended with in the round before (the
    first round guesses an empty one), until no segment starts from a different list than it
    last did.  That state is the one a single pass would reach.  A repository of one segment
    needs one round; lists of this kind forget their start quickly, so others need few.  A task
    holds one segment at a time, as columns; events are written once and read by the segments
    that are replayed, only starts and ends are written again.
    """
    flat = rows.select(
        "repo_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.col("event_id").cast("bigint").alias("event_id"), "patterns",
    )
    events = durable(
        positions_by_range(flat, ["repo_id"], ["micros", "event_id"])
        .withColumn("_seg", bucket_of("position", bucket))
        .select("repo_id", "_seg", "position", "micros", "event_id", "patterns")
    )
    empty = F.array().cast(HELD)

    def run(starts: pa.Table, segment: pa.Table) -> pa.Table:
        begin = starts.column("_start")[0].as_py()
        end = push(begin, _offered(segment.sort_by("position")), n, _name, _event)
        return starts.append_column("_end", pa.array([end], starts.schema.field("_start").type))

    def replayed(starts: DataFrame, moved: DataFrame) -> DataFrame:
        out = StructType([*starts.schema.fields, StructField("_end", starts.schema["_start"].dataType)])
        return starts.groupBy("repo_id", "_seg").cogroup(moved.groupBy("repo_id", "_seg")).applyInArrow(run, out)

    state = durable(replayed(
        events.select("repo_id", "_seg").distinct().withColumn("_start", empty), events))
    while True:
        before = state.select("repo_id", (F.col("_seg") + 1).alias("_seg"), F.col("_end").alias("_given"))
        linked = state.join(before, ["repo_id", "_seg"], "left").withColumn(
            "_given", F.coalesce("_given", empty)
        )
        moved = F.col("_given") != F.col("_start")
        if linked.where(moved).isEmpty():
            break
        again = linked.where(moved).select("repo_id", "_seg", F.col("_given").alias("_start"))
        state = durable(
            replayed(again, events.join(again.select("repo_id", "_seg"), ["repo_id", "_seg"], "left_semi"))
            .unionByName(linked.where(~moved).drop("_given"))
        )
    last = state.groupBy("repo_id").agg(F.max_by("_end", "_seg").alias("_end"))
    return last.select("repo_id", F.posexplode(F.reverse("_end")).alias("_p", "_x")).select(
        "repo_id", "_x.pattern", F.timestamp_micros("_x.micros").cast(rows.schema["ts"].dataType).alias("first_seen"),
        (F.col("_p") + 1).alias("rank"),
    )


def _offered(segment: pa.Table):
    """The patterns of a segment's events in order."""
    for batch in segment.to_batches(max_chunksize=1024):
        for micros, event_id, patterns in zip(*(batch.column(c).to_pylist() for c in ("micros", "event_id", "patterns"))):
            for p in patterns:
                yield {"micros": micros, "event_id": event_id, "pattern": p}


def _name(x):
    return x["pattern"]


def _event(x):
    return x["micros"], x["event_id"]


def dependency_pain_points(events: DataFrame) -> DataFrame:
    """First recorded issue of every package of a repository."""
    return (
        events.where((F.col("kind") == "dependency") & F.col("package").isNotNull())
        .groupBy("repo_id", "package")
        .agg(F.min(F.struct("ts", "event_id", "issue")).alias("_f"))
        .select("repo_id", "package", "_f.issue", "_f.ts")
    )


def memory_text(events: DataFrame, failures: int = 5, decisions: int = 5) -> DataFrame:
    """Text section per repository that sums up its past attempts.

    The lists it holds are capped except for dependency issues, which are one row per package;
    repositories that never started give no text.
    """
    def joined(df, order, text):
        rows = F.array_sort(F.collect_list(F.struct(order, text.alias("t"))))
        return df.groupBy("repo_id").agg(
            F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("text")
        )

    summary = memory_rollup(events).where(F.col("total_attempts") > 0)
    past = joined(
        recent_failures(events, failures).withColumn("o", -F.col("rank")), F.col("o"),
        F.concat(F.lit("  - "), F.col("error_type"), F.lit(": "), F.coalesce(F.substring("error_message", 1, 100), F.lit("")),
                 F.lit(" | "), F.col("lesson")),
    ).withColumnRenamed("text", "_f")
    good = joined(
        success_patterns(events).withColumn("o", -F.col("rank")), F.col("o"),
        F.concat(F.lit("  - "), F.col("pattern")),
    ).withColumnRenamed("text", "_p")
    pain = joined(
        dependency_pain_points(events), F.col("ts"),
        F.concat(F.lit("  - "), F.col("package"), F.lit(": "), F.col("issue")),
    ).withColumnRenamed("text", "_d")
    chosen = joined(
        shown_decisions(events, decisions).withColumn("o", -F.col("rank")), F.col("o"),
        F.concat(F.lit("  "), F.col("symbol"), F.lit(" "), F.col("decision")),
    ).withColumnRenamed("text", "_c")

    def section(title, column):
        return F.when(
            F.col(column).isNotNull(), F.concat(F.lit(title + "\n"), F.col(column), F.lit("\n"))
        ).otherwise("")

    out = summary
    for part in (past, good, pain, chosen):
        out = out.join(part, "repo_id", "left")
    stack = F.when(
        F.col("backend").isNotNull(),
        F.concat(F.lit("STACK\n  - "), F.concat_ws(" / ", "backend", "frontend", "database"), F.lit("\n")),
    ).otherwise("")
    return out.select(
        "repo_id",
        F.concat(
            F.format_string(
                "ATTEMPTS\n  - total %d, successful %d, failed %d\n  - last %s\n",
                "total_attempts", "successful_attempts", "failed_attempts",
                F.date_format("last_run", "yyyy-MM-dd'T'HH:mm:ss"),
            ),
            section("FAILURES", "_f"), section("PATTERNS", "_p"), section("DEPENDENCIES", "_d"),
            section("DECISIONS", "_c"), stack,
        ).alias("memory_text"),
    )
