"""Streams against their batch forms."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from codecensus.operators import memory, runs
from codecensus.schemas import ATTEMPT_EVENTS
from codecensus.streaming import attempt_memory, events

T0 = datetime.datetime(2024, 1, 1)


def events_of(spark, rows):
    """(event_id, repo, seconds, kind) as full attempt events."""
    out = []
    for i, repo, sec, kind in rows:
        out.append((
            i, repo, T0 + datetime.timedelta(seconds=sec), kind,
            "NODE_CRASH" if kind == "failure" else None, f"message {i} " * 80 if kind == "failure" else None,
            f"ctx {i}" if kind == "failure" else None, f"d{i}" if kind in ("success", "decision") else None,
            [f"P{i % 7}", f"Q{i % 3}"] if kind == "success" else None,
            f"pkg{i % 4}" if kind == "dependency" else None, f"issue {i}" if kind == "dependency" else None,
            {"backend": f"B{i}", "frontend": None, "database": "D"} if kind == "start" and i % 2 else None,
        ))
    return spark.createDataFrame(out, ATTEMPT_EVENTS)


def test_attempt_memory_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["start", "success", "failure", "decision", "dependency"]
    rows = [(i, "hot" if i % 3 == 0 else f"r{i % 5}", i * 10, rng.choice(kinds)) for i in range(300)]
    src = str(tmp_path / "in")
    for part in (rows[:100], rows[100:200], rows[200:]):  # three micro-batches
        events_of(spark, part).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        stream = spark.readStream.schema(ATTEMPT_EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        q = (attempt_memory.attempt_memory_stream(stream).writeStream.outputMode("update").format("memory")
             .queryName("attempts_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert not q.isActive
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    total = F.col("memory.starts") + F.col("memory.successes") + F.col("memory.failures") + F.size("memory.decisions") + F.size("memory.issues")
    latest = {}
    for r in spark.table("attempts_out").withColumn("n", total).orderBy("n").collect():
        if r.repo_id not in latest or r.memory.starts + r.memory.successes + r.memory.failures >= (
                latest[r.repo_id].starts + latest[r.repo_id].successes + latest[r.repo_id].failures):
            latest[r.repo_id] = r.memory
    every = events_of(spark, rows)
    rolled = {r.repo_id: r for r in memory.memory_rollup(every).collect()}
    assert set(latest) == set(rolled)
    failures, history, patterns, issues, decisions = {}, {}, {}, {}, {}
    for r in memory.recent_failures(every).orderBy("rank").collect():
        failures.setdefault(r.repo_id, []).insert(0, (r.event_id, r.error_message, r.context, r.lesson))
    for r in memory.success_history(every).orderBy("rank").collect():
        history.setdefault(r.repo_id, []).insert(0, r.event_id)
    for r in memory.success_patterns(every).orderBy("rank").collect():
        patterns.setdefault(r.repo_id, []).insert(0, r.pattern)
    for r in memory.dependency_pain_points(every).collect():
        issues.setdefault(r.repo_id, set()).add((r.package, r.issue))
    for r in memory.recent_decisions(every).collect():
        decisions.setdefault(r.repo_id, set()).add((r.event_id, r.outcome))
    for repo, m in latest.items():
        b = rolled[repo]
        assert (m.starts, m.successes, m.failures) == (b.total_attempts, b.successful_attempts, b.failed_attempts)
        assert (m.stack.value.backend if m.stack else None) == b.backend
        assert [(f["at"][1], f.error_message, f.context, f.lesson) for f in m.failed] == failures.get(repo, [])
        assert [h["at"][1] for h in m.history] == history.get(repo, [])
        assert [p.pattern for p in m.patterns][-15:] == patterns.get(repo, [])
        assert {(i.package, i.issue) for i in m.issues} == issues.get(repo, set())
        assert {(d["at"][1], d.outcome) for d in m.decisions} == decisions.get(repo, set())


def test_merge_ignores_order_and_grouping():
    rng = random.Random(9)
    rows = [{"micros": rng.randrange(500), "event_id": i, "kind": rng.choice(["start", "success", "failure", "decision", "dependency"]),
             "error_type": "E", "error_message": "m", "context": "c", "lesson": "l", "decision": f"d{i}", "patterns": None,
             "package": f"k{i % 5}", "issue": f"i{i}", "stack": {"backend": str(i), "frontend": None, "database": None}} for i in range(120)]
    whole = attempt_memory.summarise(rows)
    for size in (1, 7, 50):
        rng.shuffle(rows)
        parts = [attempt_memory.summarise(rows[i:i + size]) for i in range(0, len(rows), size)]
        while len(parts) > 1:
            parts.append(attempt_memory.merge(parts.pop(0), parts.pop(0)))
        assert parts[0] == whole


def kept_patterns(events, n):
    """The rule in its plainest form: offer all patterns of a success, then cut to the last n."""
    held = []
    for patterns in events:
        for p in patterns:
            if p not in held:
                held.append(p)
        held = held[-n:]
    return held


def test_a_success_is_cut_once():
    from codecensus.functions.fifo import push, thin

    rng = random.Random(4)
    first = lambda x: x[1]
    event = lambda x: x[0]
    for _ in range(3000):
        n, alphabet = rng.randrange(1, 6), rng.randrange(1, 9)
        events = [[rng.randrange(alphabet) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(30))]
        flat = [(i, p) for i, ps in enumerate(events) for p in ps]
        want = kept_patterns(events, n)
        assert [p for _, p in push([], flat, n, first, event)] == want
        assert [p for _, p in push([], thin(flat, first, event), n, first, event)] == want
        if events:  # cut anywhere between events and go on from there
            k = rng.randrange(len(events))
            half = push([], [x for x in flat if x[0] < k], n, first, event)
            assert [p for _, p in push(half, [x for x in flat if x[0] >= k], n, first, event)] == want
    full = [f"P{i}" for i in range(1, 16)]
    assert kept_patterns([full, ["X", "P1"]], 15) == full[1:] + ["X"]


@pytest.mark.parametrize("bucket", [60, 1000])
def test_patterns_that_come_back(spark, tmp_path, bucket):
    """More distinct patterns than are kept, evicted ones returning; batch and stream."""
    rng = random.Random(11)
    base = [(i, "hot" if i % 3 else "few", i * 10, "success") for i in range(150)]
    df = events_of(spark, base)
    names = {i: ([f"p{rng.randrange(22)}", f"q{rng.randrange(3)}"] if r == "hot" else [f"p{rng.randrange(4)}"]) for i, r, _, _ in base}
    table = spark.createDataFrame(list(names.items()), "event_id bigint, patterns array<string>")
    df = df.drop("patterns").join(table, "event_id").select(*df.columns)
    want = {repo: kept_patterns([names[i] for i, r, _, _ in base if r == repo], 15) for repo in ("hot", "few")}
    got = {}
    for r in memory.success_patterns(df, bucket=bucket).orderBy("rank").collect():
        got.setdefault(r.repo_id, []).insert(0, r.pattern)
    assert got == want
    src = str(tmp_path / "in")
    for lo in (0, 50, 100):
        df.where(f"event_id >= {lo} AND event_id < {lo + 50}").coalesce(1).orderBy("event_id").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ATTEMPT_EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    q = (attempt_memory.attempt_memory_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName(f"patterns_{bucket}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    last = {}
    for r in spark.table(f"patterns_{bucket}").orderBy("memory.successes").collect():
        last[r.repo_id] = [p.pattern for p in r.memory.patterns]
    assert last == want


LINES = [json.dumps({"type": "log", "content": "a"}), "", "  ", "{broken", json.dumps({"type": "files", "data": ["x", "y"]}),
         json.dumps({"type": "repo_files", "files": ["z"], "session_id": "s"}), "[1]", '"text"', json.dumps({"type": "log", "content": "b"})]


def test_route_events(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.ndjson").write_text("\n".join(LINES))
    seen = {}

    def sink(kind):
        return lambda df, batch_id: seen.setdefault(kind, []).extend(df.collect())

    q = events.route_events(spark.readStream.text(str(src)), {"log": sink("log"), "files": sink("files")}, str(tmp_path / "cp"), sink("bad"))
    q.awaitTermination(120)
    assert [r.content for r in seen["log"]] == ["a", "b"]
    assert json.loads(seen["files"][0].data) == ["x", "y"]
    assert sorted(r[0] for r in seen["bad"]) == sorted(["{broken", "[1]", '"text"'])
    paths = events.file_list(events.parse_events(spark.read.text(str(src)))).collect()
    assert sorted(r.path for r in paths) == ["x", "y", "z"]


def test_recent_log_buffer(spark, tmp_path):
    log = [(i, T0 + datetime.timedelta(seconds=(i * 37) % 101), "INFO", "C", f"m{i}", "{}") for i in range(100)]
    ddl = "event_id bigint, ts timestamp, level string, category string, message string, details string"
    src = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(log[k * 25:(k + 1) * 25], ddl).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    q = events.recent_log_buffer(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 20)
    q.awaitTermination(120)
    got = sorted(r.event_id for r in events.latest_version(spark, str(tmp_path / "out")).collect())
    want = sorted(r.event_id for r in runs.newest_entries(spark.createDataFrame(log, ddl), 20).collect())
    assert got == want


CHECKS = [("s1", "post_plan", 0), ("s1", "post_codegen", 700), ("s2", "post_plan", 100), ("s3", "post_plan", 50), ("s1", "post_sandbox", 1190)]
REPLIES = [("s1", "continue", 10), ("s1", "modify", 650), ("s1", "modify", 1300), ("s2", "modify", 701), ("s3", "modify", 650), ("s1", "continue", 1400)]
PAIRED = {("s1", "post_plan"): ("continue", False, 10.0), ("s1", "post_codegen"): ("modify", False, 600.0),
          ("s2", "post_plan"): ("continue", True, None), ("s3", "post_plan"): ("modify", False, 600.0),
          ("s1", "post_sandbox"): ("modify", False, 110.0)}


def at(sec):
    return T0 + datetime.timedelta(seconds=sec)


def test_checkpoint_pairing(spark, tmp_path):
    c_ddl, r_ddl = "session_id string, checkpoint_id string, ts timestamp", "session_id string, action string, feedback string, ts timestamp"
    c = spark.createDataFrame([(s, k, at(t)) for s, k, t in CHECKS], c_ddl)
    r = spark.createDataFrame([(s, a, "", at(t)) for s, a, t in REPLIES], r_ddl)
    got = {(x.session_id, x.checkpoint_id): (x.action, x.timed_out, x.wait_s) for x in events.checkpoint_pairing(c, r).collect()}
    assert got == PAIRED
    # the stream needs later rows on both sides to move the watermark past the last interval
    late_c = spark.createDataFrame([("zz", "late", at(90_000))], c_ddl)
    late_r = spark.createDataFrame([("zz", "continue", "", at(90_000))], r_ddl)
    for name, first, second in (("c", c, late_c), ("r", r, late_r)):
        first.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        second.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    cs = spark.readStream.schema(c_ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    rs = spark.readStream.schema(r_ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    q = (events.checkpoint_pairing_stream(cs, rs).writeStream.outputMode("append").format("memory").queryName("pairs_out")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = events.first_responses(spark.table("pairs_out").where("session_id <> 'zz'")).collect()
    assert {(x.session_id, x.checkpoint_id): (x.action, x.timed_out, x.wait_s) for x in out} == PAIRED


def test_checkpoints_have_one_outcome_across_batches(spark, tmp_path):
    c_ddl, r_ddl = "session_id string, checkpoint_id string, ts timestamp", "session_id string, action string, feedback string, ts timestamp"
    # per batch: checkpoints and responses; the last rows of each move the watermark
    batches = [
        ([("a", "k1", 100), ("b", "k1", 100), ("z", "w", 400)], [("z", "w", 400)]),
        ([("a", "k2", 390), ("z", "w", 500)], [("a", "stop", 450), ("a", "late second", 460), ("z", "w", 500)]),
        # one that was under way for long arrives before the answer it precedes is final
        ([("z", "w", 560)], [("a", "first", 441), ("a", "third", 530), ("z", "w", 560)]),
        ([("a", "k3", 560), ("z", "w", 1300)], [("a", "fourth", 700), ("z", "w", 1300)]),
        ([("z", "w", 5000)], [("b", "too late", 4000), ("z", "w", 5000)]),
        ([("z", "w", 9000)], [("a", "fifth", 5100), ("z", "w", 9000)]),
    ]
    for n, (asked, given) in enumerate(batches):
        spark.createDataFrame([(s, k, at(t)) for s, k, t in asked], c_ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        spark.createDataFrame([(s, x, "", at(t)) for s, x, t in given], r_ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        streams = [spark.readStream.schema(d).parquet(str(tmp_path / x)) for x, d in (("c", c_ddl), ("r", r_ddl))]
        # every start goes on from the state the last one left
        q = (events.checkpoint_pairing_stream(*streams).writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
        q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out")).where("session_id <> 'z'").collect()
    assert sorted((r.session_id, r.checkpoint_id, r.action, r.timed_out) for r in out) == [
        ("a", "k1", "first", False), ("a", "k2", "first", False), ("a", "k3", "fourth", False), ("b", "k1", "continue", True)]
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "cp"))
    assert not {"a", "b"} & {r.key[0] for r in state.collect()}


@pytest.mark.parametrize("since", ["2024-01-01 00:00:05"])
def test_log_cursor_reaches_the_scan(spark, tmp_path, since):
    from codecensus.operators.selection import log_since

    spark.createDataFrame([(1, at(1)), (2, at(9))], "event_id int, ts timestamp").write.parquet(str(tmp_path / "l"))
    df = log_since(spark.read.parquet(str(tmp_path / "l")), since)
    assert "GreaterThan(ts" in df._jdf.queryExecution().executedPlan().toString()
    assert [r.event_id for r in df.collect()] == [2]


def test_a_segment_is_offered_piece_by_piece():
    """A replay makes Python objects for a small part of its segment at a time."""
    import types

    import pyarrow as pa

    from codecensus.operators import memory

    table = pa.table({"micros": range(5000), "event_id": range(5000), "patterns": [[str(i), "x"] for i in range(5000)]})
    offered = memory._offered(table)
    assert isinstance(offered, types.GeneratorType) and next(offered) == {"micros": 0, "event_id": 0, "pattern": "0"}
    assert [r["pattern"] for r in offered] == ["x", *[v for i in range(1, 5000) for v in (str(i), "x")]]


class _State:
    """A state that only takes values: any other call fails."""

    def __init__(self):
        self.said = []

    def exists(self):
        return False

    def update(self, value):
        self.said.append(value)

    updateValue = lambda self, *pair: self.said.append(pair)
    appendList = put = update


def test_first_rows_of_a_repository_read_no_state():
    """Every read of the state is a call to the JVM; what a repository's first rows bring is all there is."""
    import json

    import pandas as pd

    blank = {"stack": None, "error_type": None, "error_message": None, "context": None, "lesson": None, "patterns": None}
    kinds = ["dependency", "decision", "success", "dependency"]
    events = [{**blank, "micros": 9 - i, "event_id": i, "kind": k, "package": "p" if k == "dependency" else None, "issue": f"i{i}",
               "decision": f"d{i}" if k != "dependency" else None} for i, k in enumerate(kinds * 2)]
    memory = attempt_memory.AttemptMemory()
    memory.core, memory.issues, memory.decisions = _State(), _State(), _State()
    rows = pd.DataFrame({"summary": [json.dumps(attempt_memory.summarise(part)) for part in (events[:3], events[3:])]})
    got = json.loads(next(memory.handleInputRows(("r",), iter([rows]), None))["summary"][0])
    want = attempt_memory.summarise(events)
    assert {k: got[k] for k in ("issues", "decisions", "successes")} == {k: want[k] for k in ("issues", "decisions", "successes")}
    assert len(memory.issues.said) == 1 and len(memory.decisions.said) == 1
