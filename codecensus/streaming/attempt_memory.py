"""Keyed attempt memory over a stream of attempt events."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import rules
from ..functions.fifo import push, thin
from ..operators.runs import lesson

SUMMARY = (
    "struct<starts:bigint,successes:bigint,failures:bigint,last_run:bigint,"
    "stack:struct<at:array<bigint>,value:struct<backend:string,frontend:string,database:string>>,"
    "failed:array<struct<at:array<bigint>,error_type:string,error_message:string,context:string,"
    "lesson:string>>,"
    "decisions:array<struct<at:array<bigint>,decision:string,outcome:string>>,"
    "history:array<struct<at:array<bigint>,decision:string>>,"
    "patterns:array<struct<at:array<bigint>,pattern:string>>,"
    "issues:array<struct<at:array<bigint>,package:string,issue:string>>>"
)
EMPTY = {
    "starts": 0, "successes": 0, "failures": 0, "last_run": None, "stack": None, "failed": [],
    "decisions": [], "history": [], "patterns": [], "issues": [],
}


def merge(a: dict, b: dict) -> dict:
    """Combine two summaries.

    Lists are ordered by (time, event), so for them neither order of arrival nor the way events
    were split into summaries matters.  Patterns are offered in turn: the summary that starts
    earlier first, as a whole.
    """
    def firsts(rows, name):
        out = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            out.setdefault(r[name], r)
        return list(out.values())

    def newest(field, n):
        return sorted(a[field] + b[field], key=lambda r: r["at"])[-n:]

    decisions = sorted(a["decisions"] + b["decisions"], key=lambda r: r["at"])
    # cut at the last success; what was decided after it is kept in full
    cut = max((i for i, d in enumerate(decisions) if d["outcome"] == "success"), default=-1) + 1
    times = [t for t in (a["last_run"], b["last_run"]) if t is not None]
    stacks = [s for s in (a["stack"], b["stack"]) if s is not None]
    return {
        "starts": a["starts"] + b["starts"],
        "successes": a["successes"] + b["successes"],
        "failures": a["failures"] + b["failures"],
        "last_run": max(times) if times else None,
        "stack": max(stacks, key=lambda s: s["at"]) if stacks else None,
        "failed": newest("failed", rules.KEEP_FAILURES),
        "decisions": decisions[max(0, cut - rules.KEEP_DECISIONS):cut] + decisions[cut:],
        "history": newest("history", rules.KEEP_HISTORY),
        "patterns": push(
            [], chain(*sorted((a["patterns"], b["patterns"]), key=lambda x: x[0]["at"] if x else [])),
            rules.KEEP_PATTERNS, _pattern, _event,
        ),
        "issues": firsts(a["issues"] + b["issues"], "package"),
    }


def summarise(rows) -> dict:
    """Summary of some events of one repository."""
    out = {k: (list(v) if isinstance(v, list) else v) for k, v in EMPTY.items()}
    for r in rows:
        at = [int(r["micros"]), int(r["event_id"])]
        kind = r["kind"]
        if kind == "start":
            out["starts"] += 1
            out["last_run"] = max(at[0], out["last_run"] or at[0])
            if r["stack"] is not None and (out["stack"] is None or at > out["stack"]["at"]):
                out["stack"] = {"at": at, "value": dict(r["stack"])}
        elif kind == "failure":
            out["failures"] += 1
            out["failed"].append({
                "at": at, "error_type": r["error_type"], "error_message": r["error_message"],
                "context": r["context"], "lesson": r["lesson"],
            })
        elif kind == "success":
            out["successes"] += 1
            out["history"].append({"at": at, "decision": r["decision"]})
            for i, p in enumerate(r["patterns"] if r["patterns"] is not None else []):
                out["patterns"].append({"at": [*at, i], "pattern": p})
        elif kind == "dependency" and r["package"] is not None:
            out["issues"].append({"at": at, "package": r["package"], "issue": r["issue"]})
        if kind in ("success", "decision") and r["decision"] is not None:
            out["decisions"].append({
                "at": at, "decision": r["decision"],
                "outcome": "success" if kind == "success" else "pending",
            })
    sequence = sorted(out.pop("patterns"), key=lambda r: r["at"])
    # merging trims the lists; the pattern sequence must stay whole until it meets its state
    return {**merge({**out, "patterns": []}, EMPTY), "patterns": thin(sequence, _pattern, _event)}


def _pattern(x):
    return x["pattern"]


def _event(x):
    return tuple(x["at"][:2])


def _partials(batches):
    """Map-side combine: one summary per repository and Arrow batch."""
    import pandas as pd

    for pdf in batches:
        groups = {}
        for r in pdf.to_dict("records"):
            if r["repo_id"] is not None:
                groups.setdefault(r["repo_id"], []).append(r)
        rows = [(repo, json.dumps(summarise(g))) for repo, g in groups.items()]
        yield pd.DataFrame(rows, columns=["repo_id", "summary"])


def _begin(summary):
    return summary["patterns"][0]["at"] if summary["patterns"] else []


class AttemptMemory(StatefulProcessor):
    """State of one repository.

    What is capped (counters, stack, failures, history, patterns) is one small value. Issues, one per package without a
    limit, are a map that is written for the packages of a batch only; decisions, which pile up until a success cuts
    them, are a list that is appended to, and rewritten only by a success or by one that arrives out of order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "summary string")
        self.issues = handle.getMapState("issues", "package string", "at string, issue string")
        self.decisions = handle.getListState("decisions", "row string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        known = self.core.exists()
        held = json.loads(self.core.get()[0]) if known else {**EMPTY, "last_decision": []}
        last = held.pop("last_decision")
        decided, reported = [], {}
        for pdf in rows:
            for part in sorted(map(json.loads, pdf["summary"]), key=_begin):
                for issue in part["issues"]:
                    first = reported.setdefault(issue["package"], issue)
                    if first["at"] > issue["at"]:
                        reported[issue["package"]] = issue
                decided += part["decisions"]
                held = merge(held, {**part, "issues": [], "decisions": []})
        for issue in reported.values():
            self._report(issue, known)
        issues, decisions = list(reported.values()), []
        if decided:
            decisions = self._decide(sorted(decided, key=_at), last, known)
            last = decisions[-1]["at"]
        self.core.update((json.dumps({**held, "last_decision": last}),))
        if known:  # a repository's first rows are all there is
            issues = [{"at": json.loads(v[0]), "package": k[0], "issue": v[1]} for k, v in self.issues.iterator()]
            decisions = [json.loads(r[0]) for r in self.decisions.get()]
        text = json.dumps({**held, "issues": sorted(issues, key=_at), "decisions": sorted(decisions, key=_at)})
        yield pd.DataFrame({"repo_id": [key[0]], "summary": [text]})

    def _report(self, issue: dict, known: bool) -> None:
        """The first issue of a package stays."""
        name = (issue["package"],)
        if not (known and self.issues.containsKey(name)) or json.loads(self.issues.getValue(name)[0]) > issue["at"]:
            self.issues.updateValue(name, (json.dumps(issue["at"]), issue["issue"]))

    def _decide(self, decided: list[dict], last: list, known: bool) -> list[dict]:
        """Add decisions; gives those that were added, or all where the list was written anew."""
        if all(d["outcome"] != "success" for d in decided) and decided[0]["at"] > last:
            self.decisions.appendList([(json.dumps(d),) for d in decided])
            return decided
        held = [json.loads(r[0]) for r in self.decisions.get()] if known else []
        whole = merge({**EMPTY, "decisions": held}, {**EMPTY, "decisions": decided})["decisions"]
        self.decisions.put([(json.dumps(d),) for d in whole])
        return whole

    def close(self) -> None:
        pass


def _at(row: dict) -> list:
    return row["at"]


def attempt_memory_stream(events: DataFrame) -> DataFrame:
    """Updated memory of every repository a micro-batch touches: (repo_id, memory struct).

    Events are first reduced to one capped summary per repository and Arrow batch where they
    are read, so a repository that sends a third of all events ships a few summaries to its
    state, not its events.  Needs the RocksDB state store provider.
    """
    slim = events.select(
        "repo_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "kind", "error_type",
        F.substring("error_message", 1, rules.ERROR_MESSAGE_CHARS).alias("error_message"),
        F.substring("context", 1, rules.ERROR_NOTE_CHARS).alias("context"),
        lesson(F.col("error_type")).alias("lesson"), "decision", "patterns", "package", "issue",
        "stack",
    )
    partial = slim.mapInPandas(_partials, "repo_id string, summary string")
    updated = partial.groupBy("repo_id").transformWithStateInPandas(
        statefulProcessor=AttemptMemory(), outputStructType="repo_id string, summary string",
        outputMode="Update", timeMode="None",
    )
    return updated.select("repo_id", F.from_json("summary", SUMMARY).alias("memory"))
