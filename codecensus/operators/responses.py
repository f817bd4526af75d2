"""Multi-file model answers turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import rstrip, strip
from ..schemas import RECOMMENDATIONS, struct

PAIR = "array<struct<filename:string,content:string>>"


def clean_body(raw: Column) -> Column:
    """Strip white space, then one opening and one closing code fence."""
    c = F.regexp_replace(strip(raw), r"^```\w*\n", "")
    return F.regexp_replace(c, r"\n```\s*$", "")


def _tagged(text: Column, pattern: str) -> Column:
    full = F.lit("(?s)" + pattern)
    return F.zip_with(
        F.regexp_extract_all(text, full, F.lit(1)),
        F.regexp_extract_all(text, full, F.lit(2)),
        lambda p, c: F.struct(strip(p).alias("filename"), c.alias("content")),
    )


def _broken(text: Column) -> Column:
    """Files of an answer with unclosed or otherwise malformed tags, cut at opening tags."""
    opening = rules.FILE_TAG_OPENING
    chunks = F.filter(
        F.split(text, r"(?m)^(?=" + opening + ")"), lambda c: c.rlike("^" + opening)
    )

    def one(chunk, index):
        first_break = F.instr(chunk, "\n")
        header = F.when(first_break == 0, chunk).otherwise(F.substring(chunk, F.lit(1), first_break - 1))
        body = F.when(first_break > 0, F.substring(chunk, first_break + 1, F.length(chunk)))
        rest = F.regexp_replace(header, r"""<file\s+path\s*=\s*["'][^"']+["']>\s*""", "")
        start = F.when(strip(rest) != "", rstrip(rest))
        closing = F.instr(body, "</file")
        before = F.substring(body, F.lit(1), closing - 1)
        partial = F.substring_index(before, "\n", -1)
        whole = F.substring(before, F.lit(1), F.length(before) - F.length(partial))
        closed = F.concat(whole, F.when(strip(partial) != "", rstrip(partial)).otherwise(""))
        is_closed = F.coalesce(closing > 0, F.lit(False))
        lines = F.when(is_closed, closed).otherwise(body)
        # an opening tag that follows ends the line before it, which leaves no line behind
        bare = F.length(F.coalesce(body, F.lit(""))) == 0
        is_last = index == F.size(chunks) - 1
        empty = ~is_closed & start.isNull() & bare & (~is_last | body.isNull())
        return F.struct(
            strip(F.regexp_extract(header, "^" + opening, 1)).alias("filename"),
            F.concat_ws("\n", start, lines).alias("content"),
            empty.alias("empty"),
        )

    return F.transform(
        F.filter(F.transform(chunks, one), lambda x: ~x["empty"]),
        lambda x: F.struct(x["filename"], x["content"]),
    )


def fenced_code(text: Column) -> Column:
    """Body of the first fenced block that names one of the known languages or none, else the whole text; both
    without white space around.  The block ends at the next fence, so a fence inside it cuts it, and a fence that is never
    closed is no block; a closing fence of a block in another language opens one of its own."""
    fence = r"(?s)```(?:" + "|".join(rules.FENCE_LANGUAGES) + r")?\n(.*?)```"
    # an empty block is a block, so the match is looked for, not its body
    return strip(F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text))


def parse_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """File rows of each answer: (…answer columns…, pos, filename, content, strategy).

    Four readings are tried in turn and the first that gives a file is used; a path that
    repeats keeps its first body.  Each reading is evaluated only where the ones before it gave
    nothing, and all work happens inside the row.
    """
    t = F.col(text)
    keep = [c for c in responses.columns if c != text]

    def usable(files):
        return F.filter(files, lambda x: x["filename"] != "")

    one = usable(_tagged(t, rules.FILE_TAG_DOUBLE))
    two = usable(_tagged(t, rules.FILE_TAG_ANY_QUOTE))
    three = usable(_tagged(t, rules.FILE_TAG_SPACED))
    staged = (
        responses.withColumn("_f", one).withColumn("_s", F.lit(1))
        .withColumn("_s", F.when(F.size("_f") > 0, 1).otherwise(2))
        .withColumn("_f", F.when(F.col("_s") == 1, F.col("_f")).otherwise(two))
        .withColumn("_s", F.when(F.size("_f") > 0, F.col("_s")).otherwise(3))
        .withColumn("_f", F.when(F.col("_s") < 3, F.col("_f")).otherwise(three))
        .withColumn("_s", F.when(F.size("_f") > 0, F.col("_s")).otherwise(4))
        .withColumn("_f", F.when(F.col("_s") < 4, F.col("_f")).otherwise(_broken(t)))
    )
    names = F.transform("_f", lambda x: x["filename"])
    first = F.filter("_f", lambda x, i: F.array_position(names, x["filename"]) == i + 1)
    return staged.select(
        *keep, F.col("_s").alias("strategy"),
        F.posexplode(first).alias("pos", "_x"),
    ).select(
        *keep, "pos", "_x.filename", clean_body(F.col("_x.content")).alias("content"), "strategy"
    )


def strip_json_fence(text: Column) -> Column:
    c = F.regexp_replace(strip(text), r"^```(?:json)?\s*\n?", "")
    return strip(F.regexp_replace(c, r"\n?```\s*$", ""))


def parse_edit_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """JSON-array answers: rows of (pos, filename, content).

    Where the whole text is no JSON, the outermost ``[…]`` is tried; JSON that is no array gives
    nothing.  Elements that are not objects with both fields are dropped.
    """
    keep = [c for c in responses.columns if c != text]
    clean = strip_json_fence(F.col(text))
    array = F.when(F.try_parse_json(clean).isNull(), F.regexp_extract(clean, r"(\[[\s\S]*\])", 1)).when(
        clean.startswith("["), clean
    )
    # elements of any shape are let through and looked into one by one
    files = F.filter(
        F.transform(F.from_json(array, "array<variant>"), lambda x: F.struct(
            F.try_variant_get(x, "$.filename", "string").alias("filename"),
            F.try_variant_get(x, "$.content", "string").alias("content"),
        )),
        lambda x: x["filename"].isNotNull() & x["content"].isNotNull(),
    )
    return responses.select(*keep, F.posexplode(files).alias("pos", "_x")).select(
        *keep, "pos", "_x.filename", "_x.content"
    )


# ---------------------------------------------------------------- analysis answers

# fixed values: what is reported when an analysis answer cannot be read; {backend}, {database},
# {frontend} are filled from the repository's stack
DEFAULT_ANALYSIS = {
    "summary": "Repository uses {backend} backend with {database} database and {frontend} "
               "frontend. The codebase contains {files} files with {endpoints} API endpoints.",
    "understanding": (
        ("purpose", "A web application using {backend} for backend logic."),
        ("architecture", "Backend: {backend}, Frontend: {frontend}, Database: {database}."),
        ("data_flow", "Standard request-response pattern through API endpoints."),
    ),
    "impact": "Significant performance and maintainability improvements",
    "drawbacks": (
        ("d1", "Legacy Framework",
         "Using {backend} which may lack modern async capabilities and community support.",
         "high", "architecture"),
        ("d2", "No Modern Frontend",
         "Frontend uses {frontend} without component-based architecture.", "medium", "frontend"),
        ("d3", "Security Review Needed",
         "Auth mechanism: {auth}. Needs evaluation for modern security standards.",
         "high", "security"),
    ),
    "workflow": (
        ("Phase 1 - Discovery", "Deep Scan & Analysis",
         "Scan all files, detect tech stack, identify dependencies", "complete", "Complete", "None"),
        ("Phase 2 - Planning", "Migration Strategy",
         "Define what to preserve, what to modernize, and migration order", "pending", "~5 min", "Phase 1"),
        ("Phase 3 - Backend", "Backend Modernization",
         "Upgrade backend framework while preserving API contracts", "pending", "~15 min", "Phase 2"),
        ("Phase 4 - Frontend", "Frontend Rebuild",
         "Modernize UI with component-based framework", "pending", "~15 min", "Phase 3"),
        ("Phase 5 - Testing", "Sandbox Validation",
         "Test all endpoints and UI in isolated sandbox", "pending", "~5 min", "Phase 4"),
        ("Phase 6 - Deploy", "Create PR & Deploy",
         "Commit changes and create pull request", "pending", "~2 min", "Phase 5"),
    ),
    "recommendations": (
        ("Backend", "FastAPI / Next.js API Routes", "Modern async support, better performance", "high", "{backend}", "medium"),
        ("Frontend", "React / Next.js", "Component-based, SSR support", "high", "{frontend}", "high"),
        ("Database", "Keep current + add Prisma ORM", "Type-safe queries, auto migrations", "medium", "{database}", "medium"),
    ),
    "steps": (
        ("1", "Deep Scan", "Analyze all files and dependencies", "complete"),
        ("2", "Plan Migration", "Create preservation-first migration plan", "pending"),
        ("3", "Modernize Code", "Upgrade tech stack while preserving functionality", "pending"),
        ("4", "Test & Validate", "Run in sandbox to verify everything works", "pending"),
        ("5", "Deploy", "Commit changes and create PR", "pending"),
    ),
    "risks": ("Data loss if schemas are modified incorrectly", "API breaking changes"),
    "health_score": 50,
    "unknown": {"backend": "Unknown", "database": "Not detected", "frontend": "Not detected",
                "auth": "Not detected", "files": "0", "endpoints": "0"},
}

ROW = "struct<section:string,pos:int,key:string,title:string,detail:string,level:string>"
#: further fields of some sections
FURTHER = ("category", "current", "effort", "duration", "dependencies")


def analysis_json(text: Column) -> Column:
    """Answer without a leading fence line and a trailing fence, read as a document."""
    c = strip(text)
    c = F.when(
        c.startswith("```"),
        F.when(F.instr(c, "\n") > 0, F.regexp_replace(c, r"^[^\n]*\n", ""))
        .otherwise(F.substring(c, F.lit(4), F.length(c))),
    ).otherwise(c)
    c = F.when(c.endswith("```"), F.substring(c, F.lit(1), F.length(c) - 3)).otherwise(c)
    return F.from_json(strip(c), RECOMMENDATIONS)


def recommendation_rows(
    answers: DataFrame, stack: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """Analysis answers as rows of (section, pos, key, title, detail, level, parsed) and ``FURTHER``.

    Sections: summary, understanding, drawback, workflow, recommendation, step, risk, impact.  An answer that is not a
    JSON object gives the default rows, filled from ``stack`` (one row per repository).
    """
    keep = [c for c in answers.columns if c != text]
    doc, shape = F.col("_doc"), struct(RECOMMENDATIONS)
    known = answers.withColumn("_doc", analysis_json(F.col(text)))
    # an unreadable text comes back as a document of nulls
    ok = F.coalesce(
        *[F.when(doc[f].isNotNull(), F.lit(True)) for f in shape.fieldNames()],
        F.lit(False),
    )
    if stack is not None:
        known = known.join(stack, "repo_id", "left")
    given = set(stack.columns) if stack is not None else set()

    def fill(template):
        out = F.lit(template)
        for name, unknown in DEFAULT_ANALYSIS["unknown"].items():
            value = F.coalesce(F.col(name).cast("string"), F.lit(unknown)) if name in given else F.lit(unknown)
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    def row(section, pos, key, title, detail, level, **further):
        return F.struct(
            F.lit(section).alias("section"), pos.cast("int").alias("pos"), key.cast("string").alias("key"),
            title.alias("title"), detail.alias("detail"), level.alias("level"),
            *[further.get(name, none).cast("string").alias(name) for name in FURTHER],
        )

    def each(field, section, key, title, detail, level, *further):
        return F.transform(
            F.coalesce(doc[field], F.array().cast(shape[field].dataType)),
            lambda x, i: row(section, i, x[key], x[title], x[detail], x[level], **{name: x[name] for name in further}),
        )

    lit = F.lit
    none = F.lit(None).cast("string")
    about = doc["project_understanding"]
    said = F.filter(
        F.array(*[row("understanding", lit(i), lit(name), none, about[name], none) for i, (name, _) in enumerate(DEFAULT_ANALYSIS["understanding"])]),
        lambda x: x["detail"].isNotNull())
    read = F.concat(
        F.array(row("summary", lit(0), none, none, doc["summary"], doc["health_score"].cast("string"))),
        said,
        each("drawbacks", "drawback", "id", "title", "description", "severity", "category"),
        each("workflow_table", "workflow", "phase", "task", "description", "status", "duration", "dependencies"),
        each("recommendations", "recommendation", "category", "recommended", "reason", "priority", "current", "effort"),
        each("workflow_steps", "step", "step", "title", "description", "status"),
        F.transform(
            F.coalesce(doc["risks"], F.array().cast("array<string>")),
            lambda x, i: row("risk", i, none, none, x, none),
        ),
        F.filter(F.array(row("impact", lit(0), none, none, doc["estimated_impact"], none)), lambda x: x["detail"].isNotNull()),
    )
    d = DEFAULT_ANALYSIS
    default = F.array(
        row("summary", lit(0), none, none, fill(d["summary"]), lit(str(d["health_score"]))),
        *[row("understanding", lit(i), lit(k), none, fill(x), none) for i, (k, x) in enumerate(d["understanding"])],
        *[row("drawback", lit(i), lit(k), lit(t), fill(x), lit(s), category=lit(c))
          for i, (k, t, x, s, c) in enumerate(d["drawbacks"])],
        *[row("workflow", lit(i), lit(p), lit(t), lit(x), lit(s), duration=lit(u), dependencies=lit(n))
          for i, (p, t, x, s, u, n) in enumerate(d["workflow"])],
        *[row("recommendation", lit(i), lit(c), lit(r), lit(x), lit(p), current=fill(now), effort=lit(e))
          for i, (c, r, x, p, now, e) in enumerate(d["recommendations"])],
        *[row("step", lit(i), lit(n), lit(t), lit(x), lit(s))
          for i, (n, t, x, s) in enumerate(d["steps"])],
        *[row("risk", lit(i), none, none, lit(x), none) for i, x in enumerate(d["risks"])],
        row("impact", lit(0), none, none, lit(d["impact"]), none),
    )
    return known.withColumn("parsed", ok).select(
        *keep, "parsed", F.inline(F.when(F.col("parsed"), read).otherwise(default)),
    )
