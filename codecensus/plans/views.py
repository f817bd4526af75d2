"""Corpus, run and log tables derived from the given tables.

The given tables hold prose, pages, talks and events, no code.  Each view turns whole tables
into the engine's own ones by per-row expressions; ``SQL`` states the same view for the check.
Both sides read the constants below, so they cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRS = ("src", "api", "models", "components", "node_modules", "dist", "config/env", "tests",
        "docs", "pages/ui")
EXTENSIONS = (".py", ".js", ".ts", ".html", ".css", ".json", ".md", ".png")
SNIPPETS = (
    'from flask import Flask, jsonify\n@app.get("/items")\n@app.post(\'/items\')\nimport numpy as np, pandas\n',
    "import express from 'express'\nrouter.get('/users', list)\napp.post( \"/login\", auth)\n",
    "import mongoose\nDB_URL = 1\nAPI_KEY=2\nDEBUG = 3\n",
    "from fastapi import FastAPI\nfrom pydantic import BaseModel, EmailStr\n@app.delete('/gone')\n",
    "const app = require('react');\nfunction run(x) { return x + 1; } // done\n",
    "import psycopg2 as pg\nclass Store(object):\n    def save(self): pass # keep\n",
    "app.get('/items', list)\nfetch('http://localhost:5000/api')\n",
    "",
)
LOGS = (
    "Traceback\nModuleNotFoundError: No module named 'x'\n",
    "npm ERR! code 1\n",
    "BACKEND_CRASH: exit\nTypeError: bad\n",
    "error TS2304: Cannot find name\n",
    "[PREVIEW_URL] https://p.example.org/a\n[BACKEND_URL] https://b.example.org\n",
    "BUILD FAILED with FATAL ERROR\n",
)
MODELS = ("gemini-3-flash-preview", "gemini-1.5-pro", "gemini-2.0-flash", "other-model")
ERROR_TYPES = ("NODE_MODULE_NOT_FOUND", "NODE_CRASH", "NODE_SYNTAX_ERROR", "NPM_ERROR",
               "BACKEND_CRASH", "NODE_FILE_NOT_FOUND", "PYTHON_TYPE_ERROR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.col("source").alias("repo_id"), i.alias("file_ord"),
        F.concat(
            pick(DIRS, F.floor(i / 20) % 10), F.lit("/f"), i.cast("string"),
            pick(EXTENSIONS, F.floor(i / 7) % 8),
        ).alias("path"),
        F.lit("blob").alias("type"), F.md5(F.col("text").cast("binary")).alias("sha"),
        F.col("n_chars").alias("size"), F.col("text").alias("content"),
    )


def code(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).withColumn(
        "content", F.concat(pick(SNIPPETS, F.floor(F.col("file_ord") / 3) % 8), F.col("content"))
    )


def meta(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).select("repo_id", "file_ord", "path", F.col("size").alias("chars"))


def artifacts(spark, sf_dir) -> DataFrame:
    """Generated files: every document; those of low quality land in another folder.

    Documents without a label belong to the first run; every other one of them counts as of low quality.
    """
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_ord")
    return code(spark, sf_dir).join(labels, "file_ord", "left").select(
        "repo_id", F.concat(F.lit("run"), F.coalesce("toxic", F.lit(0)).cast("string")).alias("run_id"), "file_ord",
        F.when(F.coalesce("quality", F.col("file_ord") % 2) == 1, F.col("path")).otherwise(
            F.concat(F.lit("gen/"), F.substring_index("path", "/", -1))
        ).alias("filename"),
        "content",
    )


def blocks(spark, sf_dir) -> DataFrame:
    """Small repositories: twenty documents each."""
    return files(spark, sf_dir).withColumn(
        "repo_id", F.concat(F.lit("b"), F.floor(F.col("file_ord") / 20).cast("string"))
    )


def plans(spark, sf_dir) -> DataFrame:
    """One plan text per small repository that lists its labelled files, some by name only."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_ord")
    line = F.concat(
        F.lit("**BATCH "), (F.col("file_ord") % 4 + 1).cast("string"),
        F.when(F.col("quality") == 1, F.lit(" - Part **:")).otherwise(F.lit(": Part")),
        F.lit("\n  - `"),
        F.when(F.col("toxic") == 1, F.substring_index("path", "/", -1)).otherwise(F.col("path")),
        F.lit("`\n- nowhere/none.xyz\n"),
    )
    return (
        blocks(spark, sf_dir).join(labels, "file_ord")
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(F.struct("file_ord", line.alias("line")))).alias("_l"))
        .select("repo_id", F.concat(F.lit("# Plan\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "")).alias("plan"))
    )


def site(url: Column) -> Column:
    return F.regexp_extract(url, r"://([^/]+)", 1)


def pages(spark, sf_dir) -> DataFrame:
    """Pages whose anchors became image tags."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        site(F.col("url")).alias("repo_id"), F.lit("run0").alias("run_id"),
        F.col("page_id").alias("file_ord"),
        F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.replace("html", F.lit('<a href="'), F.concat(F.lit('<img alt="a" src="'), site(F.col("url")))).alias("content"),
    )


ANCHOR = r'<a href="/([^"]*)">[^<]*</a>'


def linked_pages(spark, sf_dir) -> DataFrame:
    """Pages whose anchors became script and stylesheet references, plus one script per word
    of the first page that uses it and one stylesheet per page."""
    p = table(spark, sf_dir, "pages")
    html = F.regexp_replace(
        F.regexp_replace("html", ANCHOR, '<script src="js/$1.js"></script>'),
        "</title>", '</title><link rel="stylesheet" href="/main.css">',
    )
    base = p.select(
        site(F.col("url")).alias("repo_id"), F.lit("run0").alias("run_id"), "page_id", html.alias("content"),
        F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("_words"),
    )
    page = base.select(
        "repo_id", "run_id", (F.col("page_id") * 1000).alias("file_ord"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), "content",
    )
    script = base.select(
        "repo_id", "run_id", "page_id", F.posexplode("_words").alias("_i", "_w")
    ).select(
        "repo_id", "run_id", (F.col("page_id") * 1000 + F.col("_i") + 1).alias("file_ord"),
        F.concat(F.lit("lib"), F.col("page_id").cast("string"), F.lit("/"), F.col("_w"), F.lit(".js")).alias("filename"),
        F.concat(F.lit("use('"), F.col("_w"), F.lit("')")).alias("content"),
    )
    style = base.select(
        "repo_id", "run_id", (F.col("page_id") * 1000 + 999).alias("file_ord"),
        F.concat(F.lit("css"), F.col("page_id").cast("string"), F.lit("/main.css")).alias("filename"),
        F.concat(F.lit("p{order:"), F.col("page_id").cast("string"), F.lit("}")).alias("content"),
    )
    return page.unionByName(script).unionByName(style)


def debug_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return e.select(
        "event_id", "ts",
        F.when(t == "error", "ERROR").when(t == "purchase", "WARNING").when(t == "click", "DEBUG")
        .otherwise("INFO").alias("level"),
        F.upper(t).alias("category"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("details"),
    )


def attempts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    kind = (
        F.when(t == "signup", "start").when(t == "purchase", "success").when(t == "error", "failure")
        .when(t == "click", "decision").otherwise("dependency")
    )
    none = F.lit(None)
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), "ts",
        kind.alias("kind"),
        F.when(kind == "failure", pick(ERROR_TYPES, k % 7)).alias("error_type"),
        F.when(kind == "failure", F.repeat(text("failed with "), 40)).alias("error_message"),
        F.when(kind == "failure", text("Attempt ")).alias("context"),
        F.when(kind.isin("success", "decision"), text("decision ")).alias("decision"),
        F.when(kind == "success", F.array(
            F.concat(F.lit("Runtime: "), (k % 2).cast("string")),
            F.concat(F.lit("Entrypoint: "), (k % 9).cast("string")),
        )).alias("patterns"),
        F.when(kind == "dependency", F.concat(F.lit("pkg"), (k % 10).cast("string"))).alias("package"),
        F.when(kind == "dependency", text("issue ")).alias("issue"),
        F.when((kind == "start") & (k % 3 != 0), F.struct(
            pick(("Flask", "Django"), k % 2).alias("backend"),
            F.when(k % 5 != 0, F.lit("React")).otherwise(none.cast("string")).alias("frontend"),
            none.cast("string").alias("database"),
        )).alias("stack"),
    )


def run_logs(spark, sf_dir) -> DataFrame:
    """Four attempts per run, one event each."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    run = F.floor(F.col("event_id") / 4)
    return e.select(
        F.concat(F.lit("u"), (run % 150).cast("string")).alias("repo_id"),
        F.concat(F.lit("r"), run.cast("string")).alias("run_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        F.concat(
            F.repeat(F.concat(F.col("event_type"), F.lit(" line\n")), 30), pick(LOGS, k % 6),
            F.repeat(F.lit("tail "), 120),
        ).alias("log"),
    )


def responses(spark, sf_dir) -> DataFrame:
    """One answer per turn; the role decides how well formed its tags are."""
    c = table(spark, sf_dir, "conversations")
    t, n = F.col("text"), F.col("turn").cast("string")
    body = F.concat(F.lit("\n```text\n"), t, F.lit("\n```\n"))
    double = F.concat(
        F.lit('ok\n<file path="a'), n, F.lit('.md">'), body, F.lit('</file>\n<file path="b.md">'), t,
        F.lit('</file><file path="b.md">again</file>'),
    )
    single = F.concat(F.lit("<file path='c"), n, F.lit(".md'> "), t, F.lit(" </file>"))
    spaced = F.concat(F.lit('<file path = "d'), n, F.lit('.md" >\n'), t, F.lit("</file >"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.when(F.col("role") == "assistant", double).when(F.col("role") == "user", spaced)
        .otherwise(single).alias("text"),
    )


def checkpoints(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("view", "click")).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("checkpoint_id"), "ts",
    )


def answers(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("purchase", "signup")).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("event_type") == "purchase", "modify").otherwise("continue").alias("action"),
        "ts",
    )


# ---------------------------------------------------------------- the same views as SQL

def q(text: str) -> str:
    """SQL literal; line breaks and quotes survive as escapes of a concatenation."""
    parts = text.replace("'", "''").split("\n")
    return "'" + "' || chr(10) || '".join(parts) + "'" if len(parts) > 1 else f"'{parts[0]}'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


_SQL = {
    "v_files": f"""
        SELECT source AS repo_id, doc_id AS file_ord,
               {sql_list(DIRS)}[(doc_id // 20) % 10 + 1] || '/f' || doc_id
                 || {sql_list(EXTENSIONS)}[(doc_id // 7) % 8 + 1] AS path,
               'blob' AS type, md5(text) AS sha, n_chars AS size, text AS content
        FROM documents""",
    "v_code": f"""
        SELECT repo_id, file_ord, path, type, sha, size,
               {sql_list(SNIPPETS)}[(file_ord // 3) % 8 + 1] || content AS content
        FROM v_files""",
    "v_meta": "SELECT repo_id, file_ord, path, size AS chars FROM v_files",
    "v_artifacts": """
        SELECT c.repo_id, 'run' || coalesce(l.toxic, 0) AS run_id, c.file_ord,
               CASE WHEN coalesce(l.quality, c.file_ord % 2) = 1 THEN c.path
                    ELSE 'gen/' || regexp_extract(c.path, '[^/]*$') END AS filename,
               c.content
        FROM v_code c LEFT JOIN labels l ON l.doc_id = c.file_ord""",
    "v_blocks": "SELECT * REPLACE ('b' || (file_ord // 20) AS repo_id) FROM v_files",
    "v_plans": """
        SELECT b.repo_id, '# Plan' || chr(10) || string_agg(
                 '**BATCH ' || (b.file_ord % 4 + 1)
                 || CASE WHEN l.quality = 1 THEN ' - Part **:' ELSE ': Part' END
                 || chr(10) || '  - `'
                 || CASE WHEN l.toxic = 1 THEN regexp_extract(b.path, '[^/]*$') ELSE b.path END
                 || '`' || chr(10) || '- nowhere/none.xyz' || chr(10), '' ORDER BY b.file_ord) AS plan
        FROM v_blocks b JOIN labels l ON l.doc_id = b.file_ord GROUP BY 1""",
    "v_pages": """
        SELECT regexp_extract(url, '://([^/]+)', 1) AS repo_id, 'run0' AS run_id, page_id AS file_ord,
               'pages/p' || page_id || '.html' AS filename,
               replace(html, '<a href="', '<img alt="a" src="' || regexp_extract(url, '://([^/]+)', 1)) AS content
        FROM pages""",
    "v_linked": f"""
        SELECT * FROM (
          SELECT regexp_extract(url, '://([^/]+)', 1) AS repo_id, 'run0' AS run_id,
                 page_id * 1000 AS file_ord, 'p' || page_id || '.html' AS filename,
                 replace(regexp_replace(html, {q(ANCHOR)}, '<script src="js/\\1.js"></script>', 'g'),
                         '</title>', '</title><link rel="stylesheet" href="/main.css">') AS content
          FROM pages
          UNION ALL
          SELECT repo_id, 'run0', page_id * 1000 + i, 'lib' || page_id || '/' || words[i] || '.js',
                 'use(' || chr(39) || words[i] || chr(39) || ')'
          FROM (SELECT repo_id, page_id, words, unnest(range(1, len(words) + 1)) AS i FROM (
                  SELECT regexp_extract(url, '://([^/]+)', 1) AS repo_id, page_id,
                         regexp_extract_all(html, {q(ANCHOR)}, 1) AS words FROM pages))
          UNION ALL
          SELECT regexp_extract(url, '://([^/]+)', 1), 'run0', page_id * 1000 + 999,
                 'css' || page_id || '/main.css', 'p{{order:' || page_id || '}}' FROM pages)""",
    "v_debug_log": """
        SELECT event_id, ts,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING'
                    WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
               upper(event_type) AS category, 'user ' || user_id AS message, props AS details
        FROM events""",
    "v_attempts": f"""
        SELECT event_id, 'u' || user_id AS repo_id, ts, kind, k,
               CASE WHEN kind = 'failure' THEN {sql_list(ERROR_TYPES)}[k % 7 + 1] END AS error_type,
               CASE WHEN kind = 'failure' THEN repeat('failed with ' || k, 40) END AS error_message,
               CASE WHEN kind = 'failure' THEN 'Attempt ' || k END AS context,
               CASE WHEN kind IN ('success', 'decision') THEN 'decision ' || k END AS decision,
               CASE WHEN kind = 'success' THEN ['Runtime: ' || (k % 2), 'Entrypoint: ' || (k % 9)] END AS patterns,
               CASE WHEN kind = 'dependency' THEN 'pkg' || (k % 10) END AS package,
               CASE WHEN kind = 'dependency' THEN 'issue ' || k END AS issue,
               kind = 'start' AND k % 3 <> 0 AS has_stack,
               ['Flask', 'Django'][k % 2 + 1] AS backend,
               CASE WHEN k % 5 <> 0 THEN 'React' END AS frontend
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
                     CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'success'
                          WHEN 'error' THEN 'failure' WHEN 'click' THEN 'decision'
                          ELSE 'dependency' END AS kind
              FROM events)""",
    "v_run_logs": f"""
        SELECT 'u' || ((event_id // 4) % 150) AS repo_id, 'r' || (event_id // 4) AS run_id,
               CAST(event_id % 4 + 1 AS INTEGER) AS attempt,
               repeat(event_type || ' line' || chr(10), 30)
               || {sql_list(LOGS)}[CAST(json_extract(props, '$.k') AS INTEGER) % 6 + 1]
               || repeat('tail ', 120) AS log
        FROM events""",
    "v_responses": """
        SELECT conv_id || '-' || turn AS response_id, turn, role, text AS body FROM conversations""",
    "v_checkpoints": """
        SELECT 's' || user_id AS session_id, 'c' || event_id AS checkpoint_id, ts
        FROM events WHERE event_type IN ('view', 'click')""",
    "v_answers": """
        SELECT 's' || user_id AS session_id,
               CASE WHEN event_type = 'purchase' THEN 'modify' ELSE 'continue' END AS action, ts
        FROM events WHERE event_type IN ('purchase', 'signup')""",
}
_NEEDS = {
    "v_code": ("v_files",), "v_meta": ("v_files",), "v_artifacts": ("v_code",),
    "v_blocks": ("v_files",), "v_plans": ("v_blocks",),
}


def with_views(sql: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """``sql`` behind the view definitions it needs, in order of dependence."""
    done: list[str] = []

    def add(name):
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({_SQL[n]})" for n in done]
    if more:
        ctes.append(more.strip())
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + sql
