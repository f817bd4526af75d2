"""Every registered query: an operator over whole given tables, and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import batching, markup, matching, memory, profile, responses, runs, selection
from ..sources import corpus, memory_store
from ..streaming import events as stream_events


from . import views
from .views import q, sql_list, with_views

BUDGET = 10_000
SIZE_LIMIT = 20_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# ---------------------------------------------------------------- SQL fragments

def s_base(x):
    return f"regexp_extract({x}, '[^/]*$')"


def s_dir(x):
    return f"regexp_extract({x}, '^(.*[^/])/+[^/]*$', 1)"


def s_ext(x):
    return rf"regexp_extract({s_base(x)}, '^\.*[^.].*?(\.[^.]*)$', 1)"


def s_strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_any(x, needles):
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def s_ends(x, suffixes):
    return "(" + " OR ".join(f"ends_with({x}, {q(s)})" for s in suffixes) + ")"


def s_in(x, values):
    return f"{x} IN (" + ", ".join(q(v) for v in values) + ")"


def s_lang(path):
    names = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.LANGUAGE_BY_NAME.items())
    exts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.LANGUAGE_BY_EXTENSION.items())
    return (f"coalesce(CASE {s_base(path)} {names} END, CASE lower({s_ext(path)}) {exts} END, "
            f"{q(rules.DEFAULT_LANGUAGE)})")


def s_first(x, table):
    return "CASE " + " ".join(f"WHEN {s_any(x, n)} THEN {q(v)}" for v, n in table) + " END"


def s_lesson(x):
    return ("CASE " + " ".join(f"WHEN contains({x}, {q(k)}) THEN {q(v)}" for k, v in rules.LESSON_RULES)
            + f" ELSE {q(rules.DEFAULT_LESSON)} END")


# ---------------------------------------------------------------- selection

def s_reason(limit):
    path = "path"
    return f"""CASE
      WHEN NOT ({s_in(f'lower({s_ext(path)})', rules.CODE_EXTENSIONS)}
                OR {s_in(s_base(path), rules.IMPORTANT_FILES)}
                OR {s_any(f'lower({path})', rules.PATH_HINTS)}) THEN 'unlisted'
      WHEN list_has_any(string_split({path}, '/'), {sql_list(rules.SKIP_DIRS)}) THEN 'skip_dir'
      WHEN {s_in(f'lower({s_ext(path)})', rules.BINARY_EXTENSIONS)} THEN 'binary_ext'
      WHEN size > {limit} THEN 'too_large' END"""


@query("eligible_files", with_views(
    f"SELECT repo_id, path, reason, reason IS NULL AS eligible FROM (SELECT *, {s_reason(SIZE_LIMIT)} AS reason FROM v_files)",
    "v_files"))
def _(spark, d):
    return selection.eligible_files(views.files(spark, d), SIZE_LIMIT).select(
        "repo_id", "path", "reason", "eligible")


@query("drop_binary_like", with_views(
    "SELECT repo_id, path FROM v_files WHERE length(content) - length(replace(content, chr(0), '')) <= 0.1 * length(content)",
    "v_files"))
def _(spark, d):
    return selection.drop_binary_like(views.files(spark, d)).select("repo_id", "path")


@query("scan_coverage", with_views(
    f"""SELECT repo_id, count(*) AS total, count(*) FILTER (fetched) AS fetched,
          count(*) FILTER (fetched) / count(*) AS ratio,
          CASE WHEN count(*) FILTER (fetched) = 0 THEN 'zero'
               WHEN count(*) FILTER (fetched) < 0.3 * count(*) THEN 'low' ELSE 'ok' END AS flag
        FROM (SELECT repo_id, {s_reason(1000)} IS NULL AS fetched FROM v_files) GROUP BY 1""",
    "v_files"))
def _(spark, d):
    marked = selection.eligible_files(views.files(spark, d), 1000).withColumn("fetched", F.col("eligible"))
    return selection.scan_coverage(marked)


@query("filter_log", with_views(
    """SELECT event_id, level, category, message, details FROM v_debug_log
       WHERE level IN ('ERROR', 'WARNING', 'INFO') AND category = 'ERROR'
         AND (contains(lower(message), '7') OR contains(lower(category), '7') OR contains(lower(details), '7'))""",
    "v_debug_log"))
def _(spark, d):
    return selection.filter_log(
        views.debug_log(spark, d), ("ERROR", "WARNING", "INFO"), "ERROR", "7"
    ).select("event_id", "level", "category", "message", "details")


@query("log_since", with_views(
    "SELECT event_id, level, category FROM v_debug_log WHERE ts > TIMESTAMP '2024-01-10 00:00:00'", "v_debug_log"))
def _(spark, d):
    import datetime

    since = datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc)
    return selection.log_since(views.debug_log(spark, d), since).select("event_id", "level", "category")


@query("conversational_requests", f"""
    SELECT conv_id, turn, is_conversational, is_conversational OR words < 5 AS needs_refine
    FROM (SELECT conv_id, turn, {s_any('lower(text)', rules.CONVERSATIONAL_PHRASES)} AS is_conversational,
            CASE WHEN {s_strip('text')} = '' THEN 0
                 ELSE len(string_split_regex({s_strip('text')}, '\\s+')) END AS words
          FROM conversations)""")
def _(spark, d):
    return selection.conversational_requests(views.table(spark, d, "conversations")).select(
        "conv_id", "turn", "is_conversational", "needs_refine")


@query("browser_side_scripts", with_views(
    f"SELECT repo_id, path, {s_any('content', rules.BROWSER_MARKERS)} AS is_client_side FROM v_code WHERE ends_with(path, '.js')",
    "v_code"))
def _(spark, d):
    return selection.browser_side_scripts(views.code(spark, d)).select("repo_id", "path", "is_client_side")


@query("selected_rows", with_views(
    "SELECT repo_id, path FROM v_files WHERE file_ord IN (SELECT doc_id FROM labels)", "v_files"))
def _(spark, d):
    keys = views.table(spark, d, "labels").select(F.col("doc_id").alias("file_ord"))
    return selection.selected_rows(views.files(spark, d), keys, "file_ord").select("repo_id", "path")


# ---------------------------------------------------------------- sources

BRANCH_SQL = "CASE lang WHEN 'en' THEN 'dev' WHEN 'fr' THEN 'master' WHEN 'de' THEN 'main' ELSE 'topic' END"


@query("resolve_branch", f"""
    SELECT repo_id, branch, snapshot FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE branch WHEN 'main' THEN 1 WHEN 'master' THEN 2 ELSE 3 END) AS rn
      FROM (SELECT source || '/' || (doc_id // 40) AS repo_id, {BRANCH_SQL} AS branch, max(doc_id) AS snapshot FROM documents GROUP BY 1, 2)
      WHERE branch IN ('main', 'master', 'dev')) WHERE rn = 1""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    snaps = docs.groupBy(
        F.concat_ws("/", "source", F.floor(F.col("doc_id") / 40).cast("string")).alias("repo_id"),
        F.expr(BRANCH_SQL).alias("branch"),
    ).agg(F.max("doc_id").alias("snapshot")).withColumn("default_branch", F.lit("dev"))
    return corpus.resolve_branch(snaps).select("repo_id", "branch", "snapshot")


@query("load_contents", with_views(
    """SELECT f.repo_id, f.path, length(f.content) AS chars, md5(f.content) AS digest,
         CASE WHEN l.quality = 1 THEN 'contents' WHEN l.toxic = 0 THEN 'raw' ELSE 'blobs' END AS store
       FROM v_files f JOIN labels l ON l.doc_id = f.file_ord""", "v_files"))
def _(spark, d):
    meta = views.files(spark, d).join(
        views.table(spark, d, "labels").withColumnRenamed("doc_id", "file_ord"), "file_ord")
    text = F.col("content").cast("binary")
    contents = meta.where("quality = 1").select("repo_id", "path", F.base64(text).alias("base64"))
    raw = meta.where("quality <> 1 AND toxic = 0").select("repo_id", "path", text.alias("bytes"))
    blobs = meta.where("quality <> 1 AND toxic <> 0").select("sha", F.base64(text).alias("base64")).dropDuplicates(["sha"])
    store = F.when(F.col("quality") == 1, "contents").when(F.col("toxic") == 0, "raw").otherwise("blobs")
    return corpus.load_contents(meta.drop("content"), contents, raw, blobs).select(
        "repo_id", "path", F.length("content").cast("bigint").alias("chars"),
        F.md5(F.col("content").cast("binary")).alias("digest"), store.alias("store"))


@query("read_env_pairs", r"""
    SELECT repo_id, path, line, trim(regexp_extract(t, '^([^=]*)=', 1)) AS key,
           trim(regexp_extract(t, '^[^=]*=(.*)$', 1)) AS value
    FROM (SELECT repo_id, path, i AS line, trim(lines[i]) AS t FROM (
            SELECT repo_id, path, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
              SELECT 'u' || user_id AS repo_id, 'app/.env' || event_id AS path,
                     string_split('# settings' || chr(10) || ' KIND = ' || event_type || chr(10) || chr(10)
                       || 'PROPS=' || props || chr(10) || 'PAIR=a=b', chr(10)) AS lines FROM events)))
    WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '=')""")
def _(spark, d):
    e = views.table(spark, d, "events")
    files = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"),
        F.concat(F.lit("app/.env"), F.col("event_id").cast("string")).alias("path"),
        F.concat(F.lit("# settings\n KIND = "), "event_type", F.lit("\n\nPROPS="), "props", F.lit("\nPAIR=a=b")).alias("content"))
    return corpus.read_env_pairs(files)


@query("forget_repo", with_views(
    "SELECT repo_id, count(*) AS events FROM v_attempts WHERE repo_id NOT IN (SELECT 'u' || item_id FROM benchmark) GROUP BY 1",
    "v_attempts"))
def _(spark, d):
    gone = views.table(spark, d, "benchmark").select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("repo_id"))
    kept = memory_store.without(views.attempts(spark, d), gone)
    return kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("events"))


@query("memory_defaults", r"""
    SELECT repo_id, any_value(0) AS total_attempts, any_value(true) AS keep_original_paths FROM (
      SELECT substring(md5(regexp_replace(trim(lower(url)), '/+$', '')), 1, 16) AS repo_id FROM pages) GROUP BY 1""")
def _(spark, d):
    repos = views.table(spark, d, "pages").select(F.col("url").alias("repo_url"))
    from ..schemas import MEMORY, struct
    none = repos.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in struct(MEMORY).fields]).where(F.lit(False))
    return memory_store.with_defaults(repos, none).select(
        "repo_id", "total_attempts", "user_preferences.keep_original_paths")


@query("scan_tree", """
    SELECT 'repo=' || (item_id % 7) AS repo_id, 'item=' || item_id AS folder, strlen(text) + 1 AS size, md5(text || chr(10)) AS digest
    FROM benchmark""")
def _(spark, d):
    """Texts written as files, one folder each, then listed and read back."""
    root = new_folder(spark, "tree")
    views.table(spark, d, "benchmark").select(
        (F.col("item_id") % 7).alias("repo"), F.col("item_id").alias("item"), "text").write.partitionBy("repo", "item").text(root)
    tree = corpus.scan_tree(spark, root).where(F.col("path").endswith(".txt"))
    read = corpus.read_contents(spark, root, tree)
    return tree.join(read, ["repo_id", "path"]).select(
        "repo_id", F.substring_index("path", "/", 1).alias("folder"), "size", F.md5("bytes").alias("digest"))


@query("write_memory", """
    SELECT substring(md5(key), 1, 16) AS repo_id, count(*) + max(CASE WHEN again THEN 1000 ELSE 0 END) AS total_attempts FROM (
      SELECT regexp_replace(trim(lower(url)), '/+$', '') AS key, page_id % 3 = 0 AS again FROM pages) GROUP BY key""")
def _(spark, d):
    """Memory of every page's address, written, replaced for those of every third page, and read back."""
    path = new_folder(spark, "memory")
    from ..functions.paths import repo_key
    pages = views.table(spark, d, "pages").select("url", (F.col("page_id") % 3 == 0).alias("again"))
    stored = pages.groupBy(repo_key(F.col("url")).alias("repo_id")).agg(
        F.min("url").alias("repo_url"), F.count(F.lit(1)).alias("total_attempts"), F.max("again").alias("again"))
    memory_store.write_memory(memory_store.with_defaults(
        stored.select("repo_url"), memory_rows(stored, F.col("total_attempts"))), path)
    replaced = stored.where("again")
    memory_store.write_memory(memory_store.with_defaults(
        replaced.select("repo_url"), memory_rows(replaced, F.col("total_attempts") + 1000)), path)
    return memory_store.read_memory(spark, path).select("repo_id", "total_attempts")


def memory_rows(rows, attempts):
    """Stored memory documents with nothing but their counts."""
    from ..schemas import MEMORY, struct
    given = {"repo_id": F.col("repo_id"), "repo_url": F.col("repo_url"), "total_attempts": attempts.cast("bigint")}
    return rows.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(MEMORY).fields])


def new_folder(spark, name):
    import uuid
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("artifact_manifest", with_views(
    """SELECT repo_id, run_id, replace(filename, ' ', '_') AS path, '100644' AS mode, 'blob' AS type,
         sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS sha, strlen(content) AS bytes
       FROM v_artifacts""".replace("\\\\", "\\"), "v_artifacts"))
def _(spark, d):
    return corpus.artifact_manifest(views.artifacts(spark, d))


@query("export_log_text", with_views(
    """SELECT event_id, '[' || strftime(ts, '%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || '] '
         || level || ' [' || category || '] ' || message || chr(10) || '  {' || chr(10) || '  "k": '
         || CAST(json_extract(details, '$.k') AS VARCHAR) || chr(10) || '}' AS line FROM v_debug_log""", "v_debug_log"))
def _(spark, d):
    return runs.log_text(views.debug_log(spark, d)).select("event_id", "line")


@query("route_events", """
    SELECT type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (
      SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'log' WHEN 'view' THEN 'debug'
               WHEN 'signup' THEN 'session' ELSE 'malformed' END AS type, 's' || user_id AS session_id FROM events)
    WHERE type <> 'malformed' GROUP BY 1""")
def _(spark, d):
    e = views.table(spark, d, "events")
    t = F.col("event_type")
    kind = F.when(t == "error", "error").when(t == "click", "log").when(t == "view", "debug").when(t == "signup", "session")
    line = F.to_json(F.struct(
        kind.alias("type"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("props").alias("content")))
    lines = e.select(F.when(t == "purchase", F.substring(line, 1, 12)).otherwise(line).alias("value")).unionAll(
        e.select(F.lit("  ").alias("value")))
    return stream_events.parse_events(lines).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


# ---------------------------------------------------------------- profile

@query("language_mix", with_views(
    f"""SELECT repo_id, language, count(*) AS files, sum(size) AS chars,
          count(*) / sum(count(*)) OVER (PARTITION BY repo_id) AS share
        FROM (SELECT repo_id, size, {s_lang('path')} AS language FROM v_files) GROUP BY 1, 2""", "v_files"))
def language_mix(spark, d):
    return profile.language_mix(views.files(spark, d))


def s_last(value):
    return f"arg_max({value}, file_ord) FILTER ({value} IS NOT NULL)"


STACK_CTE = f"""st AS (SELECT *, {s_first('lower(content)', rules.BACKEND_RULES)} AS b,
    {s_first('lower(content)', rules.DATABASE_RULES)} AS dbase, {s_first('lower(content)', rules.FRONTEND_RULES)} AS fr FROM v_code)"""


@query("stack_profile", with_views(
    f"SELECT repo_id, {s_last('b')} AS backend, {s_last('dbase')} AS database, {s_last('fr')} AS frontend FROM st GROUP BY 1",
    "v_code", more=STACK_CTE))
def _(spark, d):
    return profile.stack_profile(views.code(spark, d))


ENV_TEST = "(contains(path, '.env') OR contains(lower(path), 'config'))"
FIND_CTE = f"""
ep AS (SELECT repo_id, file_ord, path, 0 AS pass, i AS pos, upper(m[i]) || ' ' || t[i] AS value FROM (
         SELECT repo_id, file_ord, path, m, t, unnest(range(1, len(m) + 1)) AS i FROM (
           SELECT repo_id, file_ord, path, regexp_extract_all(content, {q(rules.DECORATOR_ENDPOINT)}, 1) AS m,
                  regexp_extract_all(content, {q(rules.DECORATOR_ENDPOINT)}, 2) AS t
           FROM v_code WHERE {s_any('content', rules.DECORATOR_MARKERS)}))
       UNION ALL
       SELECT repo_id, file_ord, path, 1, i, upper(m[i]) || ' ' || t[i] FROM (
         SELECT repo_id, file_ord, path, m, t, unnest(range(1, len(m) + 1)) AS i FROM (
           SELECT repo_id, file_ord, path, regexp_extract_all(content, {q(rules.CALL_ENDPOINT)}, 1) AS m,
                  regexp_extract_all(content, {q(rules.CALL_ENDPOINT)}, 2) AS t
           FROM v_code WHERE {s_any('content', rules.CALL_MARKERS)}))),
ep2 AS (SELECT *, row_number() OVER (PARTITION BY repo_id, value ORDER BY file_ord, pass, pos) AS rn FROM ep),
dbs AS (SELECT *, {s_first('lower(content)', rules.DATABASE_RULES)} AS dbase, lower(path) AS lp FROM v_code),
fnd AS (
  SELECT repo_id, 0 AS phase, file_ord, pass * 1000000 + pos AS pos, path, 'endpoint' AS kind, value FROM ep2 WHERE pass = 0 OR rn = 1
  UNION ALL SELECT repo_id, 0, file_ord, i, path, 'env_var', e[i] FROM (
    SELECT repo_id, file_ord, path, e, unnest(range(1, len(e) + 1)) AS i FROM (
      SELECT repo_id, file_ord, path, regexp_extract_all(content, {q(rules.ENV_VAR)}, 1)[1:10] AS e FROM v_code WHERE {ENV_TEST}))
  UNION ALL SELECT repo_id, 0, file_ord, 0, path, 'schema_file', path FROM dbs WHERE {s_any('lp', rules.SCHEMA_HINTS)}
  UNION ALL SELECT repo_id, 0, file_ord, 0, path, 'must_preserve', dbase || ' database connection in ' || path FROM dbs WHERE dbase IN ('MongoDB', 'PostgreSQL', 'MySQL')
  UNION ALL SELECT repo_id, 0, file_ord, 0, path, 'must_preserve', 'Prisma schema in ' || path FROM dbs WHERE dbase IS NULL AND (contains(lower(content), 'prisma') OR ends_with(path, '.prisma'))
  UNION ALL SELECT repo_id, 0, file_ord, 1, path, 'must_preserve', 'Database schema/model in ' || path FROM dbs WHERE {s_any('lp', rules.SCHEMA_HINTS)}
  UNION ALL SELECT repo_id, 0, file_ord, 2, path, 'must_preserve', 'API endpoints in ' || path FROM dbs WHERE {s_any('content', rules.DECORATOR_MARKERS)}
  UNION ALL SELECT repo_id, 0, file_ord, 3, path, 'must_preserve', 'Express API endpoints in ' || path FROM dbs WHERE {s_any('content', rules.CALL_MARKERS)} AND regexp_matches(content, {q(rules.CALL_ENDPOINT)})
  UNION ALL SELECT repo_id, 1, file_ord, 0, path, 'must_preserve', 'Core logic in ' || path FROM dbs WHERE {s_any('lp', rules.CORE_HINTS)}
  UNION ALL SELECT repo_id, 1, file_ord, 0, path, 'can_modernize', path FROM dbs WHERE NOT {s_any('lp', rules.CORE_HINTS)} AND {s_any('lp', rules.MODERNIZE_HINTS)})"""


@query("repo_findings", with_views("SELECT repo_id, phase, file_ord, path, kind, value FROM fnd", "v_code", more=FIND_CTE))
def _(spark, d):
    return profile.repo_findings(views.code(spark, d)).select("repo_id", "phase", "file_ord", "path", "kind", "value")


@query("preservation_summary", with_views(
    f"""SELECT s.repo_id, s.database, s.total_files, coalesce(c.mp, 0) AS must_preserve_count,
          coalesce(c.cm, 0) AS can_modernize_count, coalesce(c.ae, 0) AS api_endpoints_count
        FROM (SELECT repo_id, {s_last('dbase')} AS database, count(*) AS total_files FROM dbs GROUP BY 1) s
        LEFT JOIN (SELECT repo_id, count(*) FILTER (kind = 'must_preserve') AS mp, count(*) FILTER (kind = 'can_modernize') AS cm,
                     count(*) FILTER (kind = 'endpoint') AS ae FROM fnd GROUP BY 1) c USING (repo_id)""", "v_code", more=FIND_CTE))
def _(spark, d):
    code = views.code(spark, d)
    return profile.preservation_summary(code, profile.repo_findings(code))


def s_top(kind, k, name):
    return (f"coalesce((SELECT string_agg(value, '|' ORDER BY r) FROM ranked x WHERE x.repo_id = r0.repo_id "
            f"AND x.kind = '{kind}' AND r <= {k}), '') AS {name}")


@query("analysis_payload", with_views(
    f"""SELECT repo_id, {s_top('endpoint', 20, 'api_endpoints')}, {s_top('env_var', 15, 'env_vars')},
          {s_top('schema_file', 10, 'database_schemas')}, {s_top('must_preserve', 15, 'must_preserve')},
          {s_top('can_modernize', 15, 'can_modernize')}
        FROM (SELECT DISTINCT repo_id FROM v_files) r0""", "v_code", more=FIND_CTE + """,
    once AS (SELECT repo_id, kind, value, phase, file_ord, pos FROM fnd WHERE kind <> 'env_var'
             UNION ALL SELECT repo_id, kind, value, p.phase, p.file_ord, p.pos FROM (
               SELECT repo_id, kind, value, min({'phase': phase, 'file_ord': file_ord, 'pos': pos}) AS p FROM fnd WHERE kind = 'env_var' GROUP BY ALL)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY phase, file_ord, pos, value) AS r FROM once)"""))
def _(spark, d):
    code = views.code(spark, d)
    payload = profile.analysis_payload(profile.repo_findings(code), repos=code)
    return payload.select("repo_id", *[
        F.array_join(c, "|").alias(c)
        for c in ("api_endpoints", "env_vars", "database_schemas", "must_preserve", "can_modernize")])


# Sources built from each document's own words, in a layout that follows from its id: the whole text stands in a docstring,
# and strings and comments hold import lines that are none.

WORDS = "[a-z]{4,9}"
ROOTS = tuple(k for k in rules.PACKAGE_BY_IMPORT if "." not in k)


def python_files(spark, d):
    docs = views.table(spark, d, "documents")
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0))
    w = [F.coalesce(F.get(found, F.lit(i)), F.lit("none")) for i in range(6)]
    m, n = ([F.concat(F.lit(x), word) for word in w] for x in ("m_", "n_"))
    # module names of the list the library knows, two per document
    known = F.array(*map(F.lit, ROOTS))
    k0, k1 = (F.element_at(known, (F.expr(e) % len(ROOTS) + 1).cast("int")) for e in ("doc_id", "doc_id div 3"))
    body = F.translate(F.coalesce("text", F.lit("")), "\"\\", "'/")
    lit = F.lit
    head = F.concat(lit('"""Notes\nimport hidden_a\n'), body, lit('\n"""\n# import hidden_b\nt = \'it\\\'s; import hidden_c\'  # from x import y\n'))
    layouts = [
        F.concat(lit("import "), m[0], lit(", "), m[1], lit(".sub as q\nfrom "), m[2], lit(".part import ("), n[3], lit(",  # one, two\n    "),
                 n[4], lit(" as z,\n)\nimport "), k0, lit("\n")),
        F.concat(lit("if t: import "), m[0], lit("; from "), m[2], lit(" import "), n[3], lit(", \\\n    "), n[4], lit("\nimport "), k0,
                 lit(", "), k1, lit("\n")),
        F.concat(lit("try:\n    import "), m[0], lit("\nexcept ImportError: import "), k1, lit('\nx = """\nimport hidden_d\n"""; from '), m[2],
                 lit(" import *\nfrom pydantic import EmailStr, BaseModel\n")),
        F.concat(lit("from ."), m[0], lit(" import "), n[1], lit("\nfrom . import "), n[2], lit("\nfrom "), k0, lit(" import "), n[4], lit(" as a, "),
                 n[5], lit("\ny = [\n    'import hidden_e',\n]\n")),
    ]
    layout = layouts[-1]
    for i in range(len(layouts) - 1):
        layout = F.when(F.col("doc_id") % 4 == i, layouts[i]).otherwise(layout)
    return docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(head, layout).alias("content"))


IMPORT_CTE = f"""src AS (
      SELECT source, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws, {sql_list(ROOTS)} AS ks FROM documents),
    named AS (SELECT source, doc_id, list_transform(range(1, 7), lambda i: 'm_' || coalesce(ws[i], 'none')) AS m,
                     list_transform(range(1, 7), lambda i: 'n_' || coalesce(ws[i], 'none')) AS n,
                     ks[doc_id % {len(ROOTS)} + 1] AS k0, ks[(doc_id // 3) % {len(ROOTS)} + 1] AS k1 FROM src),
    imported AS (SELECT source AS repo_id, doc_id, unnest(CASE doc_id % 4
      WHEN 0 THEN [{{'root': m[1], 'names': ''}}, {{'root': m[2], 'names': ''}}, {{'root': m[3], 'names': n[4] || ',' || n[5]}}, {{'root': k0, 'names': ''}}]
      WHEN 1 THEN [{{'root': m[1], 'names': ''}}, {{'root': m[3], 'names': n[4] || ',' || n[5]}}, {{'root': k0, 'names': ''}}, {{'root': k1, 'names': ''}}]
      WHEN 2 THEN [{{'root': m[1], 'names': ''}}, {{'root': k1, 'names': ''}}, {{'root': m[3], 'names': '*'}}, {{'root': 'pydantic', 'names': 'EmailStr,BaseModel'}}]
      ELSE [{{'root': m[1], 'names': n[2]}}, {{'root': k0, 'names': n[5] || ',' || n[6]}}] END, recursive := true) FROM named)"""
IMPORT_SQL = f"WITH {IMPORT_CTE} SELECT repo_id, 'm' || doc_id || '.py' AS path, root, names FROM imported"
PACKAGE_CTE = IMPORT_CTE + f""",
    known(root, package) AS (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in rules.PACKAGE_BY_IMPORT.items())}),
    needed AS (SELECT DISTINCT repo_id, package FROM imported JOIN known USING (root)
               UNION SELECT repo_id, unnest({sql_list(rules.EMAIL_FIELD_PACKAGES)}) FROM imported WHERE root = 'pydantic' AND contains(names, 'EmailStr'))"""


def import_rows(df):
    return df.select("repo_id", "path", "root", F.array_join("names", ",").alias("names"))


@query("python_imports", IMPORT_SQL)
def _(spark, d):
    return import_rows(profile.python_imports(python_files(spark, d)))


@query("python_imports_exact", IMPORT_SQL)
def _(spark, d):
    return import_rows(profile.python_imports(python_files(spark, d), exact=True))


@query("package_lookup", f"WITH {PACKAGE_CTE} SELECT repo_id, package FROM needed")
def _(spark, d):
    return profile.package_lookup(profile.python_imports(python_files(spark, d)))


def requirement_files(spark, d):
    docs = views.table(spark, d, "documents")
    known = F.array(*map(F.lit, ROOTS))
    own = F.element_at(known, (F.expr("doc_id div 3") % len(ROOTS) + 1).cast("int"))
    return docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/requirements.txt")).alias("path"),
        F.concat(F.lit("# deps\n"), own, F.lit("==2."), (F.col("n_chars") % 3).cast("string"), F.lit("\n\nlib-"), "lang",
                 F.lit(">=1 # note\nbcrypt==3.0\n  \n")).alias("content"))


@query("merge_dependencies", f"""
    WITH {PACKAGE_CTE}, parts AS (
      SELECT DISTINCT source AS repo_id, 0 AS prec, {q(rules.PINNED_PACKAGE)} AS spec, 'pinned' AS source FROM documents
      UNION ALL SELECT DISTINCT source, 3, unnest({sql_list(rules.ALWAYS_ON_PACKAGES)}), 'always' FROM documents
      UNION ALL SELECT repo_id, 2, package, 'inferred' FROM needed
      UNION ALL SELECT source, 1, unnest([k1 || '==2.' || (n_chars % 3), 'lib-' || lang || '>=1', 'bcrypt==3.0']), 'declared'
                FROM named JOIN documents USING (source, doc_id))
    SELECT repo_id, package, spec, source FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, package ORDER BY prec, spec) AS r
      FROM (SELECT *, lower(regexp_extract(spec, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) AS package FROM parts)) WHERE r = 1""")
def _(spark, d):
    inferred = profile.package_lookup(profile.python_imports(python_files(spark, d)))
    declared = profile.declared_python_deps(requirement_files(spark, d))
    return profile.merge_dependencies(inferred, declared, views.files(spark, d))


@query("declared_node_deps", """
    SELECT repo_id, path, unnest(['express', 'lib-' || lang, 'jest']) AS package, unnest(['dependencies', 'dependencies', 'devDependencies']) AS section
    FROM (SELECT source AS repo_id, 'd' || doc_id || '/package.json' AS path, lang FROM documents)""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    files = docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/package.json")).alias("path"),
        F.concat(F.lit('{"name": "x", "dependencies": {"express": "^4", "lib-'), "lang",
                 F.lit('": "1"}, "devDependencies": {"jest": "29"}, "text": '), F.to_json(F.struct("text")), F.lit("}")).alias("content"))
    return profile.declared_node_deps(files)


LAYOUT_NAMES = ("web/package.json", "app/next.config.js", "vite.config.ts", "public/index.html", "a/page.html",
                "views/x.ejs", "shop/templates/t.html", "admin/index.php", "x/readme.md")


@query("frontend_layout", f"""
    WITH f AS (SELECT source AS repo_id, doc_id AS file_ord, 'm' || (doc_id // 20 % 6) || '/' || {sql_list(LAYOUT_NAMES)}[n_chars % 9 + 1] AS filename FROM documents),
    k AS (SELECT *, {s_dir('filename')} AS dir,
            CASE WHEN contains({s_base('filename')}, 'next.config') THEN 'Next.js' WHEN contains({s_base('filename')}, 'vite.config') THEN 'Vite'
                 WHEN {s_base('filename')} = 'package.json' AND contains(filename, 'web') THEN 'React/NPM' END AS kind,
            (ends_with(filename, '.html') AND {s_any('filename', rules.STATIC_DIR_HINTS)}) OR ends_with(filename, '.ejs') OR ends_with(filename, '.php') AS st,
            ends_with(filename, '.html') AND NOT {s_any('filename', rules.STATIC_DIR_HINTS)} AS stray FROM f),
    a AS (SELECT repo_id, coalesce(arg_max(kind, file_ord) FILTER (kind IS NOT NULL), 'unknown') AS frontend_type,
            min(file_ord) FILTER (st) AS fs, min(file_ord) FILTER (stray) AS fy FROM k GROUP BY 1)
    SELECT DISTINCT k.repo_id, k.dir, r.role, a.frontend_type FROM k JOIN a USING (repo_id), (SELECT unnest(['frontend', 'static']) AS role) r
    WHERE (r.role = 'frontend' AND kind IS NOT NULL) OR (r.role = 'static' AND (st OR (k.file_ord = a.fy AND (a.fs IS NULL OR a.fy < a.fs))))""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    files = docs.select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("file_ord"),
        F.concat(F.lit("m"), (F.floor(F.col("doc_id") / 20) % 6).cast("string"), F.lit("/"), views.pick(LAYOUT_NAMES, F.col("n_chars") % 9)).alias("filename"))
    return profile.frontend_layout(files)


@query("artifact_roles", with_views(
    """SELECT repo_id, run_id, count(*) FILTER (contains(lower(filename), 'backend') OR ends_with(filename, '.py') OR contains(lower(filename), 'api')) AS backend_files,
         count(*) FILTER (contains(lower(filename), 'frontend') OR ends_with(filename, '.html') OR ends_with(filename, '.css') OR ends_with(filename, '.jsx') OR ends_with(filename, '.tsx')) AS frontend_files,
         count(*) FILTER (filename IN ('requirements.txt', 'package.json', '.env', 'Dockerfile')) AS config_files
       FROM v_artifacts GROUP BY 1, 2""", "v_artifacts"))
def _(spark, d):
    return profile.artifact_roles(views.artifacts(spark, d))





@query("path_hygiene", r"""
    WITH p AS (SELECT source AS repo_id, path, regexp_replace(regexp_replace(replace(regexp_replace(path, '[()\[\]{}@#$&*?!|;<>`''"]', '', 'g'), ' ', '_'), '_{2,}', '_', 'g'), '/{2,}', '/', 'g') AS safe_path
               FROM (SELECT source, 'd' || (n_chars % 50) || '//' || replace(text, chr(10), ' ') || '$x' AS path FROM documents))
    SELECT repo_id, path, safe_path, count(*) OVER (PARTITION BY repo_id, safe_path) AS sharing, safe_path <> path AS changed,
           count(*) OVER (PARTITION BY repo_id, safe_path) > 1 AS collides FROM p""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    files = docs.select(F.col("source").alias("repo_id"), F.concat(
        F.lit("d"), (F.col("n_chars") % 50).cast("string"), F.lit("//"),
        F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("$x")).alias("path"))
    return profile.path_hygiene(files).select("repo_id", "path", "safe_path", "sharing", "changed", "collides")


@query("repo_dimension", r"""
    SELECT repo_id, r.u AS repo_url, r.o AS owner, r.n AS name, seen, r.o IS NOT NULL AS is_valid FROM (
      SELECT substring(md5(regexp_replace(trim(lower(u)), '/+$', '')), 1, 16) AS repo_id,
             min({'u': u, 'o': nullif(regexp_extract(u, 'github\.com/([^/]+)/([^/.]+)', 1), ''), 'n': nullif(regexp_extract(u, 'github\.com/([^/]+)/([^/.]+)', 2), '')}) AS r,
             count(*) AS seen
      FROM (SELECT CASE WHEN contains(url, '?') THEN url ELSE 'https://github.com/Own' || (page_id % 7) || '/repo-' || (length(html) % 5) || '.git' END AS u FROM pages)
      GROUP BY 1)""")
def _(spark, d):
    p = views.table(spark, d, "pages")
    url = F.when(F.col("url").contains("?"), F.col("url")).otherwise(F.concat(
        F.lit("https://github.com/Own"), (F.col("page_id") % 7).cast("string"), F.lit("/repo-"),
        (F.length("html") % 5).cast("string"), F.lit(".git")))
    return profile.repo_dimension(p.select(url.alias("repo_url")))


@query("combined_entries", with_views(
    """SELECT repo_id, path, false AS is_new, size AS chars FROM v_files f
       WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.repo_id = f.repo_id AND a.filename = f.path)
       UNION ALL SELECT repo_id, filename, true, length(content) FROM v_artifacts""", "v_files", "v_artifacts"))
def _(spark, d):
    return matching.combined_entries(views.files(spark, d), views.artifacts(spark, d))


@query("entry_counts", with_views(
    """SELECT repo_id, count(*) FILTER (is_new) AS new_files, count(*) FILTER (NOT is_new) AS existing_files FROM (
         SELECT repo_id, false AS is_new FROM v_files f
         WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.repo_id = f.repo_id AND a.filename = f.path)
         UNION ALL SELECT repo_id, true FROM v_artifacts) GROUP BY 1""", "v_files", "v_artifacts"))
def _(spark, d):
    return matching.entry_counts(matching.combined_entries(views.files(spark, d), views.artifacts(spark, d)))


@query("directory_rollup", with_views(
    """SELECT repo_id, node_path, min(i) AS depth, bool_or(i < n) AS is_folder, count(*) AS files, sum(chars) AS chars, bool_or(is_new) AS has_new,
         regexp_extract(node_path, '[^/]*$') AS name, regexp_extract(node_path, '^(.*)/[^/]*$', 1) AS parent_path
       FROM (SELECT repo_id, chars, is_new, n, i, array_to_string(parts[1:i], '/') AS node_path FROM (
               SELECT repo_id, size AS chars, quality IS NOT NULL AS is_new, string_split(path, '/') AS parts, len(string_split(path, '/')) AS n,
                      unnest(range(1, len(string_split(path, '/')) + 1)) AS i
               FROM v_files LEFT JOIN labels ON doc_id = file_ord)) GROUP BY 1, 2""", "v_files"))
def _(spark, d):
    labels = views.table(spark, d, "labels").select(F.col("doc_id").alias("file_ord"), F.lit(True).alias("is_new"))
    entries = views.files(spark, d).join(labels, "file_ord", "left").select(
        "repo_id", "path", F.coalesce("is_new", F.lit(False)).alias("is_new"), F.col("size").alias("chars"))
    return profile.directory_rollup(entries)


def s_tokens():
    def pats(line):
        from ..operators.profile import token_pattern
        return (f"CASE WHEN tl = 'py' THEN regexp_extract_all({line}, {q(token_pattern('py'))}, 0) "
                f"WHEN tl IN ('js', 'css', 'json') THEN regexp_extract_all({line}, {q(token_pattern('js'))}, 0) "
                f"WHEN tl = 'html' THEN regexp_extract_all({line}, {q(token_pattern('html'))}, 0) "
                f"ELSE regexp_extract_all({line}, {q(token_pattern('other'))}, 0) END")
    exts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.TOKEN_LANGUAGE_BY_EXTENSION.items())
    return f"""
    tl AS (SELECT repo_id, coalesce(CASE lower(regexp_extract(path, '[^.]*$')) {exts} END, 'other') AS tl, unnest(string_split(content, chr(10))) AS line FROM v_code),
    tk AS (SELECT repo_id, tl, unnest({pats('line')}) AS t FROM tl),
    tw AS (SELECT *, regexp_matches(t, '^[A-Za-z0-9_$]+\\($') AS called, regexp_replace(t, '\\($', '') AS w FROM tk),
    tc AS (SELECT repo_id, tl, CASE
        WHEN (tl = 'py' AND starts_with(t, '#')) OR (tl IN ('js', 'css', 'json') AND starts_with(t, '//')) OR (tl = 'html' AND starts_with(t, '<!--')) THEN 'comment'
        WHEN left(t, 1) IN ('"', '''', '`') THEN 'string'
        WHEN regexp_matches(t, '^\\s?@') THEN 'decorator'
        WHEN regexp_matches(t, '^[0-9]') THEN 'number'
        WHEN regexp_matches(t, '^[()\\[\\]{{}}]') THEN 'bracket'
        WHEN regexp_matches(t, '^[=><+\\-*/%!&|^~?:;,.]') THEN 'operator'
        WHEN (tl = 'py' AND {s_in('w', rules.PYTHON_KEYWORDS)}) OR (tl <> 'py' AND {s_in('w', rules.SCRIPT_KEYWORDS)}) THEN 'keyword'
        WHEN regexp_matches(w, '^[A-Z]') AND length(w) > 1 THEN 'type'
        WHEN called THEN 'function' END AS class, called FROM tw)"""


@query("token_profile", with_views(
    """SELECT repo_id, tl AS token_language, class, count(*) AS tokens FROM (
         SELECT repo_id, tl, class FROM tc WHERE class IS NOT NULL UNION ALL SELECT repo_id, tl, 'bracket' FROM tc WHERE called) GROUP BY 1, 2, 3""",
    "v_code", more=s_tokens()))
def _(spark, d):
    return profile.token_profile(views.code(spark, d))


# ---------------------------------------------------------------- matching and sets

@query("model_budget", f"""
    SELECT doc_id, CASE {sql_list(views.MODELS)}[n_chars % 4 + 1] WHEN 'gemini-3-flash-preview' THEN 700000
      WHEN 'gemini-1.5-pro' THEN 1400000 WHEN 'gemini-2.0-flash' THEN 600000 ELSE 400000 END AS budget FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return matching.model_budget(docs.select("doc_id", views.pick(views.MODELS, F.col("n_chars") % 4).alias("model"))).select("doc_id", "budget")


@query("missing_files", with_views(
    f"""SELECT repo_id, path, count(*) OVER (PARTITION BY repo_id) <= 15 AS recoverable FROM v_files f
        WHERE NOT EXISTS (SELECT 1 FROM made a WHERE a.repo_id = f.repo_id AND a.filename = f.path)
          AND NOT EXISTS (SELECT 1 FROM made a WHERE a.repo_id = f.repo_id AND {s_base('a.filename')} = {s_base('f.path')})""",
    "v_files", "v_artifacts", more="made AS (SELECT * FROM v_artifacts WHERE file_ord IN (SELECT doc_id FROM labels))"))
def _(spark, d):
    # every file is asked for, but a run made only the labelled ones
    labels = views.table(spark, d, "labels").select(F.col("doc_id").alias("file_ord"))
    return matching.missing_files(views.files(spark, d), views.artifacts(spark, d).join(labels, "file_ord", "left_semi"))


@query("remaining_files", with_views(
    """SELECT repo_id, path, 'Remaining Files' AS batch_name FROM v_files f
       WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.repo_id = f.repo_id AND a.filename = f.path)""", "v_files", "v_artifacts"))
def _(spark, d):
    taken = views.artifacts(spark, d).select("repo_id", F.col("filename").alias("path"))
    return matching.remaining_files(views.files(spark, d), taken).select("repo_id", "path", "batch_name")


PLAN_CTE = rf"""
pl AS (SELECT repo_id, i, regexp_replace(lines[i], '^\s+|\s+$', '', 'g') AS t FROM (
         SELECT repo_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT repo_id, string_split(plan, chr(10)) AS lines FROM v_plans))),
ph AS (SELECT *, count(*) FILTER (regexp_matches(t, {q(batching.PLAN_HEADER)})) OVER (PARTITION BY repo_id ORDER BY i) AS h FROM pl),
hd AS (SELECT repo_id, h, regexp_replace(trim(regexp_extract(t, {q(batching.PLAN_HEADER)}, 1)), ':+$', '') AS batch_name FROM ph WHERE regexp_matches(t, {q(batching.PLAN_HEADER)})),
pp AS (SELECT ph.repo_id, ph.h - 1 AS batch_ord, hd.batch_name, ph.i - 1 AS item_ord,
         regexp_replace(trim(t[3:]), '^[`"'']+|[`"'']+$', '', 'g') AS planned_path
       FROM ph JOIN hd USING (repo_id, h) WHERE starts_with(t, '- '))"""


@query("parse_plan", with_views("SELECT * FROM pp", "v_plans", more=PLAN_CTE))
def _(spark, d):
    return batching.parse_plan(views.plans(spark, d))


MATCH_CTE = PLAN_CTE + f""",
mt AS (SELECT repo_id, batch_ord, batch_name, item_ord, planned_path, path, file_ord, match_kind FROM (
         SELECT p.*, f.path, f.file_ord, CASE WHEN f.path = planned_path THEN 'exact' ELSE 'fuzzy' END AS match_kind,
                row_number() OVER (PARTITION BY p.repo_id, p.item_ord ORDER BY CASE WHEN f.path = planned_path THEN 0 ELSE 1 END, f.file_ord) AS rn
         FROM pp p JOIN v_blocks f ON f.repo_id = p.repo_id AND (f.path = planned_path OR ends_with(f.path, planned_path) OR ends_with(planned_path, f.path)
              OR {s_base('f.path')} = {s_base('planned_path')})) WHERE rn = 1)"""


@query("match_plan_paths", with_views("SELECT * FROM mt", "v_plans", "v_blocks", more=MATCH_CTE))
def _(spark, d):
    return batching.plan_assignments(views.plans(spark, d), views.blocks(spark, d))





# every line of every document is an element's text; those of 3 to 199 characters are searched for
@query("locate_content", with_views(
    """SELECT DISTINCT s.repo_id, s.sel_id, a.filename FROM (
         SELECT repo_id, sel_id, line[1:30] AS needle FROM (
           SELECT 'b' || (doc_id // 20) AS repo_id, doc_id AS sel_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line
           FROM documents) WHERE length(line) > 2 AND length(line) < 200) s
       JOIN (SELECT repo_id, path AS filename, content FROM v_blocks) a ON a.repo_id = s.repo_id
       WHERE NOT ends_with(a.filename, '.py') AND contains(a.content, s.needle)""", "v_blocks"))
def _(spark, d):
    docs = views.table(spark, d, "documents")
    none = F.lit("")
    picks = docs.select(
        F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")).alias("repo_id"), F.col("doc_id").alias("sel_id"),
        F.explode(F.split("text", "\n")).alias("text"), none.alias("element_id"), none.alias("src"))
    arts = views.blocks(spark, d).withColumnRenamed("path", "filename")
    return matching.locate_content(picks, arts)


# what stands behind a document's last blank is the source that is looked for
@query("locate_first_source", with_views(
    """SELECT repo_id, sel_id, filename FROM (
         SELECT s.repo_id, s.sel_id, a.filename, row_number() OVER (PARTITION BY s.repo_id, s.sel_id ORDER BY a.file_ord) AS rn
         FROM (SELECT 'b' || (doc_id // 20) AS repo_id, doc_id AS sel_id, string_split(text, ' ')[-1] AS needle FROM documents) s
         JOIN v_blocks b ON b.repo_id = s.repo_id AND contains(b.content, s.needle)
         JOIN (SELECT repo_id, file_ord, path AS filename FROM v_blocks) a ON a.repo_id = b.repo_id AND a.file_ord = b.file_ord
         WHERE needle <> '') WHERE rn = 1""", "v_blocks"))
def _(spark, d):
    docs = views.table(spark, d, "documents")
    none = F.lit("")
    picks = docs.select(
        F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")).alias("repo_id"), F.col("doc_id").alias("sel_id"),
        none.alias("text"), none.alias("element_id"), F.substring_index("text", " ", -1).alias("src"))
    arts = views.blocks(spark, d).withColumnRenamed("path", "filename")
    return matching.locate_content(picks, arts, first_src_only=True)


@query("upsert_artifacts", with_views(
    """SELECT a.repo_id, a.run_id, a.file_ord, a.filename, md5(coalesce(e.content, a.content)) AS digest, e.content IS NOT NULL AS edited
       FROM v_artifacts a LEFT JOIN ed e USING (repo_id, run_id, filename)
       UNION ALL SELECT repo_id, run_id, m.mx + 1 + edit_ord, filename, md5(content), true
       FROM ed LEFT JOIN (SELECT repo_id, run_id, max(file_ord) AS mx FROM v_artifacts GROUP BY 1, 2) m USING (repo_id, run_id)
       WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.repo_id = ed.repo_id AND a.run_id = ed.run_id AND a.filename = ed.filename)""",
    "v_artifacts", more="""ed AS (SELECT f.repo_id, 'run' || l.toxic AS run_id, f.path AS filename, 'edited ' || f.content AS content, f.file_ord AS edit_ord
       FROM v_code f JOIN labels l ON l.doc_id = f.file_ord)"""))
def _(spark, d):
    labels = views.table(spark, d, "labels").withColumnRenamed("doc_id", "file_ord")
    edits = views.code(spark, d).join(labels, "file_ord").select(
        "repo_id", F.concat(F.lit("run"), F.col("toxic").cast("string")).alias("run_id"), F.col("path").alias("filename"),
        F.concat(F.lit("edited "), "content").alias("content"), F.col("file_ord").alias("edit_ord"))
    return matching.upsert_artifacts(views.artifacts(spark, d), edits).select(
        "repo_id", "run_id", "file_ord", "filename", F.md5(F.col("content").cast("binary")).alias("digest"), "edited")


# documents as answers: a fenced block, one never closed, one inside another, one in a language that is none, no fence
FENCED = {
    0: ("Here:\n```python\n", "\n```\nDone."), 1: ("```bash\n", "\n and so on"), 2: ("```javascript\na\n```python\n", "\n```\nb\n```\n"),
    3: ("```rust\n", "\n```\nbetween\n```\n last \n```"), 4: (" \t", "\n\n"),
}


def fenced_sql():
    cases = " ".join(f"WHEN {k} THEN {q(a)} || text || {q(b)}" for k, (a, b) in FENCED.items())
    fence = "'(?s)```(?:" + "|".join(rules.FENCE_LANGUAGES) + ")?\n(.*?)```'"
    body = f"CASE WHEN regexp_matches(answer, {fence}) THEN regexp_extract(answer, {fence}, 1) ELSE answer END"
    return f"SELECT doc_id, md5(code) AS digest, length(code) AS chars FROM (SELECT doc_id, {s_strip(body)} AS code FROM (SELECT doc_id, CASE doc_id % 5 {cases} END AS answer FROM documents))"


@query("fenced_code", fenced_sql())
def _(spark, d):
    docs = views.table(spark, d, "documents")
    answer = F.lit(None)
    for k, (before, after) in FENCED.items():
        answer = F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(before), "text", F.lit(after))).otherwise(answer)
    code = responses.fenced_code(answer)
    return docs.select("doc_id", F.md5(code.cast("binary")).alias("digest"), F.length(code).cast("bigint").alias("chars"))


# ---------------------------------------------------------------- batching

def s_pack(groups, order="item_ord"):
    """Recursive one-by-one packing of ``groups`` (g, item_ord, chars, …)."""
    return f"""
    od AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS rn FROM {groups}),
    pk AS (SELECT g, rn, chars AS acc, 1 AS part FROM od WHERE rn = 1
           UNION ALL SELECT o.g, o.rn, CASE WHEN p.acc + o.chars > {BUDGET} THEN o.chars ELSE p.acc + o.chars END,
                            CASE WHEN p.acc + o.chars > {BUDGET} THEN p.part + 1 ELSE p.part END
           FROM pk p JOIN od o ON o.g = p.g AND o.rn = p.rn + 1),
    pd AS (SELECT od.*, pk.part, max(pk.part) OVER (PARTITION BY g) AS parts FROM od JOIN pk USING (g, rn))"""


GROUP_SQL = f"""SELECT *, CASE WHEN cfg THEN 0 ELSE 1 END AS batch_rank, CASE WHEN cfg THEN '' ELSE dir END AS batch_key,
    CASE WHEN cfg THEN 'Config & Dependencies' WHEN dir = 'root' THEN 'Root Files' ELSE replace(dir, '/', ' > ') END AS nm
  FROM (SELECT *, ({s_in(s_base('path'), rules.CONFIG_NAMES)} OR {s_in(s_ext('path'), rules.CONFIG_EXTENSIONS)}) AS cfg,
               coalesce(nullif({s_dir('path')}, ''), 'root') AS dir FROM {{src}})"""
BATCH_OUT = """repo_id, batch_rank, batch_key, CASE WHEN parts > 1 THEN nm || ' (Part ' || part || ')' ELSE nm END AS batch_name,
    part, parts, file_ord, path, chars"""
BATCH_COLS = ("repo_id", "batch_rank", "batch_key", "batch_name", "part", "parts", "file_ord", "path", "chars")
DIR_CTE = f"""gr AS (SELECT *, repo_id || '|' || batch_rank || '|' || batch_key AS g, file_ord AS item_ord FROM ({GROUP_SQL.format(src='v_meta')})),""" + s_pack("gr")


@query("directory_batches", with_views(f"SELECT {BATCH_OUT} FROM pd", "v_meta", more=DIR_CTE, recursive=True))
def directory_batches(spark, d):
    return batching.directory_batches(views.meta(spark, d), BUDGET).select(*BATCH_COLS)


@query("top_level_groups", with_views(
    "SELECT repo_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS batch_name, count(*) AS files FROM v_meta GROUP BY 1, 2", "v_meta"))
def _(spark, d):
    return batching.top_level_groups(views.meta(spark, d)).groupBy("repo_id", "batch_name").agg(F.count(F.lit(1)).alias("files"))


@query("pack_by_budget", with_views(
    "SELECT repo_id, file_ord, path, chars, part, parts FROM pd", "v_meta",
    more="gr AS (SELECT *, repo_id AS g, file_ord AS item_ord FROM v_meta)," + s_pack("gr"), recursive=True))
def _(spark, d):
    return batching.pack_by_budget(views.meta(spark, d), ["repo_id"], BUDGET).select(
        "repo_id", "file_ord", "path", "chars", "part", "parts")


@query("batch_sizes", with_views(
    f"SELECT repo_id, batch_rank, batch_key, batch_name, part, count(*) AS files, sum(chars) AS chars FROM (SELECT {BATCH_OUT} FROM pd) GROUP BY 1, 2, 3, 4, 5",
    "v_meta", more=DIR_CTE, recursive=True))
def _(spark, d):
    return batching.batch_sizes(batching.directory_batches(views.meta(spark, d), BUDGET))


@query("number_batches", with_views(
    f"""SELECT repo_id, batch_rank, batch_key, batch_name, part, row_number() OVER (PARTITION BY repo_id ORDER BY batch_rank, batch_key, part) - 1 AS batch_number
        FROM (SELECT DISTINCT repo_id, batch_rank, batch_key, batch_name, part FROM (SELECT {BATCH_OUT} FROM pd))""", "v_meta", more=DIR_CTE, recursive=True))
def _(spark, d):
    return batching.number_batches(batching.directory_batches(views.meta(spark, d), BUDGET)).select(
        "repo_id", "batch_rank", "batch_key", "batch_name", "part", "batch_number")


PLAN_BATCH_CTE = MATCH_CTE + f""",
bm AS (SELECT repo_id, file_ord, path, size AS chars FROM v_blocks),
gr AS (SELECT *, repo_id || '|' || batch_rank || '|' || batch_key AS g FROM (
  SELECT m.repo_id, 1 AS batch_rank, lpad(CAST(m.batch_ord AS VARCHAR), 12, '0') AS batch_key, m.batch_name AS nm, m.item_ord, b.file_ord, b.path, b.chars
  FROM mt m JOIN bm b ON b.repo_id = m.repo_id AND b.path = m.path
  UNION ALL SELECT repo_id, 2, '', 'Remaining Files', file_ord, file_ord, path, chars FROM bm
  WHERE repo_id IN (SELECT repo_id FROM mt) AND NOT EXISTS (SELECT 1 FROM mt m WHERE m.repo_id = bm.repo_id AND m.path = bm.path)
  UNION ALL SELECT repo_id, batch_rank, batch_key, nm, file_ord, file_ord, path, chars FROM ({GROUP_SQL.format(src='(SELECT * FROM bm WHERE repo_id NOT IN (SELECT repo_id FROM mt))')}))),""" + s_pack("gr")


@query("plan_batches", with_views(f"SELECT {BATCH_OUT} FROM pd", "v_plans", "v_blocks", more=PLAN_BATCH_CTE, recursive=True))
def _(spark, d):
    meta = views.blocks(spark, d).withColumn("chars", F.col("size"))
    return batching.plan_batches(views.plans(spark, d), meta, BUDGET).select(*BATCH_COLS)


@query("route_repos", with_views(
    f"""SELECT f.repo_id, f.files, f.chars, coalesce(b.budget, 700000) AS budget,
          CASE WHEN files <= 150 AND chars < floor(0.7 * coalesce(b.budget, 700000)) THEN 'single' ELSE 'batched' END AS mode
        FROM (SELECT repo_id, count(*) AS files, sum(chars) AS chars FROM v_meta GROUP BY 1) f
        LEFT JOIN (SELECT source AS repo_id, CASE {sql_list(views.MODELS)}[min(doc_id) % 4 + 1] WHEN 'gemini-3-flash-preview' THEN 700000
          WHEN 'gemini-1.5-pro' THEN 1400000 WHEN 'gemini-2.0-flash' THEN 600000 ELSE 400000 END AS budget FROM documents GROUP BY 1) b USING (repo_id)""", "v_meta"))
def _(spark, d):
    repos = views.table(spark, d, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.min("doc_id").alias("_m")).select(
        "repo_id", views.pick(views.MODELS, F.col("_m") % 4).alias("model"))
    return batching.route_repos(views.meta(spark, d), repos)


@query("file_manifest", with_views(
    "SELECT repo_id, file_ord, path, row_number() OVER (PARTITION BY repo_id ORDER BY file_ord) AS position FROM v_meta", "v_meta"))
def _(spark, d):
    return batching.file_manifest(views.meta(spark, d))


@query("batch_documents", with_views(
    f"""SELECT repo_id, batch_rank, batch_key, batch_name, part, count(*) AS files,
          md5(any_value(h.head) || string_agg(body, chr(10) ORDER BY file_ord)) AS digest, length(any_value(h.head) || string_agg(body, chr(10) ORDER BY file_ord)) AS chars
        FROM (SELECT b.*, 'FILE: ' || c.path || chr(10) || '```' || {s_lang('c.path')} || chr(10) || c.content || chr(10) || '```' || chr(10) AS body
              FROM (SELECT {BATCH_OUT} FROM pd) b JOIN v_code c USING (repo_id, path)) x
        JOIN (SELECT repo_id, 'ENDPOINTS:' || chr(10) || {{}} || 'PRESERVE:' || chr(10) || {{}} || 'MODERNIZE:' || chr(10) || {{}} AS head FROM (SELECT DISTINCT repo_id FROM v_meta) r0) h USING (repo_id)
        GROUP BY 1, 2, 3, 4, 5""".format(*[
        f"coalesce((SELECT string_agg('  - ' || value, chr(10) ORDER BY r) FROM ranked x WHERE x.repo_id = r0.repo_id AND x.kind = '{k}'), '  [None]') || chr(10) || chr(10)"
        for k in ("endpoint", "must_preserve", "can_modernize")]),
    "v_meta", "v_code", recursive=True, more=DIR_CTE + "," + FIND_CTE + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind ORDER BY phase, file_ord, pos, value) AS r FROM fnd)"""))
def _(spark, d):
    code = views.code(spark, d)
    docs = batching.batch_documents(batching.directory_batches(views.meta(spark, d), BUDGET), code, profile.repo_findings(code), digests=True)
    return docs.select("repo_id", "batch_rank", "batch_key", "batch_name", "part", "files", "digest", "chars")


def s_starts(x, prefixes):
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


@query("signature_summary", with_views(
    f"""SELECT repo_id, run_id, path, CASE WHEN len(l) = 0 THEN '[config/static file]' ELSE array_to_string(l[1:30], chr(10)) END AS summary FROM (
          SELECT repo_id, run_id, filename AS path, flatten(list_transform(string_split(content, chr(10)), lambda x0: list_filter([
            CASE WHEN {s_starts(s_strip('x0'), rules.SIGNATURE_PREFIXES)} THEN {s_strip('x0')}[1:120] END,
            CASE WHEN {s_starts(s_strip('x0'), rules.IMPORT_PREFIXES)} THEN {s_strip('x0')}[1:120] END], lambda y: y IS NOT NULL))) AS l
          FROM v_artifacts)""", "v_artifacts"))
def _(spark, d):
    return batching.signature_summary(views.artifacts(spark, d))


# ---------------------------------------------------------------- answers and markup

BODY = "chr(10) || '```text' || chr(10) || body || chr(10) || '```' || chr(10)"
RESPONSE_SQL = f"""rs AS (SELECT response_id, CASE role
    WHEN 'assistant' THEN 'ok' || chr(10) || '<file path="a' || turn || '.md">' || {BODY} || '</file>' || chr(10) || '<file path="b.md">' || body || '</file><file path="b.md">again</file>'
    WHEN 'user' THEN '<file path = "d' || turn || '.md" >' || chr(10) || body || '</file >'
    ELSE '<file path=''c' || turn || '.md''> ' || body || ' </file>' END AS text FROM v_responses),"""


def s_tag(pattern, g):
    return f"regexp_extract_all(text, {q('(?s)' + pattern)}, {g})"


def s_clean(x):
    return rf"regexp_replace(regexp_replace({s_strip(x)}, '^```\w*\n', ''), '\n```\s*$', '')"


@query("parse_responses", with_views(
    f"""SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY i) - 1 AS pos, filename, {s_clean('c')} AS content, strategy FROM (
          SELECT response_id, strategy, i, trim(p[i]) AS filename, cs[i] AS c, row_number() OVER (PARTITION BY response_id, trim(p[i]) ORDER BY i) AS rn FROM (
            SELECT *, unnest(range(1, len(p) + 1)) AS i FROM pick)) WHERE rn = 1 AND filename <> ''""",
    "v_responses", more=RESPONSE_SQL + f"""
    pick AS (SELECT response_id, CASE WHEN len(p1) > 0 THEN 1 WHEN len(p2) > 0 THEN 2 ELSE 3 END AS strategy,
               CASE WHEN len(p1) > 0 THEN p1 WHEN len(p2) > 0 THEN p2 ELSE p3 END AS p, CASE WHEN len(p1) > 0 THEN c1 WHEN len(p2) > 0 THEN c2 ELSE c3 END AS cs
             FROM (SELECT response_id, {s_tag(rules.FILE_TAG_DOUBLE, 1)} AS p1, {s_tag(rules.FILE_TAG_DOUBLE, 2)} AS c1,
                     {s_tag(rules.FILE_TAG_ANY_QUOTE, 1)} AS p2, {s_tag(rules.FILE_TAG_ANY_QUOTE, 2)} AS c2,
                     {s_tag(rules.FILE_TAG_SPACED, 1)} AS p3, {s_tag(rules.FILE_TAG_SPACED, 2)} AS c3 FROM rs))"""))
def _(spark, d):
    return responses.parse_responses(views.responses(spark, d)).select("response_id", "pos", "filename", "content", "strategy")


@query("parse_broken_responses", f"""
    SELECT conv_id || '-' || turn AS response_id, unnest([0, 1]) AS pos, unnest(['e' || turn || '.md', 'f.md']) AS filename,
           unnest(['first', {s_clean('text')}]) AS content, 4 AS strategy FROM conversations""")
def _(spark, d):
    c = views.table(spark, d, "conversations")
    broken = c.select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), F.concat(
        F.lit('intro\n<file path="e'), F.col("turn").cast("string"), F.lit('.md">\nfirst\n</file junk\n<file path=\'f.md\'>\n'), "text").alias("text"))
    return responses.parse_responses(broken).select("response_id", "pos", "filename", "content", "strategy")


@query("parse_edit_responses", """
    SELECT conv_id || '-' || turn AS response_id, unnest([0, 1]) AS pos, unnest(['a.md', role || '.md']) AS filename, unnest([text, 'x']) AS content FROM conversations""")
def _(spark, d):
    c = views.table(spark, d, "conversations")
    item = lambda name, text: F.struct(name.alias("filename"), text.alias("content"))
    doc = F.to_json(F.array(item(F.lit("a.md"), F.col("text")), item(F.lit("z.md"), F.lit(None).cast("string")),
                            item(F.concat("role", F.lit(".md")), F.lit("x"))))
    text = F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), doc, F.lit(" done")))
    return responses.parse_edit_responses(c.select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), text.alias("text")))


def default_analysis_rows():
    """(section, pos, detail, further fields) of an answer that cannot be read, as SQL values."""
    d, fill = responses.DEFAULT_ANALYSIS, lambda t: t.format(**responses.DEFAULT_ANALYSIS["unknown"])
    rows = [("summary", 0, fill(d["summary"]), "")]
    rows += [("understanding", i, fill(x), "") for i, (_, x) in enumerate(d["understanding"])]
    rows += [("drawback", i, fill(x[2]), x[4]) for i, x in enumerate(d["drawbacks"])]
    rows += [("workflow", i, x[2], f"{x[4]}|{x[5]}") for i, x in enumerate(d["workflow"])]
    rows += [("recommendation", i, x[2], f"{fill(x[4])}|{x[5]}") for i, x in enumerate(d["recommendations"])]
    rows += [("step", i, x[2], "") for i, x in enumerate(d["steps"])] + [("risk", i, x, "") for i, x in enumerate(d["risks"])]
    rows += [("impact", 0, d["impact"], "")]
    return ", ".join(f"({q(a)}, {b}, {q(c)}, {q(e)})" for a, b, c, e in rows)


@query("recommendation_rows", f"""
    SELECT repo_id, parsed, section, CAST(pos AS INTEGER) AS pos, detail, further FROM (
      SELECT conv_id || '-' || turn AS repo_id, true AS parsed, unnest(['summary', 'understanding', 'drawback', 'workflow', 'recommendation', 'risk', 'risk', 'impact']) AS section,
             unnest([0, 2, 0, 0, 0, 0, 1, 0]) AS pos, unnest([text, 'flow ' || role, 'd:' || role, 'w', 'because ' || turn, 'r1', role, text || '!']) AS detail,
             unnest(['', '', 'c' || turn, turn || ' h|none', role || '|low', '', '', '']) AS further FROM conversations WHERE role <> 'system'
      UNION ALL
      SELECT conv_id || '-' || turn, false, section, pos, detail, further FROM conversations, (VALUES {default_analysis_rows()}) AS v(section, pos, detail, further)
      WHERE role = 'system')""")
def _(spark, d):
    c = views.table(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    doc = F.to_json(F.struct(
        F.col("text").alias("summary"), F.lit(7).alias("health_score"),
        F.struct(F.concat(F.lit("flow "), "role").alias("data_flow")).alias("project_understanding"),
        F.array(F.struct(F.lit("d1").alias("id"), F.concat(F.lit("d:"), "role").alias("description"), F.concat(F.lit("c"), turn).alias("category"))).alias("drawbacks"),
        F.array(F.struct(F.lit("w").alias("description"), F.concat(turn, F.lit(" h")).alias("duration"), F.lit("none").alias("dependencies"))).alias("workflow_table"),
        F.array(F.struct(F.concat(F.lit("because "), turn).alias("reason"), F.col("role").alias("current"), F.lit("low").alias("effort"))).alias("recommendations"),
        F.array(F.lit("r1"), F.col("role")).alias("risks"), F.concat("text", F.lit("!")).alias("estimated_impact")))
    text = F.when(F.col("role") == "system", F.col("text")).when(F.col("role") == "user", doc).otherwise(
        F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
    rows = responses.recommendation_rows(c.select(F.concat_ws("-", "conv_id", "turn").alias("repo_id"), text.alias("text")))
    # a recommendation's category is its key as well
    further = F.concat_ws("|", F.when(F.col("section") == "drawback", F.col("category")), "current", "effort", "duration", "dependencies")
    return rows.select("repo_id", "parsed", "section", "pos", "detail", further.alias("further"))


def s_images(kind, pattern, context, alt):
    return f"""
    SELECT repo_id, filename, '{kind}' AS type, s[i] AS src, {alt} AS alt,
      1 + length(content[1:st]) - length(replace(content[1:st], chr(10), '')) AS line, {s_strip(f'content[greatest(st - {context}, 0) + 1 : st + length(m[i]) + {context}]')} AS context,
      m[i] AS full_match FROM (
        SELECT *, list_sum(list_transform(g[1:i], lambda x0: length(x0))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x1: length(x1))), 0) AS st FROM (
          SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT *, regexp_extract_all(content, {q(pattern)}, 0) AS m, regexp_extract_all(content, {q(pattern)}, 1) AS s, string_split_regex(content, {q(pattern)}) AS g FROM v_pages)))"""


IMAGE_CTE = f"""im AS ({s_images('img_tag', '(?is)' + rules.IMG_TAG, 100, f"regexp_extract(m[i], {q('(?i)' + rules.ALT_TEXT)}, 1)")}
    UNION ALL {s_images('bg_image', '(?i)' + rules.BACKGROUND_IMAGE, 80, "''")}
    UNION ALL {s_images('jsx_img', '(?i)' + rules.JSX_IMAGE, 80, "''")}),
    ip AS (SELECT *, ({s_any('lower(src)', rules.PLACEHOLDER_SRC)} OR {s_strip('src')} = '' OR starts_with(src, '#')) AS is_placeholder FROM im)"""
IMAGE_COLS = ("repo_id", "filename", "type", "src", "alt", "line", "context", "full_match", "is_placeholder")


@query("image_refs", with_views(f"SELECT {', '.join(IMAGE_COLS)} FROM ip", "v_pages", more=IMAGE_CTE))
def _(spark, d):
    return markup.image_refs(views.pages(spark, d)).select(*IMAGE_COLS)


@query("placeholder_images", with_views("SELECT repo_id, filename, type, src FROM ip WHERE is_placeholder", "v_pages", more=IMAGE_CTE))
def _(spark, d):
    return selection.placeholder_images(markup.image_refs(views.pages(spark, d))).select("repo_id", "filename", "type", "src")


@query("image_ref_counts", with_views(
    "SELECT repo_id, count(*) AS total, count(*) FILTER (is_placeholder) AS placeholders FROM ip GROUP BY 1", "v_pages", more=IMAGE_CTE))
def _(spark, d):
    return markup.image_ref_counts(markup.image_refs(views.pages(spark, d)))


LINK_CTE = f"""
rf AS (SELECT repo_id, run_id, filename AS html, i - 1 AS ref_ord, CASE WHEN starts_with(c0[i], '<link') THEN 'css' ELSE 'js' END AS kind,
         coalesce(c1[i], '') || coalesce(c2[i], '') || coalesce(c3[i], '') AS ref, c0[i] AS tag FROM (
         SELECT *, unnest(range(1, len(c0) + 1)) AS i FROM (
           SELECT *, {', '.join(f"regexp_extract_all(content, {q('(?i)' + rules.STYLESHEET_LINK + '|' + rules.SCRIPT_LINK)}, {n}) AS c{n}" for n in (0, 1, 2, 3))}
           FROM v_linked WHERE ends_with(filename, '.html')))),
ky AS (SELECT repo_id, kind, k, arg_max(filename, file_ord) AS target FROM (
         SELECT repo_id, file_ord, filename, CASE WHEN ends_with(filename, '.css') THEN 'css' ELSE 'js' END AS kind, unnest([filename, {s_base('filename')}]) AS k
         FROM v_linked WHERE ends_with(filename, '.css') OR ends_with(filename, '.js')) GROUP BY 1, 2, 3),
lk AS (SELECT rf.*, coalesce(a.target, b.target, c.target) AS target FROM rf
       LEFT JOIN ky a ON a.repo_id = rf.repo_id AND a.kind = rf.kind AND a.k = rf.ref
       LEFT JOIN ky b ON b.repo_id = rf.repo_id AND b.kind = rf.kind AND b.k = {s_base('rf.ref')}
       LEFT JOIN ky c ON c.repo_id = rf.repo_id AND c.kind = rf.kind AND c.k = './' || rf.ref)"""


@query("asset_links", with_views("SELECT repo_id, html, ref_ord, kind, ref, tag, target, target IS NOT NULL AS resolved FROM lk", "v_linked", more=LINK_CTE))
def _(spark, d):
    return markup.asset_links(views.linked_pages(spark, d)).drop("run_id", "html_ord", "target_ord")


@query("inline_assets", with_views(
    """SELECT p.repo_id, p.filename, length(p.content) + coalesce(x.d, 0) AS chars FROM v_linked p LEFT JOIN (
         SELECT repo_id, html, sum(n * (length(body) + CASE kind WHEN 'css' THEN 17 ELSE 19 END - length(tag))) AS d FROM (
           SELECT lk.repo_id, lk.html, lk.kind, lk.tag, count(DISTINCT ref_ord) AS n, arg_max(t.content, t.file_ord) AS body FROM lk JOIN v_linked t ON t.repo_id = lk.repo_id AND t.filename = lk.target
           GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) x ON x.repo_id = p.repo_id AND x.html = p.filename WHERE ends_with(p.filename, '.html')""", "v_linked", more=LINK_CTE))
def _(spark, d):
    arts = views.linked_pages(spark, d)
    return markup.inline_assets(arts, markup.asset_links(arts)).select("repo_id", "filename", F.length("content").cast("bigint").alias("chars"))


@query("rewrite_local_urls", with_views(
    f"""SELECT repo_id, run_id, filename, md5(c) AS digest, c <> content AS changed FROM (SELECT *, CASE WHEN {s_ends('filename', rules.REWRITE_EXTENSIONS)}
          THEN regexp_replace(content, {q(rules.LOCAL_URL)}, 'https://api.example.org/$1', 'g') ELSE content END AS c FROM v_artifacts)""", "v_artifacts"))
def _(spark, d):
    return markup.rewrite_local_urls(views.artifacts(spark, d), "https://api.example.org/$1").select(
        "repo_id", "run_id", "filename", F.md5(F.col("content").cast("binary")).alias("digest"), "changed")


API_TAG = '<script>window.__API_BASE_URL__ = "https://b.example.org";</script>'


@query("inject_api_base", with_views(
    f"""SELECT repo_id, filename, md5(CASE WHEN contains(content, '<head>') THEN regexp_replace(content, '<head>', '<head>' || chr(10) || {q(API_TAG)})
          WHEN contains(content, '<body>') THEN regexp_replace(content, '<body>', '<body>' || chr(10) || {q(API_TAG)}) ELSE {q(API_TAG)} || chr(10) || content END) AS digest, true AS changed
        FROM v_pages""", "v_pages"))
def _(spark, d):
    return markup.inject_api_base(views.pages(spark, d), "https://b.example.org").select(
        "repo_id", "filename", F.md5(F.col("content").cast("binary")).alias("digest"), "changed")


@query("replace_image", with_views(
    """SELECT repo_id, filename, md5(CASE WHEN w <> '' THEN replace(content, w, 'data:image/png;base64,QUJD') ELSE content END) AS digest FROM (
         SELECT *, regexp_extract(content, 'src="([^"]+)"', 1) AS w FROM v_pages)""", "v_pages"))
def _(spark, d):
    arts = views.pages(spark, d)
    images = arts.select("repo_id", "run_id", "filename", F.regexp_extract("content", 'src="([^"]+)"', 1).alias("old_src")).where("old_src <> ''").withColumn(
        "image_base64", F.lit("QUJD")).withColumn("mime", F.lit("image/png"))
    return markup.replace_image(arts, images).select("repo_id", "filename", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("asset_manifest", """
    SELECT repo_id, mime, filename, count(*) AS images, regexp_replace(filename, '^public', '') AS asset_path FROM (
      SELECT source AS repo_id, m.mime, 'public/assets/' || regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g')[1:30] || '_' || md5(to_base64(encode(text)))[1:8] || m.ext AS filename
      FROM documents, LATERAL (SELECT ['image/png', 'image/jpeg', 'image/svg+xml', 'image/tiff'][n_chars % 4 + 1] AS mime, ['.png', '.jpg', '.svg', '.png'][n_chars % 4 + 1] AS ext) m) GROUP BY 1, 2, 3""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    images = docs.select(
        F.col("source").alias("repo_id"), F.col("text").alias("hint"),
        views.pick(("image/png", "image/jpeg", "image/svg+xml", "image/tiff"), F.col("n_chars") % 4).alias("mime"),
        F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")).alias("image_base64"))
    return markup.asset_manifest(images)


@query("preview_file", with_views(
    """SELECT repo_id, run_id, filename, file_ord, r AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY r, file_ord) AS rn FROM (
           SELECT *, CASE WHEN contains(lower(filename), 'preview.html') THEN 1 WHEN regexp_extract(lower(filename), '[^/]*$') = 'index.html' THEN 2
             WHEN ends_with(lower(filename), '.html') OR ends_with(lower(filename), '.htm') THEN 3 END AS r FROM v_artifacts) WHERE r IS NOT NULL) WHERE rn = 1""", "v_artifacts"))
def _(spark, d):
    return markup.preview_file(views.artifacts(spark, d))


ENTRY_NAMES = ("backend/main.py", "frontend/app.py", "backend/util.py", "server.js", "lib/x.py", "web/index.js", "package.json",
               "backend/run.js", "client/server.js", "notes.md", "doc/a.txt", "css/a.css")
ENTRY_TEXTS = ("plain", "document.write", "window.open")
ENTRY_SQL = f"""
    en AS (SELECT 'e' || (doc_id // 5) AS repo_id, doc_id AS file_ord, {sql_list(ENTRY_NAMES)}[n_chars % 12 + 1] AS f, {sql_list(ENTRY_TEXTS)}[n_chars % 3 + 1] || ' ' || text AS content FROM documents),
    ea AS (SELECT *, {s_base('f')} AS nm, {s_any('content', rules.BROWSER_MARKERS)} AS cl FROM en),
    ep AS (SELECT *, CASE WHEN {s_in('nm', rules.PYTHON_ENTRYPOINTS)} AND NOT {s_any('f', ('frontend', 'client'))} THEN 1
        WHEN ends_with(f, '.py') AND {s_any('f', ('backend', 'api'))} THEN 2
        WHEN ({s_in('nm', rules.NODE_ENTRYPOINTS)} OR ends_with(f, 'server.js')) AND NOT {s_any('f', ('frontend', 'client', 'public'))} AND NOT cl THEN 3
        WHEN ends_with(f, '.py') THEN 4
        WHEN ends_with(f, '.js') AND {s_any('f', ('backend', 'server'))} AND NOT {s_any('content', ('document.', 'window.'))} THEN 5 END AS p,
        bool_or(ends_with(f, 'package.json')) OVER (PARTITION BY repo_id) AS pkg FROM ea),
    eb AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY p, file_ord) AS rn FROM ep WHERE p <= 4 OR (p = 5 AND pkg))"""


@query("entrypoint_runtime", f"""WITH {ENTRY_SQL}
    SELECT r.repo_id, coalesce(eb.f, 'modernized_stack/backend/main.py') AS entrypoint, CASE WHEN eb.p IN (3, 5) THEN 'node' ELSE 'python' END AS runtime, coalesce(eb.p, 6) AS rule
    FROM (SELECT DISTINCT repo_id FROM en) r LEFT JOIN eb ON eb.repo_id = r.repo_id AND rn = 1""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    arts = docs.select(
        F.concat(F.lit("e"), F.floor(F.col("doc_id") / 5).cast("string")).alias("repo_id"), F.col("doc_id").alias("file_ord"),
        views.pick(ENTRY_NAMES, F.col("n_chars") % 12).alias("filename"), F.concat(views.pick(ENTRY_TEXTS, F.col("n_chars") % 3), F.lit(" "), "text").alias("content"))
    return markup.entrypoint_runtime(arts, ["repo_id"])


# ---------------------------------------------------------------- runs and logs

ERR_CTE = "er AS (SELECT *, CASE " + " ".join(
    f"WHEN regexp_matches(log, {q(p)}, 'i') THEN {i}" for i, (p, _) in enumerate(rules.ERROR_RULES)
) + f""" END AS ri FROM v_run_logs),
    ec AS (SELECT *, ri IS NOT NULL AS is_error, coalesce({sql_list(t for _, t in rules.ERROR_RULES)}[ri + 1], '') AS error_type,
      CASE ri {' '.join(f"WHEN {i} THEN {q(p)}" for i, (p, _) in enumerate(rules.ERROR_RULES))} END AS pat FROM er),
    em AS (SELECT *, CASE WHEN is_error THEN length(string_split_regex(log, '(?i)' || pat)[1]) END AS st, CASE WHEN is_error THEN length(regexp_extract(log, '(?i)' || pat)) END AS w FROM ec),
    ef AS (SELECT *, CASE WHEN is_error THEN log[greatest(st - 200, 0) + 1 : st + w + 500] ELSE '' END AS error_message,
      {s_any('log', rules.CRASH_INDICATORS)} AS early_crash FROM em)"""


@query("classify_errors", with_views("SELECT repo_id, run_id, attempt, is_error, error_type, error_message, early_crash FROM ef", "v_run_logs", more=ERR_CTE))
def classify_errors(spark, d):
    return runs.classify_errors(views.run_logs(spark, d)).drop("log")


@query("error_lesson", with_views(
    f"SELECT repo_id, run_id, attempt, error_type, {s_lesson('error_type')} AS lesson FROM ef WHERE is_error", "v_run_logs", more=ERR_CTE))
def _(spark, d):
    errors = runs.run_errors(views.run_logs(spark, d)).withColumnRenamed("type", "error_type").drop("message")
    return runs.error_lesson(errors)


@query("run_outcomes", with_views(
    r"""SELECT repo_id, run_id, attempts, errors, error_types, least(errors, 3) AS retries, regexp_extract(l, '\[PREVIEW_URL\] (https://[^\s]+)', 1) AS preview_url,
          regexp_extract(l, '\[BACKEND_URL\] (https://[^\s]+)', 1) AS backend_url,
          CASE WHEN contains(l, 'Sandbox Error') OR contains(l, 'BUILD FAILED') OR contains(l, 'FATAL ERROR') THEN 'Fallback' ELSE 'Resurrected' END AS status FROM (
          SELECT repo_id, run_id, count(*) AS attempts, count(*) FILTER (is_error) AS errors, coalesce(string_agg(error_type, ',' ORDER BY attempt) FILTER (is_error), '') AS error_types,
                 arg_max(log, attempt) AS l FROM ef GROUP BY 1, 2)""", "v_run_logs", more=ERR_CTE))
def _(spark, d):
    return runs.run_outcomes(views.run_logs(spark, d)).withColumn("error_types", F.array_join("error_types", ","))


@query("run_outcomes_flagged", with_views(
    r"""SELECT repo_id, run_id, attempts, CASE WHEN ended THEN 1 ELSE errors END AS errors, CASE WHEN ended THEN 'EXCEPTION' ELSE error_types END AS error_types,
          CASE WHEN ended THEN 0 ELSE least(errors, 3) END AS retries,
          CASE WHEN ended THEN 'Error' WHEN fell OR contains(l, 'Sandbox Error') OR contains(l, 'BUILD FAILED') OR contains(l, 'FATAL ERROR') THEN 'Fallback' ELSE 'Resurrected' END AS status FROM (
          SELECT repo_id, run_id, count(*) AS attempts, count(*) FILTER (is_error) AS errors, coalesce(string_agg(error_type, ',' ORDER BY attempt) FILTER (is_error), '') AS error_types,
                 arg_max(log, attempt) AS l, arg_max(CAST(substr(run_id, 2) AS BIGINT) % 5 = attempt % 5, attempt) AS fell,
                 bool_or(CAST(substr(run_id, 2) AS BIGINT) % 7 = attempt) AS ended FROM ef GROUP BY 1, 2)""", "v_run_logs", more=ERR_CTE))
def _(spark, d):
    number = F.substring("run_id", 2, 20).cast("bigint")
    logs = views.run_logs(spark, d).withColumns({
        "fallback": number % 5 == F.col("attempt") % 5,
        "exception": F.when(number % 7 == F.col("attempt"), F.concat(F.lit("broke off in "), "run_id"))})
    return runs.run_outcomes(logs).select(
        "repo_id", "run_id", "attempts", "errors", F.array_join("error_types", ",").alias("error_types"), "retries", "status")


@query("error_context", with_views(
    """SELECT repo_id, run_id, string_agg('### Error ' || n || ' (Attempt ' || attempt || ') - Type: ' || error_type || chr(10) || '```' || chr(10) || error_message[1:1000] || chr(10) || '```' || chr(10),
         chr(10) ORDER BY attempt) AS text FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, run_id ORDER BY attempt) AS n FROM ef WHERE is_error) GROUP BY 1, 2""", "v_run_logs", more=ERR_CTE))
def _(spark, d):
    return runs.error_context(runs.run_errors(views.run_logs(spark, d)))


@query("log_level_counts", with_views("SELECT level, count(*) AS n FROM v_debug_log GROUP BY 1", "v_debug_log"))
def _(spark, d):
    return runs.log_level_counts(views.debug_log(spark, d))


@query("log_categories", with_views("SELECT DISTINCT category FROM v_debug_log", "v_debug_log"))
def _(spark, d):
    return runs.log_categories(views.debug_log(spark, d))


@query("recent_log_entries", with_views("SELECT event_id, level, category, message FROM v_debug_log ORDER BY ts DESC, event_id DESC LIMIT 2000", "v_debug_log"))
def _(spark, d):
    return runs.newest_entries(views.debug_log(spark, d)).select("event_id", "level", "category", "message")


# ---------------------------------------------------------------- attempt memory

@query("memory_rollup", with_views(
    """SELECT repo_id, count(*) FILTER (kind = 'start') AS total_attempts, count(*) FILTER (kind = 'success') AS successful_attempts,
         count(*) FILTER (kind = 'failure') AS failed_attempts, max(ts) FILTER (kind = 'start') AS last_run, count(*) FILTER (kind = 'failure') > 0 AS has_past_failures,
         count(*) FILTER (kind = 'success') > 0 AS has_learned_patterns,
         arg_max({'v': backend}, {'t': ts, 'e': event_id}) FILTER (has_stack).v AS backend, arg_max({'v': frontend}, {'t': ts, 'e': event_id}) FILTER (has_stack).v AS frontend,
         CAST(NULL AS VARCHAR) AS database FROM v_attempts GROUP BY 1""".replace("arg_max(", "(arg_max(").replace("(has_stack).v", "(has_stack)).v"), "v_attempts"))
def _(spark, d):
    return memory.memory_rollup(views.attempts(spark, d))


@query("recent_failures", with_views(
    f"""SELECT repo_id, event_id, error_type, error_message[1:500] AS error_message, context[1:300] AS context, {s_lesson('error_type')} AS lesson, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS rank FROM v_attempts WHERE kind = 'failure') WHERE rank <= 10""", "v_attempts"))
def _(spark, d):
    return memory.recent_failures(views.attempts(spark, d)).drop("ts")


DECISION_CTE = """dc AS (SELECT *, max(CASE WHEN kind = 'success' THEN {'t': ts, 'e': event_id} END) OVER (PARTITION BY repo_id) AS cut FROM v_attempts WHERE kind IN ('success', 'decision')),
    dd AS (SELECT *, cut IS NULL OR {'t': ts, 'e': event_id} > cut AS aft FROM dc)"""


@query("recent_decisions", with_views(
    """SELECT repo_id, event_id, decision, CASE kind WHEN 'success' THEN 'success' ELSE 'pending' END AS outcome, CASE kind WHEN 'success' THEN '✓' ELSE '○' END AS symbol FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id, aft ORDER BY ts DESC, event_id DESC) AS rn FROM dd) WHERE aft OR rn <= 20""", "v_attempts", more=DECISION_CTE))
def _(spark, d):
    return memory.recent_decisions(views.attempts(spark, d)).drop("ts")


@query("shown_decisions", with_views(
    """SELECT repo_id, event_id, decision, CASE kind WHEN 'success' THEN '✓' ELSE '○' END AS symbol, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS rank FROM v_attempts WHERE kind IN ('success', 'decision')) WHERE rank <= 5""", "v_attempts"))
def _(spark, d):
    return memory.shown_decisions(views.attempts(spark, d)).drop("ts")


@query("success_history", with_views(
    """SELECT repo_id, event_id, decision, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS rank
         FROM v_attempts WHERE kind = 'success') WHERE rank <= 10""", "v_attempts"))
def _(spark, d):
    return memory.success_history(views.attempts(spark, d)).drop("ts")


@query("recent_decision_lists", with_views(
    f"""SELECT repo_id, event_id, CAST(nth AS INTEGER) AS nth, decision, CASE kind WHEN 'success' THEN 'success' ELSE 'pending' END AS outcome
       FROM ranked WHERE later OR place <= {rules.KEEP_DECISIONS}""", "v_attempts", more="""
       each_one AS (SELECT repo_id, ts, event_id, kind, unnest([0, 1, 2]) AS nth, unnest(['decision ' || k, 'choice ' || (event_id % 9), 'way ' || (k % 4)]) AS decision
                    FROM v_attempts WHERE kind IN ('success', 'decision')),
       own AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC, nth DESC) AS r,
                      max(CASE WHEN kind = 'success' THEN {'t': ts, 'e': event_id} END) OVER (PARTITION BY repo_id) AS cut
               FROM each_one WHERE kind = 'success' OR nth = 0),
       ranked AS (SELECT *, cut IS NULL OR {'t': ts, 'e': event_id} > cut AS later,
                         row_number() OVER (PARTITION BY repo_id, cut IS NULL OR {'t': ts, 'e': event_id} > cut ORDER BY r) AS place FROM own)"""))
def _(spark, d):
    """Three decisions with every success."""
    k = F.regexp_extract("decision", r"\d+", 0).cast("int")
    events = views.attempts(spark, d).withColumn("decisions", F.when(F.col("kind") == "success", F.array(
        "decision", F.concat(F.lit("choice "), (F.col("event_id") % 9).cast("string")), F.concat(F.lit("way "), (k % 4).cast("string")))))
    return memory.recent_decisions(events).select("repo_id", "event_id", "nth", "decision", "outcome")


@query("success_patterns", with_views(
    """SELECT repo_id, pattern, first_seen, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY f DESC) AS rank FROM (
         SELECT repo_id, pattern, min({'t': ts, 'e': event_id, 'i': i}) AS f, min(ts) AS first_seen FROM (
           SELECT repo_id, ts, event_id, unnest([0, 1]) AS i, unnest(patterns) AS pattern FROM v_attempts WHERE kind = 'success') GROUP BY 1, 2)) WHERE rank <= 15""", "v_attempts"))
def _(spark, d):
    return memory.success_patterns(views.attempts(spark, d))


PATTERN_NUMBERS = ("event_id * 7 % 23", "user_id * 5 % 29", "event_id div 3 % 31")


@query("success_patterns_evicting", f"""
    WITH RECURSIVE won AS (
      SELECT 'r' || (user_id % 12) AS repo_id, event_id, ts, row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS n,
             list_transform([{', '.join(x.replace(' div ', ' // ') for x in PATTERN_NUMBERS)}], lambda x: 'p' || x) AS patterns FROM events),
    held AS (
      SELECT repo_id, 0::BIGINT AS n, []::STRUCT(p VARCHAR, t TIMESTAMP)[] AS list FROM won WHERE n = 1
      UNION ALL
      SELECT repo_id, n, list_slice(list, greatest(len(list) - 14, 1), len(list)) FROM (
        SELECT w.repo_id, w.n, list_reduce(w.patterns, lambda acc, x: CASE
                 WHEN list_contains(list_transform(acc, lambda y: y.p), x) THEN acc ELSE list_append(acc, {{'p': x, 't': w.ts::TIMESTAMP}}) END, h.list) AS list
        FROM held h JOIN won w ON w.repo_id = h.repo_id AND w.n = h.n + 1))
    SELECT repo_id, e.p AS pattern, e.t AS first_seen, len - place + 1 AS rank FROM (
      SELECT repo_id, unnest(list) AS e, unnest(range(1, len(list) + 1)) AS place, len(list) AS len
      FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC) AS r FROM held) WHERE r = 1)""")
def _(spark, d):
    """Three patterns an event of more than fifteen in turn, so that most are evicted and come back."""
    numbers = F.array(*[F.expr(x).cast("string") for x in PATTERN_NUMBERS])
    won = views.table(spark, d, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("repo_id"), "event_id", "ts", F.lit("success").alias("kind"),
        F.transform(numbers, lambda x: F.concat(F.lit("p"), x)).alias("patterns"))
    return memory.success_patterns(won)


@query("attempt_memory", with_views(
    """SELECT repo_id, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'success') AS successes,
              count(*) FILTER (kind = 'failure') AS failures, count(DISTINCT package) FILTER (kind = 'dependency') AS issues,
              least(count(*) FILTER (kind = 'failure'), KEEP) AS failed,
              (arg_max({'v': backend}, {'t': ts, 'e': event_id}) FILTER (has_stack)).v AS backend FROM v_attempts GROUP BY 1""".replace(
        "KEEP", str(rules.KEEP_FAILURES)), "v_attempts"))
def _(spark, d):
    """The keyed state fed with all events at once."""
    from ..streaming.attempt_memory import attempt_memory_stream
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # state stores report to an endpoint that the session's stream manager starts
    spark.streams.active
    out = attempt_memory_stream(views.attempts(spark, d))
    return out.select(
        "repo_id", "memory.starts", "memory.successes", "memory.failures", F.size("memory.issues").cast("bigint").alias("issues"),
        F.size("memory.failed").cast("bigint").alias("failed"), "memory.stack.value.backend")


@query("dependency_pain_points", with_views(
    "SELECT repo_id, package, arg_min(issue, {'t': ts, 'e': event_id}) AS issue, min(ts) AS ts FROM v_attempts WHERE kind = 'dependency' GROUP BY 1, 2", "v_attempts"))
def _(spark, d):
    return memory.dependency_pain_points(views.attempts(spark, d))


@query("memory_text", with_views(
    """SELECT repo_id, 'ATTEMPTS' || chr(10) || '  - total ' || ta || ', successful ' || sa || ', failed ' || fa || chr(10) || '  - last ' || strftime(lr, '%Y-%m-%dT%H:%M:%S') || chr(10)
         || coalesce('FAILURES' || chr(10) || ff || chr(10), '') || coalesce('PATTERNS' || chr(10) || pp || chr(10), '')
         || coalesce('DEPENDENCIES' || chr(10) || de || chr(10), '') || coalesce('DECISIONS' || chr(10) || cc || chr(10), '')
         || CASE WHEN be IS NOT NULL THEN 'STACK' || chr(10) || '  - ' || concat_ws(' / ', be, fe) || chr(10) ELSE '' END AS memory_text
       FROM (SELECT repo_id, max(ts) FILTER (kind = 'start') AS lr, count(*) FILTER (kind = 'start') AS ta, count(*) FILTER (kind = 'success') AS sa, count(*) FILTER (kind = 'failure') AS fa,
               (arg_max({'v': backend}, {'t': ts, 'e': event_id}) FILTER (has_stack)).v AS be, (arg_max({'v': frontend}, {'t': ts, 'e': event_id}) FILTER (has_stack)).v AS fe
             FROM v_attempts GROUP BY 1)
       LEFT JOIN (SELECT repo_id, string_agg('  - ' || error_type || ': ' || error_message[1:100] || ' | ' || lesson, chr(10) ORDER BY r DESC) AS ff FROM (
                    SELECT *, LESSON AS lesson, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS r FROM v_attempts WHERE kind = 'failure') WHERE r <= 5 GROUP BY 1) USING (repo_id)
       LEFT JOIN (SELECT repo_id, string_agg('  - ' || pattern, chr(10) ORDER BY f) AS pp FROM (
                    SELECT repo_id, pattern, min({'t': ts, 'e': event_id, 'i': i}) AS f FROM (
                      SELECT repo_id, ts, event_id, unnest([0, 1]) AS i, unnest(patterns) AS pattern FROM v_attempts WHERE kind = 'success') GROUP BY 1, 2) GROUP BY 1) USING (repo_id)
       LEFT JOIN (SELECT repo_id, string_agg('  - ' || package || ': ' || issue, chr(10) ORDER BY ts) AS de FROM (
                    SELECT repo_id, package, arg_min(issue, {'t': ts, 'e': event_id}) AS issue, min(ts) AS ts FROM v_attempts WHERE kind = 'dependency' GROUP BY 1, 2) GROUP BY 1) USING (repo_id)
       LEFT JOIN (SELECT repo_id, string_agg('  ' || CASE kind WHEN 'success' THEN '✓' ELSE '○' END || ' ' || decision, chr(10) ORDER BY r DESC) AS cc FROM (
                    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS r FROM v_attempts WHERE kind IN ('success', 'decision')) WHERE r <= 5 GROUP BY 1) USING (repo_id)
       WHERE ta > 0""".replace("LESSON", s_lesson("error_type")), "v_attempts"))
def _(spark, d):
    return memory.memory_text(views.attempts(spark, d))


@query("asset_artifacts", """
    SELECT 'public/assets/' || regexp_replace(source, '[^a-zA-Z0-9_-]', '_', 'g') || '_' || md5(to_base64(encode(text)))[1:8] || CASE WHEN n_chars % 2 = 0 THEN '.svg' ELSE '.png' END AS filename,
           md5(CASE WHEN n_chars % 2 = 0 THEN text ELSE 'data:image/png;base64,' || to_base64(encode(text)) END) AS digest FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    images = docs.select(
        F.col("source").alias("repo_id"), F.col("source").alias("hint"),
        views.pick(("image/svg+xml", "image/png"), F.col("n_chars") % 2).alias("mime"),
        F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")).alias("image_base64"))
    return markup.asset_artifacts(images, ["repo_id"]).select("filename", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("python_stack_frontend", with_views(
    """SELECT repo_id, bool_or(contains(f, 'frontend/package.json')) AS has_framework, bool_or(contains(f, 'frontend/index.html') OR f = 'index.html' OR ends_with(f, '/index.html')) AS has_static,
         CASE WHEN bool_or(contains(f, 'frontend/package.json')) THEN 'modernized_stack/frontend' WHEN bool_or(contains(f, 'frontend/index.html')) THEN 'frontend'
              WHEN bool_or(f = 'index.html' OR (ends_with(f, '/index.html') AND NOT contains(f, 'frontend'))) THEN '.' END AS frontend_dir
       FROM (SELECT 'b' || (doc_id // 20) AS repo_id, ['frontend/package.json', 'web/frontend/index.html', 'index.html', 'x/index.html', 'a.py', 'b.py', 'c.py', 'd.py', 'e.py', 'f.py',
             'g.py', 'h.py', 'i.py', 'j.py', 'k.py', 'l.py', 'm.py', 'n.py', 'o.py', 'p.py', 'q.py', 'r.py', 's.py', 't.py', 'u.py', 'v.py', 'w.py', 'x.py', 'y.py', 'z.py'][n_chars % 30 + 1] AS f FROM documents) GROUP BY 1"""))
def _(spark, d):
    names = ["frontend/package.json", "web/frontend/index.html", "index.html", "x/index.html"] + [f"{c}.py" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = views.table(spark, d, "documents")
    return profile.python_stack_frontend(docs.select(
        F.concat(F.lit("b"), F.floor(F.col("doc_id") / 20).cast("string")).alias("repo_id"), views.pick(names, F.col("n_chars") % 30).alias("filename")))


@query("checkpoint_pairing", with_views(
    """SELECT session_id, checkpoint_id, coalesce(a, 'continue') AS action, t IS NULL AS timed_out, (epoch_us(t) - epoch_us(ts)) / 1000000 AS wait_s FROM (
         SELECT c.session_id, c.checkpoint_id, c.ts, (min({'t': r.ts, 'a': r.action})).t AS t, (min({'t': r.ts, 'a': r.action})).a AS a
         FROM v_checkpoints c LEFT JOIN v_answers r ON r.session_id = c.session_id AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 600 SECOND GROUP BY 1, 2, 3)""".replace(
        "min({'t': r.ts, 'a': r.action})", "min(CASE WHEN r.ts IS NOT NULL THEN {'t': r.ts, 'a': r.action} END)"), "v_checkpoints", "v_answers"))
def _(spark, d):
    return stream_events.checkpoint_pairing(views.checkpoints(spark, d), views.answers(spark, d)).drop("ts")
