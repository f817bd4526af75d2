"""Repository profiles: languages, stack, findings, dependencies, layout, tokens."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import (
    any_of, basename, contains_any, dirname, ends_with_any, language, lookup, repo_key, safe_path,
)
from ..functions.scale import last_by, top_rows


# ---------------------------------------------------------------- languages and stack

def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language(F.col("path")))


def language_mix(files: DataFrame) -> DataFrame:
    """Files, characters and share of files per repository and language."""
    per_repo = Window.partitionBy("repo_id")  # at most one row per language by now
    return (
        with_language(files)
        .groupBy("repo_id", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("chars"),
        )
        .withColumn("share", F.col("files") / F.sum("files").over(per_repo))
    )


def first_match(text: Column, table, strict: bool = False) -> Column:
    """Value of the first rule one of whose substrings occurs in ``text``.

    ``strict`` asks for whole words, an extension that default results do not use.
    """
    out = None
    for value, needles in table:
        if strict:
            hit = text.rlike(r"(?:^|\W)(?:" + "|".join(f"\\Q{n}\\E" for n in needles) + r")(?:\W|$)")
        else:
            hit = contains_any(text, needles)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def file_stack(
    files: DataFrame,
    backend=rules.BACKEND_RULES,
    database=rules.DATABASE_RULES,
    frontend=rules.FRONTEND_RULES,
    strict: bool = False,
) -> DataFrame:
    """Per-file stack values; null where no rule fires."""
    low = F.col("_low")
    return (
        files.withColumn("_low", F.lower("content"))
        .withColumn("backend", first_match(low, backend, strict))
        .withColumn("database", first_match(low, database, strict))
        .withColumn("frontend", first_match(low, frontend, strict))
    )


def rule_number(text: Column, table, strict: bool = False) -> Column:
    """Position of the first rule that fires.  Numbers, unlike names, aggregate in place in a
    hash table, which saves sorting the files by repository."""
    return first_match(text, [(i, needles) for i, (_, needles) in enumerate(table)], strict)


def _last_rule(number: str, table) -> Column:
    last = F.max_by(number, F.when(F.col(number).isNotNull(), F.col("file_ord")))
    return F.get(F.array(*[F.lit(value) for value, _ in table]), last)


def stack_profile(
    files: DataFrame,
    backend=rules.BACKEND_RULES,
    database=rules.DATABASE_RULES,
    frontend=rules.FRONTEND_RULES,
    strict: bool = False,
) -> DataFrame:
    """Stack per repository: first rule wins in a file, the last matching file wins in a repo."""
    tables = {"backend": backend, "database": database, "frontend": frontend}
    low = F.col("_low")
    marked = files.select("repo_id", "file_ord", F.lower("content").alias("_low")).select(
        "repo_id", "file_ord", *[rule_number(low, t, strict).alias(c) for c, t in tables.items()]
    )
    return marked.groupBy("repo_id").agg(*[_last_rule(c, t).alias(c) for c, t in tables.items()])


# ---------------------------------------------------------------- findings

def repo_findings(files: DataFrame) -> DataFrame:
    """Long table (repo_id, phase, file_ord, pos, path, kind, value).

    Kinds: endpoint, env_var, schema_file, must_preserve, can_modernize.  Sorting one kind by
    (phase, file_ord, pos) gives the order in which a sequential scan would have listed it.

    Contents are read once: each file becomes an array of findings in place.  The only shuffle
    carries findings, not contents.  Endpoints of the call form (``app.get(...)``) count only
    if the repository has not listed the same endpoint before, so each endpoint also sends one
    marker into a combinable minimum over (repository, endpoint); decorator endpoints are kept
    as they come.
    """
    path, content, low = F.col("path"), F.col("content"), F.col("_low")
    low_path = F.lower(path)
    none = F.array().cast(ITEMS)

    def item(kind, value, phase=0, pos=None, dedup=False):
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), F.lit(phase).alias("phase"),
            (F.lit(0) if pos is None else pos).cast("int").alias("pos"), F.lit(dedup).alias("dedup"),
        )

    def one(condition, *items):
        return F.when(condition, F.array(*items)).otherwise(none)

    def found(pattern):
        return F.zip_with(
            F.regexp_extract_all(content, F.lit(pattern), F.lit(1)),
            F.regexp_extract_all(content, F.lit(pattern), F.lit(2)),
            lambda m, t: F.concat(F.upper(m), F.lit(" "), t),
        )

    # tests and lists that several findings share, each computed once per file
    staged = (
        files.select("repo_id", "file_ord", "path", "content", F.lower("content").alias("_low"))
        .withColumn("_decorated", contains_any(content, rules.DECORATOR_MARKERS))
        .withColumn("_called", contains_any(content, rules.CALL_MARKERS))
        .withColumn("_database", first_match(low, rules.DATABASE_RULES))
        .withColumn("_decorator", F.when(F.col("_decorated"), found(rules.DECORATOR_ENDPOINT)))
        .withColumn("_call", F.when(F.col("_called"), found(rules.CALL_ENDPOINT)))
    )

    def endpoints(values, base, dedup):
        return F.when(values.isNotNull(), F.transform(
            values, lambda v, i: item("endpoint", v, 0, F.lit(base) + i, dedup)
        )).otherwise(none)

    decorated, database = F.col("_decorated"), F.col("_database")
    is_schema = contains_any(low_path, rules.SCHEMA_HINTS)
    is_core = contains_any(low_path, rules.CORE_HINTS)
    prisma = database.isNull() & (low.contains("prisma") | path.endswith(".prisma"))
    env = F.slice(
        F.regexp_extract_all(content, F.lit(rules.ENV_VAR), F.lit(1)),
        1, rules.ENV_VARS_PER_FILE,
    )

    def keep(text, pos, phase=0):
        return item("must_preserve", F.concat(text if isinstance(text, Column) else F.lit(text), path),
                    phase, F.lit(pos))

    items = F.concat(
        one(database.isin(*rules.PRESERVED_DATABASES),
            keep(F.concat(database, F.lit(" database connection in ")), 0)),
        one(prisma, keep("Prisma schema in ", 0)),
        one(is_schema, item("schema_file", path), keep("Database schema/model in ", 1)),
        one(decorated, keep("API endpoints in ", 2)),
        one(F.size(F.coalesce("_call", F.array())) > 0, keep("Express API endpoints in ", 3)),
        one(is_core, keep("Core logic in ", 0, 1)),
        one(~is_core & contains_any(low_path, rules.MODERNIZE_HINTS), item("can_modernize", path, 1)),
        endpoints(F.col("_decorator"), 0, False),
        endpoints(F.col("_decorator"), 0, True),
        endpoints(F.col("_call"), CALL_POSITIONS, True),
        F.when(
            path.contains(".env") | low_path.contains("config"),
            F.transform(env, lambda v, i: item("env_var", v, 0, i)),
        ).otherwise(none),
    )
    long = staged.select("repo_id", "file_ord", "path", F.inline(items))
    place = F.struct("phase", "file_ord", "pos", "path")
    plain = F.when(~F.col("dedup"), place)
    return (
        long.withColumn("_own", plain)
        .groupBy("repo_id", "kind", "value", "_own")
        .agg(F.min(place).alias("_at"))
        # a marker whose first occurrence is of the decorator form was listed already
        .where(F.col("_own").isNotNull() | (F.col("_at.pos") >= CALL_POSITIONS))
        .select("repo_id", "_at.phase", "_at.file_ord", "_at.pos", "_at.path", "kind", "value")
    )


# positions of the call form follow those of the decorator form in the same file
CALL_POSITIONS = 1_000_000
ITEMS = "array<struct<kind:string,value:string,phase:int,pos:int,dedup:boolean>>"


def preservation_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per repository: database, file total and finding counts."""
    counts = findings.groupBy("repo_id").agg(
        *[
            F.count_if(F.col("kind") == kind).alias(name)
            for kind, name in (
                ("must_preserve", "must_preserve_count"),
                ("can_modernize", "can_modernize_count"),
                ("endpoint", "api_endpoints_count"),
            )
        ]
    )
    stack = (
        files.select("repo_id", "file_ord", rule_number(F.lower("content"), rules.DATABASE_RULES).alias("_db"))
        .groupBy("repo_id")
        .agg(_last_rule("_db", rules.DATABASE_RULES).alias("database"), F.count(F.lit(1)).alias("total_files"))
    )
    zero = F.lit(0).cast("bigint")
    return stack.join(counts, "repo_id", "left").select(
        "repo_id", "database", "total_files",
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in ("must_preserve_count", "can_modernize_count", "api_endpoints_count")
        ],
    )


def analysis_payload(
    findings: DataFrame, endpoints=20, env_vars=15, schemas=10, preserve=15, modernize=15,
    repos: DataFrame | None = None,
) -> DataFrame:
    """Capped lists per repository, one array column per kind, in listing order; a cap of None lists all.

    Environment names are distinct, ordered by first appearance.  With ``repos`` (repo_id) every
    repository has a row, those without findings one of empty lists.
    """
    caps = {
        "endpoint": endpoints, "env_var": env_vars, "schema_file": schemas,
        "must_preserve": preserve, "can_modernize": modernize,
    }
    place = F.struct("phase", "file_ord", "pos")
    # a repeated environment name collapses here; every other kind keeps its own place
    once = (
        findings.withColumn("_own", F.when(F.col("kind") != "env_var", place))
        .groupBy("repo_id", "kind", "value", "_own").agg(F.min(place).alias("_at"))
    )
    once = once.select("repo_id", "kind", "value", "_at")
    bounded = {kind: n for kind, n in caps.items() if n is not None}
    kept = once.where(~F.col("kind").isin(*bounded))
    if bounded:
        ranked = top_rows(
            once.where(F.col("kind").isin(*bounded)), ["repo_id", "kind"], [F.col("_at"), F.col("value")],
            max(bounded.values()),
        ).where(F.col("rank") <= lookup(bounded, F.col("kind"))).drop("rank")
        kept = ranked if len(bounded) == len(caps) else kept.unionByName(ranked)

    def capped(kind):
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("_at", "value")))
        return F.transform(F.array_sort(rows), lambda r: r["value"])

    lists = {
        "api_endpoints": "endpoint", "env_vars": "env_var", "database_schemas": "schema_file",
        "must_preserve": "must_preserve", "can_modernize": "can_modernize",
    }
    out = kept.groupBy("repo_id").agg(*[capped(kind).alias(name) for name, kind in lists.items()])
    if repos is None:
        return out
    none = F.array().cast("array<string>")
    return repos.select("repo_id").distinct().join(out, "repo_id", "left").select(
        "repo_id", *[F.coalesce(F.col(name), none).alias(name) for name in lists]
    )


# ---------------------------------------------------------------- dependencies

IMPORT_ROW = "array<struct<root:string,names:array<string>>>"


# string literals and comments, whichever begins first; a literal that is never closed ends with its line, or with the
# text if it may span lines
LITERALS = "|".join([
    r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\z)', r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\z)",
    r'"(?:[^"\\\n]++|\\[\s\S])*+"?', r"'(?:[^'\\\n]++|\\[\s\S])*+'?", r"#[^\n]*+",
])


def without_literals(source: Column) -> Column:
    """Source text without its strings and comments."""
    return F.regexp_replace(source, LITERALS, "")


def python_imports(files: DataFrame, exact: bool = False) -> DataFrame:
    """Import roots per Python file: (repo_id, path, root, names).

    The default takes strings, docstrings and comments out first and then reads import statements with expressions: at the
    beginning of a line, behind a semicolon or behind a colon, with brackets and continued lines.  ``exact`` runs Python's own
    parser on the same rows, which skips files with syntax errors.
    """
    py = files.where(F.col("path").endswith(".py")).select("repo_id", "path", "content")
    if exact:
        return py.select("repo_id", "path", F.inline(F.pandas_udf(_parse_imports, IMPORT_ROW)(F.col("content"))))
    # the names stand in brackets, over any number of lines, or on the rest of the line
    rest = r"(?:\\\r?\n|[^;\n(\\]++|\\)*+"
    bracket = r"\([^)]*+\)"
    statement = (
        r"(?mU)(?:^|[;:])[ \t\f]*(?:from(?:[ \t]+|(?=\.))[. \t]*(\w[\w.]*)[ \t]+import[ \t]*"
        rf"({bracket}|{rest})|import[ \t]+({rest}))"
    )
    code = without_literals(F.col("content"))
    source, names, modules = (F.regexp_extract_all(code, F.lit(statement), F.lit(g)) for g in (1, 2, 3))

    def listed(text):
        return F.split(F.regexp_replace(text, r"[()\\]", ""), ",")

    def found(x):
        plain = F.transform(listed(x["modules"]), lambda m: F.struct(
            F.regexp_extract(m, r"(?U)^\s*(\w+)", 1).alias("root"), F.array().cast("array<string>").alias("names")))
        given = F.filter(F.transform(listed(x["names"]), lambda n: F.regexp_extract(n, r"(?U)^\s*([\w*]+)", 1)), lambda n: n != "")
        one = F.array(F.struct(F.regexp_extract(x["source"], r"(?U)^(\w+)", 1).alias("root"), given.alias("names")))
        return F.when(x["source"] != "", one).otherwise(plain)

    zipped = F.arrays_zip(source.alias("source"), names.alias("names"), modules.alias("modules"))
    rows = F.filter(F.flatten(F.transform(zipped, found)), lambda r: r["root"] != "")
    return py.select("repo_id", "path", F.inline(rows))


def _parse_imports(content: pd.Series) -> pd.Series:

    def one(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return []
        rows = []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                rows += [{"root": a.name.split(".")[0], "names": []} for a in node.names]
            elif isinstance(node, ast.ImportFrom) and node.module:
                rows.append({
                    "root": node.module.split(".")[0], "names": [a.name for a in node.names],
                })
        return rows

    return pd.Series([one(t) for t in content])


def package_lookup(imports: DataFrame, table=None) -> DataFrame:
    """Distribution packages needed by import roots: distinct (repo_id, package)."""
    table = rules.PACKAGE_BY_IMPORT if table is None else table
    mapped = lookup(table, F.col("root"))
    email = (F.col("root") == "pydantic") & F.array_contains("names", "EmailStr")
    extra = F.when(email, F.array(*map(F.lit, rules.EMAIL_FIELD_PACKAGES))).otherwise(
        F.array().cast("array<string>")
    )
    packages = F.array_compact(F.concat(F.array(mapped), extra))
    return imports.select("repo_id", F.explode(packages).alias("package")).distinct()


def declared_python_deps(files: DataFrame) -> DataFrame:
    """Requirement lines of requirements.txt files: (repo_id, path, package, spec)."""
    line = F.col("line")
    return (
        files.where(F.col("path").endswith("requirements.txt"))
        .select("repo_id", "path", F.explode(F.split("content", "\n")).alias("line"))
        .withColumn("spec", F.regexp_replace(line, r"^\s+|\s*(#.*)?\s*$", ""))
        .withColumn("package", F.lower(F.regexp_extract("spec", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)))
        .where(F.col("package") != "")
        .select("repo_id", "path", "package", "spec")
    )


def merge_dependencies(inferred: DataFrame, declared: DataFrame, repos: DataFrame) -> DataFrame:
    """One spec per repository and package, with its source.

    Declared specs beat inferred and always-on ones; the pinned package is forced last and so
    wins over everything.
    """
    def name(spec):
        return F.lower(F.regexp_extract(spec, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))

    always = F.array(*[
        F.struct(F.lit(3).alias("prec"), F.lit(p).alias("spec"), F.lit("always").alias("source"))
        for p in rules.ALWAYS_ON_PACKAGES
    ] + [F.struct(
        F.lit(0).alias("prec"), F.lit(rules.PINNED_PACKAGE).alias("spec"),
        F.lit("pinned").alias("source"),
    )])
    parts = (
        repos.select("repo_id").distinct().select("repo_id", F.inline(always))
        .unionByName(inferred.select(
            "repo_id", F.lit(2).alias("prec"), F.col("package").alias("spec"),
            F.lit("inferred").alias("source"),
        ))
        .unionByName(declared.select(
            "repo_id", F.lit(1).alias("prec"), "spec", F.lit("declared").alias("source"),
        ))
    )
    return (
        parts.withColumn("package", name(F.col("spec")))
        .groupBy("repo_id", "package")
        .agg(F.min(F.struct("prec", "spec", "source")).alias("_best"))
        .select("repo_id", "package", "_best.spec", "_best.source")
    )


def declared_node_deps(files: DataFrame) -> DataFrame:
    """Names under dependencies and devDependencies of package.json; bad JSON gives none."""
    doc = F.from_json(
        "content", "dependencies map<string,string>, devDependencies map<string,string>"
    )

    def rows(field):
        return F.transform(
            F.coalesce(F.map_keys(doc[field]), F.array().cast("array<string>")),
            lambda k: F.struct(k.alias("package"), F.lit(field).alias("section")),
        )

    return (
        files.where(F.col("path").endswith("package.json"))
        .select("repo_id", "path",
                F.inline(F.concat(rows("dependencies"), rows("devDependencies"))))
    )


# ---------------------------------------------------------------- layout, roles, paths

def frontend_layout(files: DataFrame, path: str = "filename", by=("repo_id",)) -> DataFrame:
    """Front-end and page directories, long form: (…, dir, role, frontend_type).

    The type is that of the last framework config file.
    """
    p = F.col(path)
    low, name, folder = F.lower(p), basename(p), dirname(p)
    kind = (
        F.when(F.lower(name).contains("next.config"), "Next.js")
        .when(F.lower(name).contains("vite.config"), "Vite")
        .when(name == "angular.json", "Angular")
        .when(name == "vue.config.js", "Vue CLI")
        .when((name == "package.json") & contains_any(low, ("frontend", "client", "web")),
              "React/NPM")
        .when(F.lower(name).contains("nuxt.config"), "Nuxt.js")
        .when(name == "gatsby-config.js", "Gatsby")
        .when(name == "svelte.config.js", "SvelteKit")
    )
    # every page counts as static: its own suffix is one of the listed hints
    static = ends_with_any(p, rules.PAGE_EXTENSIONS)
    keys = list(by)
    marked = files.select(*keys, "file_ord", folder.alias("dir"), kind.alias("kind"), static.alias("static"))
    kinds = marked.groupBy(*keys).agg(F.coalesce(
        last_by(F.col("kind"), F.col("file_ord"), F.col("kind").isNotNull()), F.lit("unknown")
    ).alias("frontend_type"))
    # directories are made distinct as they are aggregated, so hot repositories shrink first
    dirs = (
        marked.where(F.col("kind").isNotNull() | F.col("static"))
        .groupBy(*keys, "dir")
        .agg(F.bool_or(F.col("kind").isNotNull()).alias("is_front"),
             F.bool_or("static").alias("is_static"))
    )
    roles = F.array_compact(F.array(
        F.when(F.col("is_front"), F.lit("frontend")), F.when(F.col("is_static"), F.lit("static")),
    ))
    return dirs.select(*keys, "dir", F.explode(roles).alias("role")).join(kinds, keys)


def python_stack_frontend(artifacts: DataFrame, by=("repo_id",)) -> DataFrame:
    """Where the front end of a Python-served run lives: framework build, directory or root."""
    f = F.col("filename")
    return artifacts.groupBy(*by).agg(
        F.bool_or(f.contains("frontend/package.json")).alias("has_framework"),
        F.bool_or(f.contains("frontend/index.html")).alias("_dir"),
        F.bool_or(
            (f == "index.html") | (f.endswith("/index.html") & ~f.contains("frontend"))
        ).alias("_root"),
    ).select(
        *by, "has_framework",
        (F.col("_dir") | F.col("_root")).alias("has_static"),
        F.when(F.col("has_framework"), "modernized_stack/frontend")
        .when(F.col("_dir"), "frontend").when(F.col("_root"), ".").alias("frontend_dir"),
    )


def artifact_roles(artifacts: DataFrame, by=("repo_id", "run_id")) -> DataFrame:
    """Backend, front-end and config file counts per run; a file can have several roles."""
    f = F.col("filename")
    low = F.lower(f)
    return artifacts.groupBy(*by).agg(
        F.count_if(low.contains("backend") | f.endswith(".py") | low.contains("api"))
        .alias("backend_files"),
        F.count_if(low.contains("frontend") | ends_with_any(f, (".html", ".css", ".jsx", ".tsx")))
        .alias("frontend_files"),
        F.count_if(f.isin(*rules.CONFIG_ROLE_NAMES)).alias("config_files"),
    )


def path_hygiene(files: DataFrame, path: str = "path") -> DataFrame:
    """Shell-safe path of every file and how many files of the repository share it.

    Sharing is counted by a combinable aggregate and joined back, so no window has to hold a
    group of colliding files.
    """
    safe = files.withColumn("safe_path", safe_path(F.col(path)))
    shared = safe.groupBy("repo_id", "safe_path").agg(F.count(F.lit(1)).alias("sharing"))
    return (
        safe.join(shared, ["repo_id", "safe_path"])
        .withColumn("changed", F.col("safe_path") != F.col(path))
        .withColumn("collides", F.col("sharing") > 1)
    )


def repo_dimension(urls: DataFrame, url: str = "repo_url") -> DataFrame:
    """Distinct repositories with owner, name and key; URLs that do not parse stay, flagged."""
    u = F.col(url)
    pattern = r"github\.com/([^/]+)/([^/.]+)"
    return (
        urls.select(
            repo_key(u).alias("repo_id"),
            u.alias("repo_url"),
            F.nullif(F.regexp_extract(u, pattern, 1), F.lit("")).alias("owner"),
            F.nullif(F.regexp_extract(u, pattern, 2), F.lit("")).alias("name"),
        )
        .groupBy("repo_id")
        .agg(F.min(F.struct("repo_url", "owner", "name")).alias("_r"), F.count(F.lit(1)).alias("seen"))
        .select("repo_id", "_r.repo_url", "_r.owner", "_r.name", "seen",
                F.col("_r.owner").isNotNull().alias("is_valid"))
    )


def directory_rollup(entries: DataFrame) -> DataFrame:
    """Every path prefix as a node: depth, folder flag, files, chars and ``has_new`` below it.

    Sort by (repo_id, parent_path, is_folder desc, lower(name), name) for display order.
    """
    parts = F.split("path", "/")
    nodes = entries.select(
        "repo_id", "is_new", F.coalesce("chars", F.lit(0)).alias("chars"),
        F.size(parts).alias("_size"),
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, 1, i), "/"),
        )).alias("_i", "node_path"),
    )
    node = F.col("node_path")
    return (
        nodes.groupBy("repo_id", "node_path")
        .agg(
            (F.first("_i") + 1).alias("depth"),
            F.bool_or(F.col("_i") + 1 < F.col("_size")).alias("is_folder"),
            F.count(F.lit(1)).alias("files"),
            F.sum("chars").alias("chars"),
            F.bool_or("is_new").alias("has_new"),
        )
        .withColumn("name", basename(node))
        .withColumn("parent_path", F.when(F.instr(node, "/") > 0, F.regexp_extract(node, r"(?s)^(.*)/[^/]*$", 1)).otherwise(""))
    )


# ---------------------------------------------------------------- token classes

TOKEN_CLASSES = (
    "keyword", "string", "comment", "number", "decorator", "type", "function", "operator",
    "bracket",
)


def token_profile(files: DataFrame) -> DataFrame:
    """Tokens per repository, token language and class.

    One regular expression per language family cuts each line into tokens; a class is decided
    from a token's first character, so counting needs no Python and no further pattern.
    """
    ext = F.lower(F.substring_index("path", ".", -1))
    lang = F.coalesce(lookup(rules.TOKEN_LANGUAGE_BY_EXTENSION, ext), F.lit("other"))
    counts = F.transform(
        F.filter(F.split("content", "\n"), lambda line: line != ""),
        lambda line: _line_tokens(line, F.col("token_language")),
    )
    tokens = (
        files.withColumn("token_language", lang)
        .select("repo_id", "token_language", F.explode(F.flatten(counts)).alias("_token"))
        .withColumn("_first", F.substring("_token", 1, 1))
        # a word that takes its opening bracket along also counts as a bracket
        .withColumn("_call", F.col("_token").endswith("(") & F.col("_first").isin(*WORD_STARTS)
                    & (F.length("_token") > 1))
    )
    per_class = (
        tokens.groupBy("repo_id", "token_language", _token_class().alias("class"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_call").alias("calls"))
    )
    return (
        per_class.select("repo_id", "token_language", F.inline(F.array(
            F.struct(F.col("class").alias("class"), F.col("n").alias("n")),
            F.struct(F.lit("bracket").alias("class"), F.col("calls").alias("n")),
        )))
        .where(F.col("class").isNotNull() & (F.col("n") > 0))
        .groupBy("repo_id", "token_language", "class").agg(F.sum("n").alias("tokens"))
    )


WORD_STARTS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
TOKEN_COMMENT = {"py": r"#.*", "js": r"//.*", "css": r"//.*", "json": r"//.*",
                 "html": r"<!--.*?-->|<!--.*"}
TOKEN_STRING = (
    r'"(?:\\.|[^"\\])*(?:"|\\?$)' r"|'(?:\\.|[^'\\])*(?:'|\\?$)" r"|`(?:\\.|[^`\\])*(?:`|\\?$)"
)
TOKEN_REST = (
    r"[0-9][0-9.xXa-fA-F_eE]*" r"|[()\[\]{}]" r"|[=><+\-*/%!&|^~?:;,.]" r"|[A-Za-z0-9_$]+\(?"
)


def token_pattern(lang: str) -> str:
    """Alternatives in the order in which a left-to-right scan tries them."""
    parts = [TOKEN_COMMENT[lang]] if lang in TOKEN_COMMENT else []
    parts.append(TOKEN_STRING)
    if lang == "py":
        parts.append(r"(?:^|\s)@[A-Za-z0-9_.]*")
    parts.append(TOKEN_REST)
    return "(?s)" + "|".join(parts)


def _line_tokens(line: Column, lang: Column) -> Column:
    out = None
    for name in ("py", "js", "html", "other"):
        hit = F.regexp_extract_all(line, F.lit(token_pattern(name)), F.lit(0))
        test = lang.isin("js", "css", "json") if name == "js" else lang == name
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out


def _token_class() -> Column:
    """Class of a token by its first character; plain words and white space have none."""
    token, first, lang = F.col("_token"), F.col("_first"), F.col("token_language")
    word = F.when(F.col("_call"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
    comment = (
        ((first == "#") & (lang == "py"))
        | ((first == "/") & lang.isin("js", "css", "json") & token.startswith("//"))
        | ((first == "<") & (lang == "html") & token.startswith("<!--"))
    )
    keyword = F.when(lang == "py", word.isin(*rules.PYTHON_KEYWORDS)).otherwise(
        word.isin(*rules.SCRIPT_KEYWORDS)
    )
    word_class = (
        F.when(keyword, "keyword")
        .when(first.between("A", "Z") & (F.length(word) > 1), "type")
        .when(F.col("_call"), "function")
    )
    return (
        F.when(first.isin(*WORD_STARTS), word_class)
        .when(comment, "comment")
        .when(first.isin('"', "'", "`"), "string")
        .when(first.isin(*"0123456789"), "number")
        .when(first.isin(*"()[]{}"), "bracket")
        .when(first.isin(*"=><+-*/%!&|^~?:;,."), "operator")
        .otherwise(F.when(token.contains("@"), "decorator"))
    )
