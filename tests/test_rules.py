"""Rule semantics on small hand-made tables: the cases a reader would get wrong."""

from __future__ import annotations

import ast
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions import paths
from codecensus.operators import batching, markup, matching, memory, profile, responses, runs, selection
from codecensus.sources import corpus, memory_store

SHOP = "https://github.com/example/shop"
SHOP_KEY = hashlib.md5(SHOP.encode()).hexdigest()[:16]

# a small shop: routes by the plain decorator only, a local address in a script, linked style and scripts
BOOKS = {
    "service/books.py": (
        "import flask\nfrom flask_cors import cross_origin\n\nshop = app = flask.Flask('books')\nSHELF = {1: 'Walden'}\n\n\n"
        "@app.route('/books/<int:number>')\n@cross_origin()\ndef book(number):\n    return {'title': SHELF.get(number)}\n"
    ),
    "service/requirements.txt": "# web\nflask==1.1.4\nflask-cors==3.0.8  # other hosts\n",
    "site/shelf.html": (
        '<html><head><link href="look.css" rel="stylesheet"><script src="https://cdn.example.org/dates.js"></script></head>\n'
        '<body><ul id="list"></ul><script src="list.js" defer></script></body></html>\n'
    ),
    "site/look.css": "ul { list-style: square }\n",
    "site/list.js": "fetch('http://localhost:5000/books/1').then(r => r.json()).then(show)\n",
}


def corpus_of(spark, tree, repo="r"):
    return spark.createDataFrame(
        [(repo, i, p, "blob", None, len(c), c) for i, (p, c) in enumerate(tree.items())],
        "repo_id string, file_ord bigint, path string, type string, sha string, size bigint, content string",
    )


def artifacts_of(spark, tree, repo="r", run="1"):
    return spark.createDataFrame(
        [(repo, run, i, p, c) for i, (p, c) in enumerate(tree.items())],
        "repo_id string, run_id string, file_ord bigint, filename string, content string",
    )


def test_small_repository(spark, rows):
    files = corpus_of(spark, BOOKS)
    assert rows(profile.stack_profile(files)) == [("r", "Flask", None, None)]
    langs = {r.path: r.language for r in profile.with_language(files).collect()}
    assert list(langs.values()) == ["python", "text", "html", "css", "javascript"]
    found = profile.repo_findings(files)
    assert rows(found.where("kind = 'endpoint'")) == []  # the plain decorator is none
    assert [r[1] for r in rows(found.where("kind = 'can_modernize'"), "file_ord", "value")] == [
        "service/requirements.txt", "site/look.css"]
    assert rows(found.where("kind = 'must_preserve'"), "value") == [("API endpoints in service/books.py",)]
    imports = profile.python_imports(files)
    assert rows(imports, "root") == [("flask",), ("flask_cors",)]
    merged = profile.merge_dependencies(
        profile.package_lookup(imports), profile.declared_python_deps(files), files)
    assert dict(rows(merged, "package", "spec")) == {
        "flask": "flask==1.1.4", "flask-cors": "flask-cors==3.0.8", "uvicorn": "uvicorn",
        "fastapi": "fastapi", "python-multipart": "python-multipart", "bcrypt": "bcrypt==4.0.1"}
    links = markup.asset_links(artifacts_of(spark, BOOKS))
    assert rows(links, "ref", "target") == [
        ("https://cdn.example.org/dates.js", None), ("list.js", "site/list.js"), ("look.css", "site/look.css")]
    fixed = markup.rewrite_local_urls(artifacts_of(spark, BOOKS), "https://x.example.org")
    assert rows(fixed.where("changed"), "filename") == [("site/list.js",)]
    page = markup.inline_assets(artifacts_of(spark, BOOKS), links).collect()[0].content
    assert "<style>\nul { list-style: square }\n\n</style>" in page and "cdn.example.org/dates.js" in page


PATHS = [".env", "a/.env.local", "x.", "a.b/c", "a/..x", "...", "..a.b", "/f", "//f.py", "a//b.c", "a/", "Dockerfile",
         "src/x.Test.PY", ".a.b.c"]


def test_paths_follow_posix_functions(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    p = F.col("p")
    for r in df.select("p", paths.basename(p).alias("b"), paths.dirname(p).alias("d"), paths.extension(p).alias("e")).collect():
        assert (r.b, r.d, r.e) == (os.path.basename(r.p), os.path.dirname(r.p), os.path.splitext(r.p)[1]), r.p


def test_safe_path_and_repo_key(spark):
    df = spark.createDataFrame([("a  (b)//[c]__d.py", " https://GitHub.com/Example/Shop// ")], "p string, u string")
    r = df.select(paths.safe_path(F.col("p")).alias("p"), paths.repo_key(F.col("u")).alias("k")).first()
    assert r.p == "a_b/c_d.py" and r.k == SHOP_KEY


def test_eligibility_reasons(spark):
    names = ["src/app.py", "distribution/a.py", "dist/a.py", "notes.bin", "api/notes.bin", "img/model.png", ".env", "big.py",
             "a/.env.local", "egg-info/x.py"]
    df = spark.createDataFrame(
        [("r", i, n, "blob", 600_000 if n == "big.py" else 10) for i, n in enumerate(names)] + [("r", 99, "src", "tree", None)],
        "repo_id string, file_ord bigint, path string, type string, size bigint")
    got = {r.path: r.reason for r in selection.eligible_files(df).collect()}
    assert got == {"src/app.py": None, "distribution/a.py": None, "dist/a.py": "skip_dir", "notes.bin": "unlisted",
                   "api/notes.bin": None, "img/model.png": "binary_ext", ".env": None, "big.py": "too_large",
                   "a/.env.local": None, "egg-info/x.py": "skip_dir"}


def test_eligibility_reads_no_contents(spark, tmp_path):
    corpus_of(spark, BOOKS).write.parquet(str(tmp_path / "f"))
    df = selection.eligible_files(spark.read.parquet(str(tmp_path / "f"))).select("path", "eligible")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_binary_like_and_coverage(spark, rows):
    df = corpus_of(spark, {"a": "x" * 9 + "\0", "b": "x" * 8 + "\0\0", "c": ""})
    assert rows(selection.drop_binary_like(df), "path") == [("a",), ("c",)]
    cov = df.withColumn("fetched", F.col("path") == "a").unionByName(
        corpus_of(spark, {"a": "", "b": ""}, "s").withColumn("fetched", F.lit(False)))
    assert rows(selection.scan_coverage(cov), "repo_id", "total", "fetched", "flag") == [("r", 3, 1, "ok"), ("s", 2, 0, "zero")]


def test_stack_first_rule_then_last_file(spark, rows):
    files = corpus_of(spark, {"1": "FastAPI and flask, mongoose", "2": "nothing here", "3": "Express; pg.", "4": "plain vue text"})
    assert rows(profile.stack_profile(files)) == [("r", "Express.js", "PostgreSQL", "Vue.js")]
    strict = profile.file_stack(corpus_of(spark, {"1": "expression and nextdoor", "2": "use express now"}), strict=True)
    assert rows(strict, "path", "backend") == [("1", None), ("2", "Express.js")]


def test_endpoint_forms(spark, rows):
    files = corpus_of(spark, {
        "a.py": '@app.get("/x")\n@app.get("/x")\n', "b.js": "app.get('/x', f); router.get('/y', f)",
        "c.js": "router.get('/y', f); app.post('/z', f)", "d.py": '@app.get("/y")'})
    got = profile.repo_findings(files).where("kind = 'endpoint'").orderBy("phase", "file_ord", "pos")
    # decorators repeat; calls are listed once and never after the same endpoint
    assert [(r.file_ord, r.value) for r in got.collect()] == [
        (0, "GET /x"), (0, "GET /x"), (1, "GET /y"), (2, "POST /z"), (3, "GET /y")]


def test_env_names_per_file_and_payload_caps(spark):
    text = "".join(f"NAME_{i} = 1\n" for i in range(12))
    files = corpus_of(spark, {"config/a.py": text, "config/b.py": "NAME_0=1\nOTHER=2\n"})
    found = profile.repo_findings(files)
    assert found.where("kind = 'env_var'").count() == 12
    names = profile.analysis_payload(found).first().env_vars
    assert names == [f"NAME_{i}" for i in range(10)] + ["OTHER"]


def test_core_logic_is_always_added(spark, rows):
    files = corpus_of(spark, {"models.py": "mysql", "x.prisma": "", "ui/page.py": ""})
    got = rows(profile.repo_findings(files).where("kind = 'must_preserve'"), "phase", "value")
    assert got == [(0, "Database schema/model in models.py"), (0, "MySQL database connection in models.py"),
                   (0, "Prisma schema in x.prisma"), (1, "Core logic in models.py")]


def reference_error(log):
    for pattern, kind in rules.ERROR_RULES:
        m = re.search(pattern, log, re.IGNORECASE)
        if m:
            return kind, log[max(0, m.start() - 200):m.end() + 500]
    return "", ""


LOG_SAMPLES = [p.replace("\\", "").replace("[^0]", "7").replace("d+", "12").replace(".*", " x ") for p, _ in rules.ERROR_RULES]


def test_error_classes_follow_list_order(spark):
    logs = [f"{'é😀' * 150}{s.upper()} {'t' * 600}" for s in LOG_SAMPLES]
    logs += ["BACKEND_CRASH: x\nCannot find module", "ECONNREFUSED 127.0.0.1:27017", "mkdir a\nfailed", "fine", "", None]
    df = spark.createDataFrame(list(enumerate(logs)), "i int, log string")
    for r in runs.classify_errors(df).collect():
        assert (r.error_type, r.error_message) == reference_error(logs[r.i] or ""), logs[r.i]


def test_lessons(spark, rows):
    df = spark.createDataFrame([("NODE_MODULE_NOT_FOUND",), ("NODE_INTERNAL_ERROR",), ("NODE_PORT_IN_USE",)], "error_type string")
    got = dict(rows(runs.error_lesson(df)))
    assert got["NODE_INTERNAL_ERROR"] == rules.DEFAULT_LESSON
    assert got["NODE_PORT_IN_USE"].startswith("The port")


def test_run_outcome_and_context(spark):
    df = spark.createDataFrame(
        [("r", "1", 1, "npm ERR! x"), ("r", "1", 2, "[PREVIEW_URL] https://p.example.org/x end\n[BACKEND_URL] https://b.example.org"),
         ("r", "2", 1, "FRONTEND BUILD FAILED")], "repo_id string, run_id string, attempt int, log string")
    got = {r.run_id: r for r in runs.run_outcomes(df).collect()}
    assert (got["1"].retries, got["1"].error_types, got["1"].preview_url, got["1"].status) == (
        1, ["NPM_ERROR"], "https://p.example.org/x", "Resurrected")
    assert got["2"].status == "Fallback"
    text = {r.run_id: r.text for r in runs.error_context(runs.run_errors(df)).collect()}["2"]
    assert text.startswith("### Error 1 (Attempt 1) - Type: FRONTEND_BUILD_ERROR\n```\nFRONTEND")


def test_log_text(spark):
    df = spark.sql("""SELECT 1L AS event_id, timestamp'2024-01-02 03:04:05.6789' AS ts, 'INFO' AS level, 'CAT' AS category, 'msg' AS message,
                      '{"a": "x\\\\"y", "b": 2, "c": [1,2], "d": null}' AS details
                      UNION ALL SELECT 2, timestamp'2024-01-02 03:04:05', 'INFO', 'CAT', 'msg', '{}'""")
    got = [r.line for r in runs.log_text(df).orderBy("event_id").collect()]
    assert got[0] == '[03:04:05.678] INFO [CAT] msg\n  {\n  "a": "x\\"y",\n  "b": 2,\n  "c": [1,2],\n  "d": null\n}'
    assert got[1] == "[03:04:05.000] INFO [CAT] msg"


# ---------------------------------------------------------------- answers

def sequential_parse(text):
    """What the four readings give, worked out one line at a time."""
    def clean(raw):
        return re.sub(r"\n```\s*$", "", re.sub(r"^```\w*\n", "", raw.strip()))

    for n, pattern in enumerate((rules.FILE_TAG_DOUBLE, rules.FILE_TAG_ANY_QUOTE, rules.FILE_TAG_SPACED), 1):
        out = {}
        for name, body in re.findall(pattern, text, re.DOTALL):
            if name.strip():
                out.setdefault(name.strip(), clean(body))
        if out:
            return [(n, k, v) for k, v in out.items()]
    out, name, held = {}, None, []
    for line in [*text.split("\n"), None]:
        start = re.match(rules.FILE_TAG_OPENING, line) if line is not None else None
        if line is None or start:
            if name and held:
                out.setdefault(name.strip(), clean("\n".join(held)))
            if start:
                rest = re.sub(r"""<file\s+path\s*=\s*["'][^"']+["']>\s*""", "", line)
                name, held = start.group(1), [rest.rstrip()] if rest.strip() else []
        elif "</file" in line and name:
            before = line.split("</file")[0]
            held += [before.rstrip()] if before.strip() else []
            out.setdefault(name.strip(), clean("\n".join(held)))
            name, held = None, []
        elif name:
            held.append(line)
    return [(4, k, v) for k, v in out.items()]


ANSWERS = [
    '<file path="a.py">\n```python\nx = 1\n```\n</file><file path=" a.py ">again</file>',
    "<file path='b.py'>y</file> <file path=\"\">z</file>",
    '<file  path = "c d.py" >\nbody\n</file >',
    'talk\n<file path="e.py">one\ntwo  \nthree </file\nnoise\n<file path="f.py">\nopen\n',
    '<file path="g.py">',
    '<file path="g.py">\n',
    '<file path="g.py">\n<file path="h.py">\nx',
    '<file path="g.py">\n\n<file path="h.py">\n</file\n',
    ' <file path="i.py">\nindented tag does not open\n',
    '<file path="j.py">tail</ file>\nmore\n</file\n</file',
    "nothing", "",
]


def test_response_readings(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, text string")
    got = {i: [] for i in range(len(ANSWERS))}
    for r in responses.parse_responses(df).orderBy("i", "pos").collect():
        got[r.i].append((r.strategy, r.filename, r.content))
    for i, text in enumerate(ANSWERS):
        assert got[i] == sequential_parse(text), text


def test_edit_answers(spark, rows):
    texts = ['[{"filename": "a", "content": "1"}, {"filename": "b"}, 3]', 'Sure: [{"filename": "c", "content": "2"}] ok', "none",
             '```json\n[{"filename":"d","content":"x"}]\n```', '{"files": [{"filename": "e", "content": "x"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows(responses.parse_edit_responses(df), "i", "filename", "content")
    assert got == [(0, "a", "1"), (1, "c", "2"), (3, "d", "x")]


def test_recommendations_default(spark):
    df = spark.createDataFrame([("r", "not json"), ("s", '```json\n{"summary": "ok", "risks": ["a"]}\n```')], "repo_id string, text string")
    stack = spark.createDataFrame([("r", "Flask", None)], "repo_id string, backend string, database string")
    got = responses.recommendation_rows(df, stack)
    assert got.where("repo_id = 'r'").count() == 20
    assert "Using Flask" in got.where("repo_id = 'r' AND key = 'd1'").first().detail
    assert [(r.section, r.detail) for r in got.where("repo_id = 's'").collect()] == [("summary", "ok"), ("risk", "a")]


# ---------------------------------------------------------------- markup

def test_image_positions(spark):
    html = 'é😀\n<p>\n<img alt="A" src="placeholder.png">\n<div style="background-image: url(\'b.png\')">\n<IMG\n src=\'c.png\' alt=C>' * 2
    got = markup.image_refs(artifacts_of(spark, {"a.html": html, "b.py": html, "c.css": "no"})).collect()
    for pattern, kind, flags, context in ((rules.IMG_TAG, "img_tag", re.I | re.S, 100), (rules.BACKGROUND_IMAGE, "bg_image", re.I, 80),
                                          (rules.JSX_IMAGE, "jsx_img", re.I, 80)):
        want = [(m.group(1), html[:m.start()].count("\n") + 1, html[max(0, m.start() - context):m.end() + context].strip(), m.group(0))
                for m in re.finditer(pattern, html, flags)]
        assert [(r.src, r.line, r.context, r.full_match) for r in got if r.type == kind] == want and want
    assert {r.src: r.is_placeholder for r in got} == {"placeholder.png": True, "b.png": False, "c.png": False}


def test_injection_and_rewrite_are_idempotent(spark):
    pages = artifacts_of(spark, {"a.html": "<html><head></head><head>", "b.html": "<body>x", "c.html": "plain", "d.js": "<head>"})
    once = markup.inject_api_base(pages, "https://b.example.org")
    twice = markup.inject_api_base(once.drop("changed"), "https://b.example.org")
    got = {r.filename: r.content for r in once.collect()}
    assert got["a.html"].startswith("<html><head>\n<script>") and got["a.html"].count("<script>") == 1
    assert got["c.html"].endswith("</script>\nplain") and got["d.js"] == "<head>"
    assert twice.where("changed").count() == 0
    js = artifacts_of(spark, {"a.js": "fetch('http://127.0.0.1:8000/x'); 'http://localhost:80001'", "b.py": "http://localhost:8000"})
    new = {r.filename: r.content for r in markup.rewrite_local_urls(js, "https://h/$1\\x").collect()}
    assert new == {"a.js": "fetch('https://h/$1\\x/x'); 'http://localhost:80001'", "b.py": "http://localhost:8000"}


@pytest.mark.parametrize("tree,want", [
    ({"frontend/app.py": "", "svc/api.py": ""}, ("svc/api.py", "python", 1)),
    ({"x.py": "", "backend/z.py": ""}, ("backend/z.py", "python", 2)),
    ({"x.py": "", "server.js": "listen"}, ("server.js", "node", 3)),
    ({"server.js": "window.x", "y.py": ""}, ("y.py", "python", 4)),
    ({"package.json": "", "server/run.js": "listen"}, ("server/run.js", "node", 5)),
    ({"server/run.js": "listen"}, ("modernized_stack/backend/main.py", "python", 6)),
    ({"public/index.js": "", "package.json": ""}, ("modernized_stack/backend/main.py", "python", 6)),
])
def test_entrypoints(spark, rows, tree, want):
    assert rows(markup.entrypoint_runtime(artifacts_of(spark, tree)), "entrypoint", "runtime", "rule") == [want]


def test_preview_choice(spark, rows):
    tree = {"a.htm": "", "x/INDEX.html": "", "p/my-preview.html": ""}
    assert rows(markup.preview_file(artifacts_of(spark, tree)), "filename") == [("p/my-preview.html",)]


# ---------------------------------------------------------------- sets

def test_upsert(spark, rows):
    base = spark.createDataFrame([("r", "1", 0, "a", "old"), ("r", "1", 1, "b", "keep"), ("r", "1", 2, "a", "second")],
                                 "repo_id string, run_id string, file_ord bigint, filename string, content string")
    edits = spark.createDataFrame([("r", "1", "a", "x", 0), ("r", "1", "n", "new", 1), ("r", "1", "a", "last", 2)],
                                  "repo_id string, run_id string, filename string, content string, edit_ord bigint")
    once = matching.upsert_artifacts(base, edits)
    assert rows(once, "file_ord", "filename", "content") == [(0, "a", "last"), (1, "b", "keep"), (2, "a", "second"), (4, "n", "new")]
    again = matching.upsert_artifacts(once.drop("edited"), edits)
    assert rows(again, "file_ord", "filename", "content") == rows(once, "file_ord", "filename", "content")


def test_missing_files_cover_expected(spark, rows):
    want = corpus_of(spark, {f"src/f{i}.py": "" for i in range(20)})
    have = artifacts_of(spark, {"src/f0.py": "", "other/f1.py": ""})
    got = matching.missing_files(want, have)
    assert got.count() == 18 and rows(got.select("recoverable").distinct()) == [(False,)]
    assert rows(matching.missing_files(want.where("file_ord < 5"), have), "path", "recoverable") == [
        (f"src/f{i}.py", True) for i in (2, 3, 4)]


def test_frontend_layout(spark, rows):
    tree = {"a/page.html": "", "b/page.html": "", "app/next.config.js": "", "web/package.json": "", "public/x.html": ""}
    got = rows(profile.frontend_layout(artifacts_of(spark, tree)), "role", "dir", "frontend_type")
    # any page counts as static, because "html" itself is one of the hints
    assert got == [("frontend", "app", "React/NPM"), ("frontend", "web", "React/NPM"), ("static", "a", "React/NPM"),
                   ("static", "b", "React/NPM"), ("static", "public", "React/NPM")]
    only = rows(profile.python_stack_frontend(artifacts_of(spark, {"x/index.html": ""})), "has_static", "frontend_dir")
    assert only == [(True, ".")]


def test_locate_content(spark, rows):
    arts = artifacts_of(spark, {"a.html": 'Hello world <b id="x1">', "b.js": "id: 'x1'; Hello", "c.py": "Hello world", "d.js": "logo.svg"})
    picks = spark.createDataFrame([("r", 1, " Hello world ", "", ""), ("r", 2, "He", "x1", ""), ("r", 3, "", "", "logo.svg")],
                                  "repo_id string, sel_id int, text string, element_id string, src string")
    assert rows(matching.locate_content(picks, arts)) == [
        ("r", 1, "a.html"), ("r", 2, "a.html"), ("r", 2, "b.js"), ("r", 3, "d.js")]
    assert rows(matching.locate_content(picks, arts, first_src_only=True)) == [("r", 3, "d.js")]


# ---------------------------------------------------------------- imports

PY = [
    "import a.b as c, d\nfrom e.f import g, h as i\n", "x = '''\nimport hidden\n'''\n", "def broken(:\n  import z\n",
    "from . import rel\nfrom .m import n\nimport os\n", "if 1:\n    from pydantic import (BaseModel, EmailStr)\n",
]


def test_exact_imports(spark):
    df = spark.createDataFrame([("r", i, f"{i}.py", t) for i, t in enumerate(PY)], "repo_id string, file_ord int, path string, content string")
    got = {}
    for r in profile.python_imports(df, exact=True).collect():
        got.setdefault(r.path, []).append((r.root, list(r.names)))
    assert got["0.py"] == [("a", []), ("d", []), ("e", ["g", "h"])]
    assert "1.py" not in got and "2.py" not in got
    assert [x[0] for x in got["3.py"]] == ["m", "os"] or got["3.py"] == [("m", ["n"]), ("os", [])]
    assert ast.parse(PY[4]) and got["4.py"] == [("pydantic", ["BaseModel", "EmailStr"])]
    packages = {r.package for r in profile.package_lookup(profile.python_imports(df)).collect()}
    assert packages == {"pydantic", "pydantic[email]", "email-validator"}


def test_node_deps(spark, rows):
    df = corpus_of(spark, {"package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": {"x": 1}}}', "x/package.json": "{bad"})
    assert rows(profile.declared_node_deps(df), "package", "section") == [("a", "dependencies"), ("b", "devDependencies")]


# ---------------------------------------------------------------- tokens

def test_tokens(spark):
    code = {"a.py": "@dec\ndef Foo(x): # c 'no'\n  s = 'a\\'b' + 1.5e3", "b.js": "const A = run(\"x\") // end\n`open", "c.html": "<!-- a --> <b>"}
    got = {(r.token_language, r["class"]): r.tokens for r in profile.token_profile(corpus_of(spark, code)).collect()}
    assert got == {
        ("py", "decorator"): 1, ("py", "keyword"): 1, ("py", "type"): 1, ("py", "bracket"): 2, ("py", "operator"): 3,
        ("py", "comment"): 1, ("py", "string"): 1, ("py", "number"): 1,
        ("js", "keyword"): 1, ("js", "operator"): 1, ("js", "function"): 1, ("js", "bracket"): 2, ("js", "string"): 2,
        ("js", "comment"): 1, ("html", "comment"): 1, ("html", "operator"): 2}


# ---------------------------------------------------------------- plans

PLAN = """# Plan
**BATCH 1 - Core Stuff**:
- src/a.py
  - `b.py`
- missing.zzz
BATCH 2: Extra:
- lib/src/c.py
- py
#### BATCH 3: no header here
- d.txt
"""


def test_plan_matching(spark, rows):
    files = corpus_of(spark, {"src/a.py": "aa", "x/b.py": "bb", "c.py": "cc", "src/d.txt": "d", "e.md": "e"}).withColumn("chars", F.col("size"))
    plans = spark.createDataFrame([("r", PLAN), ("q", "nothing")], "repo_id string, plan string")
    got = rows(batching.plan_assignments(plans, files), "batch_ord", "batch_name", "planned_path", "path", "match_kind")
    assert got == [
        (0, "Core Stuff", "b.py", "x/b.py", "fuzzy"), (0, "Core Stuff", "src/a.py", "src/a.py", "exact"),
        (1, "Extra", "d.txt", "src/d.txt", "fuzzy"), (1, "Extra", "lib/src/c.py", "c.py", "fuzzy"), (1, "Extra", "py", "src/a.py", "fuzzy")]
    both = files.unionByName(corpus_of(spark, {"k/z.py": "1", "p.json": "22"}, "q").withColumn("chars", F.col("size")))
    done = rows(batching.plan_batches(plans, both, 100), "repo_id", "batch_name", "path")
    assert ("r", "Remaining Files", "e.md") in done and ("q", "k", "k/z.py") in done and ("q", "Config & Dependencies", "p.json") in done


def test_fallback_plan_headers_never_parse(spark):
    plans = spark.createDataFrame([("r", "### Batch Groups\n\n#### BATCH 1: src\n- a.py\n")], "repo_id string, plan string")
    assert batching.parse_plan(plans).count() == 0


def test_signatures(spark):
    text = "import x\nconst { a } = b\n  def f():\nnothing\n" + "class A" + "x" * 200
    got = batching.signature_summary(artifacts_of(spark, {"a": text, "b": "plain", "c": "def x\n" * 40})).collect()
    lines = got[0].summary.split("\n")
    assert lines[:4] == ["import x", "const { a } = b", "const { a } = b", "def f():"]
    assert len(lines[4]) == 120 or lines[4].startswith("class A") is False
    assert got[1].summary == "[config/static file]" and got[2].summary.count("def x") == 30


# ---------------------------------------------------------------- sources

def test_scan_tree_and_contents(spark, tmp_path, rows):
    for name, text in (("r1/src/a.py", "x"), ("r1/b.txt", "yy"), ("r2/z/k.js", "é")):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    tree = corpus.scan_tree(spark, str(tmp_path / "root"))
    assert rows(tree, "repo_id", "file_ord", "path", "size") == [("r1", 0, "b.txt", 2), ("r1", 1, "src/a.py", 1), ("r2", 0, "z/k.js", 2)]
    raw = corpus.read_contents(spark, str(tmp_path / "root"), tree.where("repo_id = 'r2'"))
    got = corpus.load_contents(tree.where("repo_id = 'r2'"), raw=raw)
    assert rows(got, "path", "content") == [("z/k.js", "é")]


def test_load_contents_stores(spark, rows):
    import base64

    files = spark.createDataFrame([("r", p, s) for p, s in (("a", "s1"), ("b", "s2"), ("c", "s3"), ("d", "s4"))], "repo_id string, path string, sha string")
    enc = lambda b: base64.b64encode(b).decode()
    contents = spark.createDataFrame([("r", "a", enc(b"ok\xff!"))], "repo_id string, path string, base64 string")
    raw = spark.createDataFrame([("r", "a", bytearray(b"raw")), ("r", "b", bytearray(b"\xff\xfe")), ("r", "c", bytearray(b"c\0\0"))],
                                "repo_id string, path string, bytes binary")
    blobs = spark.createDataFrame([("s2", enc(b"blob"))], "sha string, base64 string")
    assert rows(corpus.load_contents(files, contents, raw, blobs), "path", "content") == [("a", "ok!"), ("b", "blob")]


def test_artifacts_round_trip(spark, tmp_path):
    arts = artifacts_of(spark, {"a b.py": "x = 'é'\n", "n": None})
    got = corpus.write_artifacts(arts, str(tmp_path / "out"), 4).collect()
    body = "x = 'é'\n".encode()
    assert [(r.path, r.bytes, r.sha) for r in got] == [
        ("a_b.py", len(body), hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest())]
    with pytest.raises(ValueError):
        corpus.write_artifacts(arts.where("content IS NULL"), str(tmp_path / "none"))


def test_memory_documents(spark, tmp_path):
    import json

    doc = {"repo_url": "https://github.com/a/b", "repo_id": "x", "total_attempts": 3, "failures": [{"error_type": "E"}]}
    url = SHOP
    doc["repo_id"] = SHOP_KEY
    (tmp_path / "a_memory.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b_memory.json").write_text("{broken")
    repos = spark.createDataFrame([(url,), ("https://github.com/o/new",)], "repo_url string")
    got = {r.repo_url: r for r in memory_store.scan_memory(spark, str(tmp_path), repos).collect()}
    assert got[url].total_attempts == 3 and got[url].failures[0].error_type == "E"
    fresh = got["https://github.com/o/new"]
    assert fresh.total_attempts == 0 and fresh.decisions == [] and fresh.user_preferences.keep_original_paths
    store = str(tmp_path / "store")
    mem = memory_store.scan_memory(spark, str(tmp_path), repos)
    memory_store.write_memory(mem, store, 4)
    memory_store.write_memory(mem.where("total_attempts = 3").withColumn("total_attempts", F.lit(4).cast("bigint")), store, 4)
    back = {r.repo_url: r.total_attempts for r in memory_store.read_memory(spark, store).collect()}
    assert back == {url: 4, "https://github.com/o/new": 0}
    memory_store.forget_repo(spark, store, spark.createDataFrame([(SHOP_KEY,), ("unknown",)], "repo_id string"), 4)
    assert [r.repo_url for r in memory_store.read_memory(spark, store).collect()] == ["https://github.com/o/new"]


def test_decisions_are_cut_only_by_success(spark):
    from tests.test_streaming import events_of

    ev = [("decision", i) for i in range(25)] + [("success", 25)] + [("decision", 26 + i) for i in range(25)]
    df = events_of(spark, [(i, "r", i, k) for k, i in ev])
    got = sorted(r.event_id for r in memory.recent_decisions(df).collect())
    assert got == list(range(6, 51))


def test_imports_in_brackets_and_on_shared_lines(spark, rows):
    from pyspark.sql import Row

    text = ("from pydantic import (\n    BaseModel,  # with (a) remark\n    EmailStr as E,\n)\nimport os; import numpy as np\n"
            "import a.b, c \\\n  , d\nfrom .near import x\nimportant = 1\nif x: pass; from json import loads\nfrom re import *")
    df = spark.createDataFrame([Row(repo_id="r", path="m.py", content=text)])
    got = [(r.root, r.names) for r in profile.python_imports(df).collect()]
    assert got == [("pydantic", ["BaseModel", "EmailStr"]), ("os", []), ("numpy", []), ("a", []), ("c", []), ("d", []),
                   ("json", ["loads"]), ("re", ["*"])]


def test_pages_of_one_name_keep_their_own_assets(spark):
    rows = [("r", "x", 1, "p.html", '<script src="a.js"></script>'), ("r", "x", 2, "p.html", '<script src="b.js"></script>'),
            ("r", "x", 3, "a.js", "A"), ("r", "x", 4, "b.js", "B")]
    arts = spark.createDataFrame(rows, "repo_id string, run_id string, file_ord long, filename string, content string")
    out = markup.inline_assets(arts, markup.asset_links(arts)).orderBy("file_ord").collect()
    assert [r.content for r in out] == ["<script>\nA\n</script>", "<script>\nB\n</script>"]


def test_payload_keeps_repositories_without_findings_and_lists_all_without_a_cap(spark):
    rows = [("r", 0, i, 0, "f.py", "endpoint", f"GET /{i}") for i in range(31)]
    found = spark.createDataFrame(rows, "repo_id string, phase int, file_ord long, pos int, path string, kind string, value string")
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    got = {r.repo_id: r for r in profile.analysis_payload(found, endpoints=None, repos=repos).collect()}
    assert got["r"].api_endpoints == [f"GET /{i}" for i in range(31)]
    assert got["empty"].api_endpoints == [] and got["empty"].env_vars == []
