"""Images, linked assets and rewrites in page and script text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.paths import basename, contains_any, ends_with_any, lookup, strip
from ..functions.places import let, sums_before
from .selection import is_placeholder

RUN = ("repo_id", "run_id")


def _matches(text: Column, pattern: str, context: int, kind: str) -> Column:
    """All matches with offset and line.

    The text between two matches is what ``split`` returns, so running sums over the lengths of gaps and
    matches give exact offsets without a search per match.  The pattern reads the text twice, for the matches and for
    the gaps; what a match captures is read from the match.
    """
    zero = F.lit(0).cast("bigint")

    def newlines(s):
        return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def row(x, start, line):
        lo = F.greatest(start - context, zero)
        end = start + F.length(x["m"])
        around = F.substring(text, (lo + 1).cast("int"), (end + context - lo).cast("int"))
        alt = F.regexp_extract(x["m"], "(?i)" + rules.ALT_TEXT, 1) if kind == "img_tag" else F.lit("")
        return F.struct(
            F.lit(kind).alias("type"), F.regexp_extract(x["m"], pattern, 1).alias("src"), alt.alias("alt"),
            (line + 1).cast("int").alias("line"), strip(around).alias("context"),
            x["m"].alias("full_match"), start.cast("bigint").alias("offset"),
        )

    def placed(found):
        lengths = F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["m"]))
        breaks = F.transform(found, lambda x: newlines(x["gap"]) + newlines(x["m"]))
        return let(sums_before(lengths), lambda starts: let(sums_before(breaks), lambda lines: F.transform(
            found, lambda x, i: row(x, F.get(starts, i) + F.length(x["gap"]), F.get(lines, i) + newlines(x["gap"])))))

    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    # the text behind the last match has no match of its own
    return let(F.filter(found, lambda x: x["m"].isNotNull()), placed)


def image_refs(artifacts: DataFrame, by=("repo_id",)) -> DataFrame:
    """Image references: tags, CSS backgrounds and component tags (one tag can give two rows)."""
    text = F.col("content")
    rows = F.concat(
        _matches(text, "(?is)" + rules.IMG_TAG, 100, "img_tag"),
        _matches(text, "(?i)" + rules.BACKGROUND_IMAGE, 80, "bg_image"),
        _matches(text, "(?i)" + rules.JSX_IMAGE, 80, "jsx_img"),
    )
    return (
        artifacts.where(ends_with_any(F.col("filename"), rules.IMAGE_FILE_EXTENSIONS))
        # most files hold no image at all; a plain substring test is far cheaper than three scans
        .where(contains_any(F.lower("content"), ("<im", "background")))
        .select(*by, "filename", F.inline(rows))
        .withColumn("is_placeholder", is_placeholder(F.col("src")))
    )


def image_ref_counts(refs: DataFrame, by=("repo_id",)) -> DataFrame:
    return refs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_placeholder").alias("placeholders")
    )


# ---------------------------------------------------------------- linked assets

ASSET_TAG = "(?i)" + rules.STYLESHEET_LINK + "|" + rules.SCRIPT_LINK


def asset_refs(artifacts: DataFrame, by=RUN) -> DataFrame:
    """Stylesheet links and script sources of pages in page order: (…, html, html_ord, ref_ord, kind, ref, tag).

    ``html_ord`` tells pages of one name in a run apart.
    """
    tags = F.arrays_zip(*[
        F.regexp_extract_all("content", F.lit(ASSET_TAG), F.lit(g)).alias(f"g{g}") for g in range(4)
    ])

    def row(x):
        return F.struct(
            F.when(F.lower(x["g0"]).startswith("<link"), "css").otherwise("js").alias("kind"),
            F.concat(x["g1"], x["g2"], x["g3"]).alias("ref"),  # all but one are empty
            x["g0"].alias("tag"),
        )

    low = F.lower("filename")
    return (
        artifacts.where(low.endswith(".html") | low.endswith(".htm"))
        .select(
            *by, F.col("filename").alias("html"), F.col("file_ord").alias("html_ord"),
            F.posexplode(F.transform(tags, row)).alias("ref_ord", "_r"),
        )
        .select(*by, "html", "html_ord", "ref_ord", "_r.kind", "_r.ref", "_r.tag")
    )


def asset_links(artifacts: DataFrame, by=RUN) -> DataFrame:
    """References resolved to artifacts; ``target`` is null where nothing matches.

    A reference tries itself, its file name, then itself under ``./``.  Each file answers to its
    full path and to its name, the last file winning a shared key, so the lookup side holds one
    row per key and a hot name costs no fan-out.  A file with no text never resolves.
    """
    by = list(by)
    low = F.lower("filename")
    kind = F.when(low.endswith(".css"), "css").when(low.endswith(".js"), "js")
    answers = (
        artifacts.withColumn("kind", kind).where(F.col("kind").isNotNull())
        .select(
            *by, "kind", "file_ord", "filename", (F.length("content") > 0).alias("_full"),
            F.explode(F.array_distinct(F.array(F.col("filename"), basename(F.col("filename"))))).alias("_key"),
        )
        .groupBy(*by, "kind", "_key")
        .agg(F.max_by(F.struct("filename", "file_ord", "_full"), "file_ord").alias("_t"))
        .where("_t._full").select(
            *by, "kind", "_key", F.struct("_t.filename", "_t.file_ord").alias("target")
        )
    )
    tries = asset_refs(artifacts, by).select(
        *by, "html", "html_ord", "ref_ord", "kind", "ref", "tag",
        F.posexplode(F.array(
            F.col("ref"), basename(F.col("ref")), F.concat(F.lit("./"), F.col("ref"))
        )).alias("_try", "_key"),
    )
    return (
        tries.join(answers, [*by, "kind", "_key"], "left")
        .groupBy(*by, "html", "html_ord", "ref_ord", "kind", "ref", "tag")
        .agg(F.min(F.when(F.col("target").isNotNull(), F.struct("_try", "target"))).alias("_hit"))
        .select(
            *by, "html", "html_ord", "ref_ord", "kind", "ref", "tag",
            F.col("_hit.target.filename").alias("target"),
            F.col("_hit.target.file_ord").alias("target_ord"),
            F.col("_hit").isNotNull().alias("resolved"),
        )
    )


def inline_assets(artifacts: DataFrame, links: DataFrame, by=RUN) -> DataFrame:
    """Pages with resolved stylesheet and script tags replaced by the text they point to."""
    by = list(by)
    bodies = links.where("resolved").join(
        artifacts.select(
            *by, F.col("filename").alias("target"), F.col("file_ord").alias("target_ord"),
            F.col("content").alias("_body"),
        ),
        [*by, "target", "target_ord"],
    )
    wrapped = F.when(
        F.col("kind") == "css", F.concat(F.lit("<style>\n"), F.col("_body"), F.lit("\n</style>"))
    ).otherwise(F.concat(F.lit("<script>\n"), F.col("_body"), F.lit("\n</script>")))
    per_page = bodies.groupBy(*by, F.col("html").alias("filename"), F.col("html_ord").alias("file_ord")).agg(
        F.map_from_entries(F.collect_list(F.struct("ref_ord", wrapped.alias("body")))).alias("_subs")
    )
    # texts between tags and tags alternate, so what was put in is never searched again
    pieces = F.arrays_zip(
        F.split("content", ASSET_TAG, -1).alias("gap"),
        F.regexp_extract_all("content", F.lit(ASSET_TAG), F.lit(0)).alias("tag"),
    )
    text = F.when(F.col("_subs").isNull(), F.col("content")).otherwise(F.array_join(
        F.transform(pieces, lambda x, i: F.concat(
            x["gap"], F.coalesce(F.try_element_at("_subs", i), x["tag"], F.lit(""))
        )), "",
    ))
    low = F.lower("filename")
    return (
        artifacts.where(low.endswith(".html") | low.endswith(".htm"))
        .join(per_page, [*by, "filename", "file_ord"], "left")
        .select(*by, "file_ord", "filename", text.alias("content"),
                F.col("_subs").isNotNull().alias("changed"))
    )


# ---------------------------------------------------------------- rewrites

def rewrite_local_urls(
    artifacts: DataFrame, backend_url, extensions=rules.REWRITE_EXTENSIONS
) -> DataFrame:
    """Point hard-coded local server URLs of front-end files at ``backend_url``."""
    url = backend_url if isinstance(backend_url, Column) else F.lit(backend_url)
    # a replacement text must not be read as a group reference
    literal = F.replace(F.replace(url, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    new = F.when(
        ends_with_any(F.col("filename"), extensions),
        F.regexp_replace("content", F.lit(rules.LOCAL_URL), literal),
    ).otherwise(F.col("content"))
    return _changed(artifacts, new)


def inject_api_base(artifacts: DataFrame, backend_url: str) -> DataFrame:
    """Put one script that names the server into each .html page, unless it is there already."""
    tag = f'<script>window.__API_BASE_URL__ = "{backend_url}";</script>'
    text = F.col("content")
    missing = ~(
        text.contains("__API_BASE_URL__")
        & text.contains(f'window.__API_BASE_URL__ = "{backend_url}"')
    )

    def after(anchor):
        at = F.instr(text, anchor)
        return F.concat(
            F.substring(text, F.lit(1), at + len(anchor) - 1), F.lit("\n" + tag),
            F.substring(text, at + len(anchor), F.length(text)),
        )

    injected = (
        F.when(text.contains("<head>"), after("<head>"))
        .when(text.contains("<body>"), after("<body>"))
        .otherwise(F.concat(F.lit(tag + "\n"), text))
    )
    return _changed(
        artifacts, F.when(F.col("filename").endswith(".html") & missing, injected).otherwise(text)
    )


def replace_image(artifacts: DataFrame, images: DataFrame, by=RUN) -> DataFrame:
    """Replace one source in one file by a data URI.

    ``images`` holds (…run…, filename, old_src, image_base64, mime), one row per file.
    """
    keys = [*by, "filename"]
    uri = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.col("image_base64"))
    joined = artifacts.join(images.withColumn("_uri", uri).select(*keys, "old_src", "_uri"), keys, "left")
    new = F.when(
        F.col("_uri").isNotNull(), F.replace("content", F.col("old_src"), F.col("_uri"))
    ).otherwise(F.col("content"))
    return _changed(joined, new).select(*artifacts.columns, "changed")


def _changed(df: DataFrame, new: Column) -> DataFrame:
    return (
        df.withColumn("_new", new)
        .withColumn("changed", F.col("_new") != F.col("content"))
        .withColumn("content", F.col("_new")).drop("_new")
    )


HINT_CHARS = 30


def asset_filename(digest_chars: int | None = None, hint_chars: int = HINT_CHARS) -> Column:
    """File name of an image by its hint and the digest of its content.

    With ``digest_chars`` only that many base64 characters are digested, so images with a common
    header share a name; the default takes the whole content.
    """
    content = F.col("image_base64")
    if digest_chars is not None:
        content = F.substring(content, 1, digest_chars)
    digest = F.substring(F.md5(content.cast("binary")), 1, 8)
    ext = F.coalesce(lookup(rules.EXTENSION_BY_MIME, F.col("mime")), F.lit(".png"))
    hint = F.substring(F.regexp_replace("hint", "[^a-zA-Z0-9_-]", "_"), 1, hint_chars)
    return F.concat(F.lit("public/assets/"), hint, F.lit("_"), digest, ext)


def asset_manifest(images: DataFrame, digest_chars: int | None = None) -> DataFrame:
    """Content-addressed file name of each image, and how many images share it.

    ``images`` holds (repo_id, hint, mime, image_base64).
    """
    named = images.select("repo_id", "mime", asset_filename(digest_chars).alias("filename"))
    return named.groupBy("repo_id", "mime", "filename").agg(F.count(F.lit(1)).alias("images")).withColumn(
        "asset_path", F.regexp_replace("filename", "^public", "")
    )


def asset_artifacts(images: DataFrame, by=RUN, digest_chars: int | None = None) -> DataFrame:
    """Artifact rows for images: SVG as text, the others as a data URI."""
    content = F.when(
        F.col("mime") == "image/svg+xml", F.decode(F.unbase64("image_base64"), "UTF-8")
    ).otherwise(F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.col("image_base64")))
    return images.select(
        *by, asset_filename(digest_chars).alias("filename"), content.alias("content"),
    )


def preview_file(artifacts: DataFrame, by=RUN) -> DataFrame:
    """Page that best stands for a run: preview.html, then index.html, then any page."""
    low = F.lower("filename")
    rank = (
        F.when(low.contains("preview.html"), 1)
        .when(basename(low) == "index.html", 2)
        .when(low.endswith(".html") | low.endswith(".htm"), 3)
    )
    return (
        artifacts.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
        .groupBy(*by)
        .agg(F.min(F.struct("_rank", "file_ord", "filename")).alias("_b"))
        .select(*by, "_b.filename", "_b.file_ord", F.col("_b._rank").alias("rank"))
    )


def entrypoint_runtime(artifacts: DataFrame, by=RUN) -> DataFrame:
    """One entrypoint and runtime per run, by priority and then file order."""
    f = F.col("filename")
    low, name = F.lower(f), basename(f)
    text = F.coalesce(F.col("content"), F.lit(""))
    is_py, is_js = f.endswith(".py"), f.endswith(".js")
    priority = (
        F.when(name.isin(*rules.PYTHON_ENTRYPOINTS) & ~contains_any(low, ("frontend", "client")), 1)
        .when(is_py & contains_any(low, ("backend", "api")), 2)
        .when(
            (name.isin(*rules.NODE_ENTRYPOINTS) | f.endswith("server.js"))
            & ~contains_any(low, ("frontend", "client", "public"))
            & ~contains_any(text, rules.BROWSER_MARKERS), 3,
        )
        .when(is_py, 4)
        .when(
            is_js & contains_any(low, ("backend", "server"))
            & ~contains_any(text, ("document.", "window.")), 5,
        )
    )
    marked = artifacts.select(
        *by, "file_ord", "filename", priority.alias("_p"),
        f.endswith("package.json").alias("_pkg"),
    )
    best = marked.groupBy(*by).agg(
        F.min(F.when(F.col("_p") <= 4, F.struct("_p", "file_ord", "filename"))).alias("_a"),
        F.min(F.when(F.col("_p") == 5, F.struct("_p", "file_ord", "filename"))).alias("_b"),
        F.bool_or("_pkg").alias("_has_pkg"),
    )
    pick = F.coalesce("_a", F.when(F.col("_has_pkg"), F.col("_b")))
    rule = F.coalesce(pick["_p"], F.lit(6))
    return best.select(
        *by,
        F.coalesce(pick["filename"], F.lit(rules.DEFAULT_ENTRYPOINT)).alias("entrypoint"),
        F.when(rule.isin(3, 5), "node").otherwise("python").alias("runtime"),
        rule.alias("rule"),
    )
