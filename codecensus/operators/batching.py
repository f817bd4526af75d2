"""Size-budgeted batches of files.

Everything here works on metadata (path, order, size in characters).  Contents are joined only
by :func:`batch_documents`, where the budget bounds what is put together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import rules
from ..functions.paths import basename, dirname, extension, language, strip
from ..functions.scale import BUCKET, bucket_of, durable, positions_by_number, positions_by_range
from .matching import match_plan_paths, model_budget, remaining_files
from .profile import analysis_payload

#: segments whose step functions are composed in one place
FAN = 1024
#: bytes of bodies that share one copy of their repository's lists
CELL = 1 << 26
DEFAULT_BUDGET = rules.MODEL_LIMITS[rules.DEFAULT_MODEL][1]


# ---------------------------------------------------------------- greedy packing

STEP = (
    "struct<bounds:array<bigint>,opened:array<bigint>,left:array<bigint>,total:bigint,"
    "fresh_opened:bigint,fresh_left:bigint>"
)


def pack_by_budget(
    files: DataFrame, keys, budget=DEFAULT_BUDGET, order: str = "file_ord", size: str = "chars",
    bucket: int = BUCKET, fan: int = FAN,
) -> DataFrame:
    """Add ``part``, the 1-based bin of a greedy in-order split at ``budget``, and ``parts``.

    A file that does not fit the open bin starts the next one; a file larger than the budget
    sits alone; order is kept.  ``order`` is an integer that is unique in the group; ``budget``
    is a number or a column that is constant per group.

    A group of more than ``bucket`` files is cut into segments of ``bucket`` order numbers.
    What a segment does to packing is a step function of the characters in the bin that is open
    before it: how many bins it opens and what it leaves open.  Step functions compose to step functions: those of
    each segment are computed in parallel, those of ``fan`` neighbours are composed into one, and only these
    (one per ``fan * bucket`` files) are followed from the start of the group to its end.  The states found
    go back down, and every segment is packed by itself from the state it starts in.  The result is that of one
    sequential pass, but no task ever holds more than one segment of files or ``fan`` functions.
    """
    keys = list(keys)
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    payload = [c for c in files.columns if c not in keys]
    # at most one group in ``bucket`` files can be this large, so the list is short
    several = (
        files.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket)
        .select(*keys, F.lit(True).alias("_large"))
    )
    seg = (
        files.withColumn("_limit", limit.cast("bigint"))
        .withColumn("_item", F.struct(
            F.col(order).cast("bigint").alias("o"),
            F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"),
            F.struct(*payload).alias("row"),
        ))
        .withColumn("_at", bucket_of(order, bucket))
        .select(*keys, "_limit", "_item", "_at")
        .join(several, keys, "left")
        .withColumn("_seg", F.when(F.col("_large"), F.col("_at")).otherwise(F.lit(0).cast("bigint")))
    )

    def segments(rows, item):
        return rows.groupBy(*keys, "_seg").agg(
            F.array_sort(F.collect_list(item)).alias("_items"), F.max("_limit").alias("_limit")
        )

    steps = segments(
        seg.where("_large"), F.struct("_item.o", "_item.n")
    ).select(*keys, "_seg", F.pandas_udf(_segment_step, STEP)(F.col("_items.n"), F.col("_limit")).alias("_step"))
    starts = _starts(steps, keys, fan)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    packed = (
        segments(seg, F.col("_item")).join(starts, [*keys, "_seg"], "left")
        .withColumn("_bins", F.pandas_udf(_pack_segment, "array<bigint>")(
            F.col("_items.n"), F.col("_limit"), F.coalesce("_open", F.lit(False)),
            F.coalesce("_carry", zero), F.coalesce("_part", one),
        ))
        .withColumn("_total_parts", F.coalesce("_parts", F.element_at("_bins", -1)))
        .select(
            *keys, "_total_parts",
            F.inline(F.arrays_zip(F.col("_items.row").alias("row"), F.col("_bins").alias("part"))),
        )
    )
    return packed.select(*keys, "row.*", "part", F.col("_total_parts").alias("parts"))


def _segment_step(sizes: pd.Series, limit: pd.Series) -> pd.DataFrame:
    def one(n, cap):
        n = np.asarray(n, dtype=np.int64)
        ends = np.cumsum(n)
        before = ends - n
        total = int(ends[-1])
        after = _next_bin(ends, before, cap).tolist()
        opened, left = [1] * len(n), (total - before).tolist()
        for i in range(len(n) - 1, -1, -1):
            j = after[i]
            if j < len(n):
                opened[i] += opened[j]
                left[i] = left[j]
        room = cap - ends  # largest carry that still lets file j in
        keep = np.r_[True, room[1:] != room[:-1]] & np.r_[True, room[:-1] >= 0]
        at = np.flatnonzero(keep)
        return {
            "bounds": room[at].tolist(), "opened": [opened[j] for j in at],
            "left": [left[j] for j in at], "total": total, "fresh_opened": opened[0],
            "fresh_left": left[0],
        }

    return pd.DataFrame([one(n, c) for n, c in zip(sizes, limit)])


def _next_bin(ends, before, cap):
    """For a bin that starts at file i, the file that starts the bin after it."""
    return np.maximum(
        np.searchsorted(ends, before + cap, side="right"), np.arange(1, len(ends) + 1)
    )


def _follow(bounds, opened, left, total, carry: np.ndarray):
    """What a step function does to open bins of ``carry`` characters: what it leaves open and how many bins it opens."""
    at = np.searchsorted(-bounds, -carry, side="right")
    fits = at == len(bounds)  # everything goes into the open bin
    at = np.minimum(at, len(bounds) - 1)
    return np.where(fits, carry + total, left[at]), np.where(fits, 0, opened[at])


def _arrays(step):
    return (*(np.asarray(step[c], dtype=np.int64) for c in ("bounds", "opened", "left")), int(step["total"]))


def _composed(lists: pd.Series) -> pd.DataFrame:
    """One step function that does what those of a list do in turn."""
    def one(steps):
        bounds, opened, left, total = _arrays(steps[0])
        fresh_opened, fresh_left = int(steps[0]["fresh_opened"]), int(steps[0]["fresh_left"])
        for step in steps[1:]:
            after = _arrays(step)
            # bins that meet a step of the first function: the second one takes what is left
            new_left, more = _follow(*after, left)
            new_opened = opened + more
            # bins that take all of the first segment meet the second one fuller by that much; the first negative
            # bound closes the list
            shifted = after[0] - total
            begin = int(np.searchsorted(-shifted, -bounds[-1], side="right"))
            some = np.arange(begin, len(shifted)) if bounds[-1] >= 0 else np.zeros(0, np.int64)
            some = some[np.r_[True, shifted[some][:-1] >= 0]] if len(some) else some
            bounds = np.r_[bounds, shifted[some]]
            left, opened = np.r_[new_left, after[2][some]], np.r_[new_opened, after[1][some]]
            total += after[3]
            fresh = _follow(*after, np.array([fresh_left]))
            fresh_left, fresh_opened = int(fresh[0][0]), fresh_opened + int(fresh[1][0])
            # neighbouring steps to the same state are one
            keep = np.r_[(left[1:] != left[:-1]) | (opened[1:] != opened[:-1]), True]
            bounds, left, opened = bounds[keep], left[keep], opened[keep]
        return {
            "bounds": bounds.tolist(), "opened": opened.tolist(), "left": left.tolist(), "total": total,
            "fresh_opened": fresh_opened, "fresh_left": fresh_left,
        }

    return pd.DataFrame([one(x) for x in lists])


STATES = "array<struct<_open:boolean,_carry:bigint,_part:bigint>>"


def _states(lists: pd.Series, is_open: pd.Series, carry: pd.Series, part: pd.Series) -> pd.Series:
    """The states before each step function of a list, and that after the last one."""
    def one(steps, opened, held, number):
        out = [(bool(opened), int(held), int(number))]
        for step in steps:
            opened, held, number = out[-1]
            if opened:
                left, more = _follow(*_arrays(step), np.array([held]))
                out.append((True, int(left[0]), number + int(more[0])))
            else:
                out.append((True, int(step["fresh_left"]), int(step["fresh_opened"])))
        return [dict(zip(("_open", "_carry", "_part"), x)) for x in out]

    return pd.Series([one(*row) for row in zip(lists, is_open, carry, part)])


def _starts(steps: DataFrame, keys, fan: int) -> DataFrame:
    """(keys, _seg, _open, _carry, _part, _parts): the state each segment starts in, and the bins of its group."""
    compose, follow = F.pandas_udf(_composed, STEP), F.pandas_udf(_states, STATES)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def listed(rows, by, number):
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(number, "_step"))).alias("_list"))

    def down(rows, extra):
        pairs = F.arrays_zip(F.col("_list").alias("list"), F.slice("_states", F.lit(1), F.size("_list")).alias("state"))
        return rows.select(*keys, *extra, F.explode(pairs).alias("_x"))

    blocks = listed(steps.withColumn("_block", F.expr(f"_seg div {fan}")), [*keys, "_block"], "_seg")
    whole = listed(blocks.select(*keys, "_block", compose("_list._step").alias("_step")), keys, "_block")
    top = whole.withColumn("_states", follow("_list._step", F.lit(False), zero, one))
    top = down(top, [F.element_at("_states", -1)["_part"].alias("_parts")]).select(
        *keys, "_parts", "_x.list._block", "_x.state.*")
    inside = blocks.join(top, [*keys, "_block"]).withColumn("_states", follow("_list._step", "_open", "_carry", "_part"))
    return down(inside, ["_parts"]).select(*keys, "_parts", "_x.list._seg", "_x.state.*")


def _pack_segment(
    sizes: pd.Series, limit: pd.Series, is_open: pd.Series, carry: pd.Series, part: pd.Series
) -> pd.Series:
    def one(n, cap, opened, held, first):
        n = np.asarray(n, dtype=np.int64)
        ends = np.cumsum(n)
        before = ends - n
        after = _next_bin(ends, before, cap)
        bins = np.empty(len(n), dtype=np.int64)
        start, number = 0, first
        if opened:
            start = int(np.searchsorted(ends, cap - held, side="right"))
            bins[:start] = first
            number = first + 1
        while start < len(n):
            bins[start:after[start]] = number
            start, number = after[start], number + 1
        return bins

    return pd.Series([one(*row) for row in zip(sizes, limit, is_open, carry, part)])


def part_name(name: Column) -> Column:
    """Batch name with its part number wherever the batch was split."""
    return F.when(
        F.col("parts") > 1, F.concat(name, F.lit(" (Part "), F.col("part"), F.lit(")"))
    ).otherwise(name)


# ---------------------------------------------------------------- directory batches

def directory_groups(files: DataFrame) -> DataFrame:
    """Config files in one group, the others by directory; (batch_rank, batch_key) sorts them."""
    path = F.col("path")
    config = basename(path).isin(*rules.CONFIG_NAMES) | extension(path).isin(
        *rules.CONFIG_EXTENSIONS
    )
    folder = F.coalesce(F.nullif(dirname(path), F.lit("")), F.lit("root"))
    name = F.when(folder == "root", rules.ROOT_BATCH).otherwise(
        F.replace(folder, F.lit("/"), F.lit(" > "))
    )
    return (
        files.withColumn("batch_rank", F.when(config, 0).otherwise(1))
        .withColumn("batch_key", F.when(config, F.lit("")).otherwise(folder))
        .withColumn("batch_name", F.when(config, rules.CONFIG_BATCH).otherwise(name))
    )


BATCH_COLUMNS = (
    "repo_id", "batch_rank", "batch_key", "batch_name", "part", "parts", "item_ord", "file_ord",
    "path", "chars",
)


def directory_batches(files: DataFrame, budget=DEFAULT_BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Batches by directory, split at the budget.

    Batches sort by (batch_rank, batch_key, part); :func:`number_batches` gives them dense
    numbers where a consumer needs those.
    """
    grouped = directory_groups(files.select("repo_id", "file_ord", "path", "chars")).withColumn(
        "item_ord", F.col("file_ord")
    )
    return pack_by_budget(
        grouped, ["repo_id", "batch_rank", "batch_key", "batch_name"], budget, "item_ord",
        bucket=bucket,
    ).select(*BATCH_COLUMNS).withColumn("batch_name", part_name(F.col("batch_name")))


def top_level_groups(files: DataFrame) -> DataFrame:
    """The coarser grouping used when no plan could be made: first path component or ``root``."""
    parts = F.split(F.translate("path", "\\", "/"), "/")
    return files.withColumn(
        "batch_name", F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("root"))
    )


# ---------------------------------------------------------------- planned batches

PLAN_HEADER = r"(?i)^(?:\*\*)?BATCH\s+\d+\s*[-:]\s*(.+?)(?:\*\*)?:?\s*$"


def parse_plan(plans: DataFrame) -> DataFrame:
    """Path lines under batch headers of a plan: (repo_id, batch_ord, batch_name, item_ord, planned_path).

    A plan is one row, so its lines are handled in place: header positions cut the line array
    into one slice per batch, and no shuffle is needed to carry a header down to its lines.
    """
    lines = F.transform(F.split("plan", "\n"), strip)
    heads = F.filter(
        F.transform(F.col("_lines"), lambda x, i: F.when(x.rlike(PLAN_HEADER), i + 1)),
        lambda i: i.isNotNull(),
    )
    name = F.regexp_replace(
        strip(F.regexp_extract(F.element_at("_lines", F.col("_head")), PLAN_HEADER, 1)), ":+$", ""
    )
    cut = (
        plans.select("repo_id", lines.alias("_lines")).withColumn("_heads", heads)
        .select("repo_id", "_lines", "_heads", F.posexplode("_heads").alias("_i", "_head"))
        .select(
            "repo_id", F.col("_i").alias("batch_ord"), name.alias("batch_name"), "_head",
            F.slice(
                "_lines", F.col("_head") + 1,
                F.coalesce(F.get("_heads", F.col("_i") + 1), F.size("_lines") + 1)
                - F.col("_head") - 1,
            ).alias("_body"),
        )
        .select("repo_id", "batch_ord", "batch_name", "_head", F.posexplode("_body").alias("_j", "_line"))
    )
    planned = F.regexp_replace(
        strip(F.substring(F.col("_line"), F.lit(3), F.length("_line"))), r"""^[`"']+|[`"']+$""", ""
    )
    return cut.where(F.col("_line").startswith("- ")).select(
        "repo_id", F.col("batch_ord").cast("bigint").alias("batch_ord"), "batch_name",
        (F.col("_head") + F.col("_j")).cast("bigint").alias("item_ord"),
        planned.alias("planned_path"),
    )


def plan_assignments(plans: DataFrame, files: DataFrame) -> DataFrame:
    """Files that plan lines resolve to; a file can be taken by two batches."""
    return match_plan_paths(parse_plan(plans), files)


LAST_RANK = 2


def plan_batches(
    plans: DataFrame, files: DataFrame, budget=DEFAULT_BUDGET, bucket: int = BUCKET
) -> DataFrame:
    """Planned batches, then leftovers, split at the budget; directory batches where the plan
    of a repository resolves to nothing."""
    meta = files.select("repo_id", "file_ord", "path", "chars")
    # resolved plan lines feed three joins; they are written once instead of resolved three times
    taken = durable(plan_assignments(plans, meta).select(
        "repo_id", "batch_ord", "batch_name", "item_ord", "path"
    ))
    columns = ("repo_id", "batch_rank", "batch_key", "batch_name", "item_ord", "file_ord", "path", "chars")
    planned = taken.join(meta, ["repo_id", "path"]).select(
        "repo_id", F.lit(1).alias("batch_rank"),
        F.lpad(F.col("batch_ord").cast("string"), 12, "0").alias("batch_key"), "batch_name",
        "item_ord", "file_ord", "path", "chars",
    )
    # leftovers of planned repositories and all files of the others
    has_plan = taken.select("repo_id").distinct().withColumn("_planned", F.lit(True))
    rest = remaining_files(meta, taken).withColumnRenamed("batch_name", "_left").join(
        has_plan, "repo_id", "left"
    )
    on_plan = F.col("_planned").isNotNull()
    rest = (
        directory_groups(rest)
        .withColumn("batch_rank", F.when(on_plan, LAST_RANK).otherwise(F.col("batch_rank")))
        .withColumn("batch_key", F.when(on_plan, "").otherwise(F.col("batch_key")))
        .withColumn("batch_name", F.when(on_plan, F.col("_left")).otherwise(F.col("batch_name")))
        .withColumn("item_ord", F.col("file_ord"))
    )
    return pack_by_budget(
        planned.unionByName(rest.select(*columns)),
        ["repo_id", "batch_rank", "batch_key", "batch_name"], budget, "item_ord", bucket=bucket,
    ).select(*BATCH_COLUMNS).withColumn("batch_name", part_name(F.col("batch_name")))


def number_batches(batches: DataFrame) -> DataFrame:
    """Dense 0-based number of every batch of a repository."""
    distinct = batches.select("repo_id", "batch_rank", "batch_key", "part", "batch_name").distinct()
    return positions_by_range(
        distinct, ["repo_id"], ["batch_rank", "batch_key", "part", "batch_name"]
    ).withColumn("batch_number", F.col("position") - 1).drop("position")


# ---------------------------------------------------------------- sizes and routing

def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("repo_id", "batch_rank", "batch_key", "batch_name", "part").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")
    )


def route_repos(
    files: DataFrame, repos: DataFrame | None = None, max_files: int = rules.SINGLE_CALL_FILES,
    share: float = rules.SINGLE_CALL_SHARE,
) -> DataFrame:
    """Single call or several batches per repository, by file count and characters.

    ``repos`` (repo_id, model) overrides the default model of a repository.
    """
    sizes = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")
    )
    if repos is None:
        sized = model_budget(sizes.withColumn("model", F.lit(None).cast("string"))).drop("model")
    else:
        sized = model_budget(sizes.join(repos, "repo_id", "left")).drop("model")
    single = (F.col("files") <= max_files) & (
        F.col("chars") < F.floor(F.col("budget") * F.lit(share))
    )
    return sized.withColumn("mode", F.when(single, "single").otherwise("batched"))


# ---------------------------------------------------------------- documents per batch

def file_manifest(files: DataFrame) -> DataFrame:
    """Numbered list of a repository's paths, one row per path.

    It has no size bound, so it stays a table beside the documents instead of being repeated
    inside each of them.
    """
    return positions_by_number(files.select("repo_id", "file_ord", "path"), ["repo_id"], "file_ord")


def batch_documents(
    batches: DataFrame, files: DataFrame, findings: DataFrame | None = None,
    memory: DataFrame | None = None, endpoints=None, preserve=None, modernize=None, digests: bool = False,
) -> DataFrame:
    """One text per batch part: fenced file bodies under the finding lists.

    The lists are whole unless a number caps them; a repository without findings has lists of
    ``[None]``, a null body is empty.  ``memory`` (repo_id, memory_text) goes only into the first
    batch of a repository.  The budget of the batch bounds the bodies collected per row.

    The lists of a repository grow with it and stand in each of its documents, so all texts together grow with the square
    of a repository.  ``digests`` gives the MD5 of each text (``digest``) instead of the text; the lists then go to
    a repository's documents once per ``CELL`` bytes of bodies, and are hashed once there.
    """
    keys = ["repo_id", "batch_rank", "batch_key", "batch_name", "part"]
    body = F.concat(
        F.lit("FILE: "), F.col("path"), F.lit("\n```"), language(F.col("path")), F.lit("\n"),
        F.coalesce("content", F.lit("")), F.lit("\n```\n"),
    )
    docs = (
        batches.join(files.select("repo_id", "path", "content"), ["repo_id", "path"])
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("item_ord", body.alias("body")))),
                    lambda x: x["body"],
                ), "\n",
            ).alias("bodies"),
        )
    )
    head = F.lit("")
    if findings is not None:
        lists = analysis_payload(
            findings, endpoints=endpoints, preserve=preserve, modernize=modernize, repos=batches
        )

        def bullets(title, column):
            return F.concat(
                F.lit(title), F.lit(":\n"),
                F.when(F.size(F.coalesce(F.col(column), F.array())) == 0, F.lit("  [None]"))
                .otherwise(F.array_join(F.transform(column, lambda v: F.concat(F.lit("  - "), v)), "\n")),
                F.lit("\n\n"),
            )
        heads = lists.select(
            "repo_id",
            F.concat(
                bullets("ENDPOINTS", "api_endpoints"), bullets("PRESERVE", "must_preserve"),
                bullets("MODERNIZE", "can_modernize"),
            ).alias("_lists"),
        )
        if not digests:
            docs = docs.join(heads, "repo_id", "left")
            head = F.coalesce("_lists", F.lit(""))
    if memory is not None:
        first = batches.groupBy("repo_id").agg(
            F.min(F.struct("batch_rank", "batch_key", "part", "batch_name")).alias("_first")
        )
        docs = docs.join(memory.join(first, "repo_id"), "repo_id", "left")
        is_first = F.struct("batch_rank", "batch_key", "part", "batch_name") == F.col("_first")
        head = F.concat(head, F.coalesce(F.when(is_first, F.col("memory_text")), F.lit("")))
    text = F.concat(head, F.col("bodies"))
    if digests:
        rest = docs.select(*keys, "files", text.alias("rest"))
        if findings is None:
            return rest.select(
                *keys, "files", F.md5(F.col("rest").cast("binary")).alias("digest"),
                F.length("rest").cast("bigint").alias("chars"))
        sizes = files.groupBy("repo_id").agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("_bytes"))
        return _digested(rest, heads, sizes)
    return docs.select(
        *keys, "files", text.alias("text"), F.length(text).cast("bigint").alias("chars")
    )


def _digested(docs: DataFrame, heads: DataFrame, sizes: DataFrame) -> DataFrame:
    """``docs`` with the MD5 and the length of head and ``rest`` in place of ``rest``; the head of a repository is hashed
    once per cell and each document goes on from there. ``sizes`` (repo_id, _bytes) says how many cells there are."""
    sizes = sizes.select("repo_id", F.expr(f"_bytes div {CELL} + 1").alias("_cells"))
    keys = ["batch_rank", "batch_key", "batch_name", "part"]
    spread = docs.join(sizes, "repo_id").withColumn("_cell", F.pmod(F.xxhash64(*keys), F.col("_cells")))
    copies = sizes.join(heads, "repo_id", "left").select(
        F.col("repo_id").alias("_repo"), F.coalesce("_lists", F.lit("")).alias("_lists"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cells") - 1)).alias("_cell"))
    out = StructType([*docs.drop("rest").schema.fields, *StructType.fromDDL("digest string, chars bigint").fields])

    def finish(head: pa.Table, rows: pa.Table) -> pa.Table:
        text = head.column("_lists")[0].as_py()
        begun, ahead = hashlib.md5(text.encode()), len(text)
        digests, chars = [], []
        for value in rows.column("rest"):
            rest, state = value.as_py(), begun.copy()
            state.update(rest.encode())
            digests.append(state.hexdigest())
            chars.append(ahead + len(rest))
        kept = rows.select([f.name for f in out.fields[:-2]])
        return kept.append_column("digest", pa.array(digests, pa.string())).append_column("chars", pa.array(chars, pa.int64()))

    return copies.groupBy("_repo", "_cell").cogroup(
        spread.drop("_cells").groupBy("repo_id", "_cell")).applyInArrow(finish, out)


def signature_summary(artifacts: DataFrame, path: str = "filename", by=("repo_id", "run_id")) -> DataFrame:
    """Up to 30 definition and import lines per file, each cut to 120 characters.

    A line that passes both tests is listed twice.  All in place: no explode, no shuffle.
    """
    lines = F.transform(F.split("content", "\n"), strip)

    def starts(line, prefixes):
        out = F.lit(False)
        for p in prefixes:
            out = out | line.startswith(p)
        return out

    none = F.array().cast("array<string>")
    listed = F.flatten(F.transform(lines, lambda x: F.concat(
        F.when(starts(x, rules.SIGNATURE_PREFIXES), F.array(F.substring(x, 1, rules.SIGNATURE_CHARS)))
        .otherwise(none),
        F.when(starts(x, rules.IMPORT_PREFIXES), F.array(F.substring(x, 1, rules.SIGNATURE_CHARS)))
        .otherwise(none),
    )))
    return artifacts.select(
        *by, F.col(path).alias("path"),
        F.slice(listed, 1, rules.SIGNATURES_PER_FILE).alias("_lines"),
    ).select(
        *by, "path",
        F.when(F.size("_lines") == 0, F.lit(rules.NO_SIGNATURE))
        .otherwise(F.array_join("_lines", "\n")).alias("summary"),
    )


__all__ = [
    "pack_by_budget", "directory_groups", "directory_batches", "top_level_groups", "parse_plan",
    "plan_assignments", "plan_batches", "number_batches", "batch_sizes", "route_repos",
    "file_manifest", "batch_documents", "signature_summary",
]
