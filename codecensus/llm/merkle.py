"""Merkle manifest of a table: one root that names every row, and a proof per row.

Rows are leaves, grouped and put in order; ``arity`` consecutive nodes make a parent until one node, the group's subroot,
remains. The subroots in order of their groups make a tree of their own whose top is the root.

Every level is a self-join by sibling shift: a node meets the node at its computed sibling index (``index XOR 1`` in a binary
tree; otherwise one join per slot offset, modulo ``arity``), after which a row knows its whole run, and the rows in slot zero
emit the parents. A level has 1/``arity`` of the rows of the one below, so all of them together cost about twice the
leaves; the keys (group, index) are unique, so a group that holds most rows is spread like any other. Levels are written
to the shared folder. From the first level of at most ``FEW`` nodes on, all groups together, no more joins are made, since jobs, and
what the driver keeps of each, would go on growing with levels of a few rows: a group's remaining nodes become one row, in which
the same sibling index finds the sibling in an array. Proofs are made from the top down: a node's path is its siblings and then
its parent's path. A path is the raw siblings from bottom to top; index and size of a level tell on which side they stand.

Digests are SHA-256, inputs concatenated, digests as lowercase hex text. A field is ``-`` if null, else its number of
UTF-8 bytes, ``:`` and the value.

Defined cases: null fields -- ``-``; a null group is a group, before all others; equal order values (and null ones, first) are
ordered by their leaf; a group of one row has its leaf as subroot; one group has its subroot as root; repeated rows are
leaves each; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.functions.scale import positions_by_range
from codecensus.llm.common import documents
from codecensus.llm.common import table as table_of

#: from a level with no more nodes than this on, all groups together, the rest of a group's tree is one row
FEW = 8192
#: level of the tops of these trees
WITHIN = -1
#: no more groups than this (some 150 bytes each) are broadcast
FEW_GROUPS = 100_000
#: levels whose paths are made in one job
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def nothing() -> Column:
    return F.lit("").cast("binary")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Raw SHA-256 of the concatenated parts."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(columns, changed: dict[str, Column] | None = None) -> Column:
    return digest(*[field((changed or {}).get(c, F.col(f"`{c}`"))) for c in columns])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index`` (from 0) and ``size`` of their group."""
    numbered = positions_by_range(rows, [group], order).withColumn("index", F.col("position") - 1).drop("position")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(sizes, group)


def slot(arity: int) -> Column:
    return F.col("index") % arity


def sibling_index(arity: int, offset: int) -> Column:
    """Index of the node ``offset`` slots further in the run, around its end."""
    if arity == 2:
        return F.col("index").bitwiseXOR(F.lit(1))
    return F.col("index") - slot(arity) + (slot(arity) + offset) % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``sibling_1`` .. : the node that many slots further, null where the run has none."""
    out = nodes
    for offset in range(1, arity):
        other = nodes.select("group", F.col("index").alias("_at"), F.col("node").alias(f"sibling_{offset}"))
        keyed = out.withColumn("_at", sibling_index(arity, offset))
        # no hash tables of whole levels on the driver
        out = keyed.join(other.hint("merge"), ["group", "_at"], "left").drop("_at")
    return out


def siblings(arity: int) -> Column:
    """Raw siblings of a row from left to right."""
    # slot s stands (s - own) further
    return F.concat(*[
        F.coalesce(*[F.when((slot(arity) + offset) % arity == place, F.col(f"sibling_{offset}"))
                     for offset in range(1, arity)], nothing())
        for place in range(arity)])


def level_sizes(leaves: DataFrame, arity: int) -> list[int]:
    """Nodes per level of the groups that still have more than one, from the leaves up."""
    groups = leaves.where("index = 0").select("size")
    largest, out = groups.agg(F.max("size")).first()[0] or 0, []
    steps = 0
    while arity**steps < largest:
        steps += 1
    wide = [F.ceil(F.col("size") / F.lit(float(arity**k))) for k in range(steps)]
    if wide:
        out = list(groups.agg(*[F.sum(F.when(w > 1, w)) for w in wide]).first())
    return out


def trees(nodes: DataFrame, arity: int) -> DataFrame:
    """(group, levels): the nodes of each group's tree, level by level from ``nodes`` up to the top."""
    rows = nodes.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("index", "node"))).alias("_nodes"))

    def add(made: Column, _: Column) -> Column:
        below = F.element_at(made, -1)
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / arity).cast("int") - 1)
        return F.concat(made, F.array(F.transform(runs, lambda run: digest(as_hex(F.concat(*[
            F.coalesce(F.get(below, run * arity + place), nothing()) for place in range(arity)]))))))

    steps = F.sequence(F.lit(1), depth(F.size("_nodes"), arity))
    return rows.select("group", F.aggregate(steps, F.array(F.col("_nodes.node")), add).alias("levels"))


def paths_within(grown: DataFrame, arity: int) -> DataFrame:
    """(group, index, path) of the lowest nodes of :func:`trees`, ``path`` up to the group's top."""
    made = F.col("levels")

    def add(state: Column, level: Column) -> Column:
        own = state["at"] % arity
        run = [F.coalesce(F.get(F.get(made, level), state["at"] - own + place), nothing()) for place in range(arity)]
        others = F.concat(*[F.when(own == place, nothing()).otherwise(node) for place, node in enumerate(run)])
        return F.struct(F.concat(state["path"], others).alias("path"), F.floor(state["at"] / arity).cast("int").alias("at"))

    below = F.sequence(F.lit(0), F.size(made) - 2)
    found = F.transform(
        F.sequence(F.lit(0), F.size(made[0]) - 1),
        lambda i: F.aggregate(below, F.struct(nothing().alias("path"), i.alias("at")), add)["path"])
    return grown.select("group", F.posexplode(found).alias("index", "path")).withColumn("index", F.col("index").cast("long"))


def levels(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """The levels of all groups' trees from the leaves up as long as they have more than ``FEW`` nodes, (group, index, size, node,
    path) with ``path`` the raw siblings; the trees above them (None: there are none); and the tops (group, level, node).
    ``leaves`` has group, index, size, node; other columns stay on the lowest level. Groups leave when one node remains."""
    made, within, tops, nodes = [], None, [], leaves
    sizes = level_sizes(leaves, arity)
    large = sum(rows > FEW for rows in sizes)
    for _ in range(large):
        tops.append(nodes.where("size = 1").select("group", F.lit(len(made)).alias("level"), "node"))
        met = with_siblings(nodes.where("size > 1"), arity)
        level = table_of(met.withColumn("path", siblings(arity)).drop(*[f"sibling_{k}" for k in range(1, arity)]))
        made.append(level)
        # the row in slot zero has the rest of its run behind it
        nodes = level.where(slot(arity) == 0).select(
            "group", F.expr(f"index div {arity}").alias("index"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
            digest(as_hex(F.col("node")), as_hex(F.col("path"))).alias("node"))
    tops.append(nodes.where("size = 1").select("group", F.lit(len(made)).alias("level"), "node"))
    if large < len(sizes):
        within = table_of(trees(nodes.where("size > 1"), arity))
        tops.append(within.select("group", F.lit(WITHIN).alias("level"), F.element_at("levels", -1)[0].alias("node")))
    return made, within, reduce(DataFrame.unionByName, tops)


def paths(leaves: DataFrame, made: list[DataFrame], within: DataFrame | None, tops: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """``leaves`` with the whole path to the root. ``above``: (group, path) of the tops; the others as by :func:`levels`."""
    ends = table_of(tops.join(above, "group").select("group", "level", F.col("path").alias("above")))

    def ending(level: int) -> DataFrame:
        return ends.where(F.col("level") == level).select("group", F.lit(0).cast("long").alias("index"), F.col("above").alias("path"))

    upper = ending(len(made))
    if within is not None:
        inner = paths_within(within, arity).join(ends.where(F.col("level") == WITHIN).drop("level").hint("merge"), "group")
        upper = upper.unionByName(inner.select("group", "index", F.concat("path", "above").alias("path")))
    if not made:
        return leaves.join(upper.hint("merge"), ["group", "index"])
    for level in range(len(made) - 1, -1, -1):
        parents = upper.select("group", F.col("index").alias("_up"), F.col("path").alias("above"))
        keyed = made[level].withColumn("_up", F.expr(f"index div {arity}"))
        inner = keyed.join(parents.hint("merge"), ["group", "_up"]).withColumn("path", F.concat("path", "above")).drop("_up", "above")
        upper = ending(level).unionByName(inner.select("group", "index", "path"))
        if level and level % STEP == 0:
            # a plan over all levels would grow with the logarithm of the rows
            upper = table_of(upper)
    alone = leaves.where("size = 1").join(ending(0), ["group", "index"])
    return inner.unionByName(alone.select(inner.columns))


def depth(size: Column, arity: int) -> Column:
    """Levels above a row of a tree with ``size`` leaves."""
    steps = F.sequence(F.lit(1), F.lit(64))
    return F.size(F.filter(steps, lambda k: F.pow(F.lit(float(arity)), k - 1) < size))


def folded(node: Column, path: Column, places: list[tuple[Column, Column]], arity: int) -> Column:
    """The root that a leaf (hex) and its path lead to through trees of the given (index, size), lowest first."""
    state = F.struct(node.alias("node"), F.lit(1).alias("at"))
    for index, size in places:
        start = F.struct(state["node"].alias("node"), state["at"].alias("at"), index.alias("index"), size.alias("size"))

        def step(acc: Column, _: Column) -> Column:
            own = acc["index"] % arity
            run = F.least(F.lit(arity), acc["size"] - acc["index"] + own)
            before = F.substring(path, acc["at"], (32 * own).cast("int"))
            after = F.substring(path, acc["at"] + (32 * own).cast("int"), (32 * (run - own - 1)).cast("int"))
            return F.struct(
                F.sha2(F.concat(as_hex(before), acc["node"], as_hex(after)), 256).alias("node"),
                (acc["at"] + (32 * (run - 1)).cast("int")).alias("at"),
                F.floor(acc["index"] / arity).alias("index"), F.ceil(acc["size"] / arity).alias("size"))

        state = F.aggregate(F.sequence(F.lit(1), depth(size, arity)), start, step)
        state = F.when(size > 1, state).otherwise(start)
    return state["node"]


def manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", columns=FIELDS, arity: int = 2,
    changed: dict[str, Column] | None = None, carry=("doc_id",),
) -> DataFrame:
    """``carry``, leaf, subroot, root, index, size, path (raw siblings up to the root), and the root folded from the leaf of the
    row as ``changed`` has it (None: as it is), all digests as hex."""
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    differs = reduce(Column.__or__, [~F.col(f"`{c}`").eqNullSafe(v) for c, v in (changed or {}).items()], F.lit(False))
    rows = docs.select(
        named.alias("group"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{order}`").alias("order"),
        leaf(columns).alias("node"), F.when(differs, leaf(columns, changed)).alias("other"))
    leaves = table_of(placed(rows, "group", ["order", "node"]).drop("order"))
    made, within, tops = levels(leaves, arity)
    # the subroots are the leaves of one more tree
    tops = table_of(tops.withColumn("all", F.lit("")))
    upper = table_of(
        placed(tops.select("all", F.col("group").alias("name"), "node"), "all", ["name"])
        .select(F.col("all").alias("group"), "index", "size", "node", "name"))
    *above, root = levels(upper, arity)
    ends = paths(upper, *above, root, root.select("group", nothing().alias("path")), arity)
    ends = table_of(ends.join(root.select("group", F.col("node").alias("root")), "group").select(
        F.col("name").alias("group"), F.col("index").alias("top_index"), F.col("size").alias("top_size"),
        F.col("node").alias("subroot"), "root", "path"))

    found = paths(leaves, made, within, tops, ends.select("group", "path"), arity)
    tree = ends.drop("path")
    found = found.join(F.broadcast(tree) if tops.count() <= FEW_GROUPS else tree, "group")
    places = [(F.col("index"), F.col("size")), (F.col("top_index"), F.col("top_size"))]
    return found.select(
        *[F.col("row")[c].alias(c) for c in carry], as_hex(F.col("node")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.col("root")).alias("root"), "index", "size", "path",
        folded(as_hex(F.coalesce("other", "node")), F.col("path"), places, arity).alias("folded_root"))


def op13(spark, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = manifest(documents(spark, sf_dir), changed=tampered)
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


#: the same rows in DuckDB's SQL: a list of nodes per level, and a walk from every leaf to the root
OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, xor(list_reduce(
           list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
           lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT),
         4294967295::BIGINT) % 7 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
         sha256(concat(fields, rest(n_chars), rest(text))) AS leaf,
         sha256(concat(fields, rest(CASE WHEN hit THEN n_chars + 1 ELSE n_chars END), rest(text))) AS other
  FROM (SELECT *, concat(rest(doc_id), rest(source), rest(lang)) AS fields FROM docs)
), trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(concat(nodes[i], coalesce(nodes[i + 1], ''))))
  FROM trees WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM trees WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY idx) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(concat(nodes[i], coalesce(nodes[i + 1], ''))))
  FROM tops WHERE len(nodes) > 1
), inside AS (
  SELECT doc_id, lang, leaf, 0 AS level, idx, other AS cur, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, w.lang, leaf, w.level + 1, idx // 2,
         sha256(CASE WHEN idx % 2 = 0 THEN concat(cur, coalesce(nodes[xor(idx, 1) + 1], '')) ELSE concat(nodes[idx], cur) END),
         concat(proof, coalesce(nodes[xor(idx, 1) + 1], ''))
  FROM inside w JOIN trees t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND len(nodes) > 1
), above AS (
  SELECT doc_id, leaf, subroot, 0 AS level, s.idx, cur, proof
  FROM inside w JOIN trees t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND len(nodes) = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  UNION ALL
  SELECT doc_id, leaf, subroot, w.level + 1, idx // 2,
         sha256(CASE WHEN idx % 2 = 0 THEN concat(cur, coalesce(nodes[xor(idx, 1) + 1], '')) ELSE concat(nodes[idx], cur) END),
         concat(proof, coalesce(nodes[xor(idx, 1) + 1], ''))
  FROM above w JOIN tops t ON t.level = w.level AND len(nodes) > 1
)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = nodes[1] AS verified
FROM above w JOIN tops t ON t.level = w.level AND len(nodes) = 1
"""
for _name in FIELDS:
    OP13_SQL = OP13_SQL.replace(f"rest({_name})", f"coalesce(strlen({_name}::VARCHAR) || ':' || {_name}, '-')")
OP13_SQL = OP13_SQL.replace(
    "rest(CASE WHEN hit THEN n_chars + 1 ELSE n_chars END)",
    "coalesce(strlen((CASE WHEN hit THEN n_chars + 1 ELSE n_chars END)::VARCHAR) || ':' || (CASE WHEN hit THEN n_chars + 1 ELSE n_chars END), '-')")
