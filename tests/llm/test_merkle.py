"""Merkle manifests against a recursive version."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codecensus.llm import merkle
from tests.llm.conftest import EDGE


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if add and values[3] is not None:
        values[3] += add
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """The top, and per node its siblings as (before, after) from the bottom up."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        for i, p in enumerate(at):
            run, own = runs[p // arity], p % arity
            paths[i].append(("".join(run[:own]), "".join(run[own + 1:])))
        at = [p // arity for p in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def plain(rows, arity, hit):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found, subroots = [], []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in members], arity)
        subroots.append(top)
        found += [(r, g, p) for r, p in zip(members, paths)]
    root, above = tree(subroots, arity)
    out = []
    for row, g, path in found:
        path = path + above[order.index(g)]
        node = leaf(row, 1 if hit(row) else 0)
        for before, after in path:
            node = h(before, node, after)
        out.append((row["doc_id"], leaf(row), subroots[order.index(g)], root, h(*[b + a for b, a in path]), node))
    return out


def hit(row):
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


def manifest(docs, arity):
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, arity=arity, changed={"n_chars": F.when(own, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return [tuple(r) for r in out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("path")), 256), "folded_root").collect()]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_given_rows(small, arity):
    rows = [r.asDict() for r in small.collect()]
    got, want = manifest(small, arity), plain(rows, arity, hit)
    assert sorted(got) == sorted(want)
    assert 0 < sum(r[3] != r[5] for r in got) < len(got) / 4


@pytest.mark.parametrize("few", [0, 8192])
def test_groups_of_every_size(spark, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW", few)
    rows = [(i, None if i % 3 else f"té{i}", g, "s", None if i % 5 else i)
            for g, n in (("a", 1), ("b", 2), ("é", 3), (None, 5), ("hot", 33), ("", 1)) for i in range(n)]
    rows += [(None, "x", "hot", None, 1), (None, "y", "hot", None, 1), (7, "again", "hot", "s", 2), (7, "again", "hot", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("group", "index", "node", "size", "path", "row", "order", "leaf"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    for arity in (2, 4):
        assert sorted(manifest(docs, arity), key=repr) == sorted(plain([r.asDict() for r in docs.collect()], arity, hit), key=repr)


def test_one_group_one_row_no_row(spark, frame, edge):
    for rows in (EDGE, EDGE[:1]):
        docs = frame(rows)
        assert sorted(manifest(docs, 2), key=repr) == sorted(plain([r.asDict() for r in docs.collect()], 2, hit), key=repr)
    assert manifest(spark.createDataFrame([], edge.schema), 2) == []


@pytest.mark.parametrize("few", [4])
def test_small_levels_are_one_row(spark, monkeypatch, few):
    monkeypatch.setattr(merkle, "FEW", few)
    rows = [(i, f"t{i}", g, "s", i) for g, n in (("a", 1), ("b", 6), (None, 9), ("hot", 50)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for arity in (3,):
        assert sorted(manifest(docs, arity)) == sorted(plain([r.asDict() for r in docs.collect()], arity, hit))


def test_tables_do_not_grow_with_small_levels(spark, monkeypatch):
    """What the driver keeps grows with the tables that are written one after the other."""
    made, write = [], merkle.table_of
    monkeypatch.setattr(merkle, "table_of", lambda df: made.append(1) or write(df))
    counts = []
    for n in (40, 4000):
        docs = spark.range(n).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
        del made[:]
        merkle.manifest(docs).count()
        counts.append(len(made))
    assert counts[0] == counts[1] < 12
