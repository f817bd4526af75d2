"""Streaming exact deduplication against plain grouping."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codecensus.llm import exact_dedup
from codecensus.llm.common import shared_folder
from tests.llm.conftest import EDGE


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, got):
    """``got`` keeps one row per text, with the largest id."""
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[lowered(text)].append(doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r.text_sha256].append(r)
    assert set(seen) == set(by_hash)
    for digest, found in seen.items():
        ids = by_hash[digest]
        stays = max((i for i in ids if i is not None), default=None)
        assert sorted(repr(r.doc_id) for r in found) == sorted(map(repr, ids))
        assert {r.group_size for r in found} == {len(ids)} and {r.keep_id for r in found} == {stays}
        assert [r.doc_id for r in found if r.kept] == [stays]


def run(spark, frame, folder, rows, *parts, **options):
    path, state = f"{folder}/docs", f"{folder}/state"
    for part in parts or [rows]:
        frame(part).repartition(3).write.mode("append").parquet(path)
        exact_dedup.absorb(spark, path, state, options.get("digest", exact_dedup.sha), options.get("files", 2))
    return exact_dedup.resolved(spark, path, state, **{k: v for k, v in options.items() if k != "files"}).collect()


MORE = [*EDGE, (20, "FIVE", "c"), (21, "Ärger AB", "a"), (22, "Ärger ab", "a"), (23, "ärger ab", "a"), (24, "", "x"),
        (25, None, "y"), (None, "FIVE", "a"), *[(100 + i, "A hot text" if i % 2 else "a HOT text", "hot") for i in range(60)]]


@pytest.fixture
def folder(spark):
    return shared_folder(spark, "test-dedup")


def test_edges_and_hot_groups(spark, frame, folder):
    check(MORE, run(spark, frame, folder, MORE, block=7))


def test_digests_that_collide(spark, frame, folder):
    check(MORE, run(spark, frame, folder, MORE, digest=lambda t: F.length(t) % 3, block=4))


def test_state_goes_on_with_new_files(spark, frame, folder):
    first, second = MORE[::2], MORE[1::2]
    check(MORE, run(spark, frame, folder, MORE, first, second, block=5))
    state = exact_dedup.entries(spark, f"{folder}/state")
    assert state.count() == len({lowered(t) for _, t, _ in MORE})
    assert state.agg(F.sum("n")).first()[0] == len(MORE)


def test_given_rows_and_no_rows(spark, small, folder):
    path = "/root/testdata/sf0.001/documents.parquet"
    exact_dedup.absorb(spark, path, f"{folder}/state")
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    check(rows, exact_dedup.resolved(spark, path, f"{folder}/state").collect())
    small.limit(0).write.parquet(f"{folder}/none")
    exact_dedup.absorb(spark, f"{folder}/none", f"{folder}/empty")
    assert exact_dedup.resolved(spark, f"{folder}/none", f"{folder}/empty").count() == 0


def test_no_python_on_the_executors(spark, capsys):
    exact_dedup.op11(spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in capsys.readouterr().out
