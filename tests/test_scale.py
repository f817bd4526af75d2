"""Skewed inputs, many segments, and the shape of plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codecensus.functions.scale import positions_by_number, positions_by_range
from codecensus.operators import batching, memory, profile
from codecensus.plans import views


def one_by_one(sizes, budget):
    parts, held, part, is_open = [], 0, 1, False
    for n in sizes:
        if is_open and held + n > budget:
            part, held = part + 1, 0
        held, is_open = held + n, True
        parts.append(part)
    return parts


@pytest.mark.parametrize("bucket", [1, 3, 7, 1000])
@pytest.mark.parametrize("budget", [0, 5, 40, 10_000])
def test_packing_equals_sequential(spark, bucket, budget):
    rng = random.Random(bucket * 31 + budget)
    data, want = [], {}
    for g in range(6):
        n = [1, 2, 40, 90, 200, 13][g]
        # gaps in the order numbers, empty files, and files larger than the budget
        ords = sorted(rng.sample(range(n * 3), n))
        sizes = [rng.choice([0, 0, 1, 2, 3, 5, 8, 30, 60]) for _ in range(n)]
        for o, s, p in zip(ords, sizes, one_by_one(sizes, budget)):
            data.append((f"g{g}", o, s, f"p{o}"))
            want[(f"g{g}", o)] = p
    df = spark.createDataFrame(data, "repo_id string, file_ord bigint, chars bigint, path string")
    got = batching.pack_by_budget(df, ["repo_id"], budget, bucket=bucket).collect()
    assert {(r.repo_id, r.file_ord): r.part for r in got} == want
    last = {}
    for (g, _), p in want.items():
        last[g] = max(last.get(g, 0), p)
    assert all(r.parts == last[r.repo_id] for r in got) and len(got) == len(data)


def test_composed_steps_follow_each_other():
    """A composition does to every open bin what its parts do in turn."""
    import numpy as np
    import pandas as pd

    rng = random.Random(3)
    for _ in range(300):
        cap = rng.choice([0, 5, 17, 60])
        segments = [[rng.choice([0, 0, 1, 2, 5, 8, 30]) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 7))]
        steps = batching._segment_step(pd.Series([np.array(x) for x in segments]), pd.Series([cap] * len(segments)))
        steps = steps.to_dict("records")
        whole = batching._composed(pd.Series([steps])).to_dict("records")
        for state in [(False, 0, 1), *((True, c, 3) for c in range(cap + 40))]:
            ends = [batching._states(pd.Series([x]), *[pd.Series([v]) for v in state])[0][-1] for x in (steps, whole)]
            assert ends[0] == ends[1]


@pytest.mark.parametrize("fan", [2, 5])
def test_packing_with_composed_segments(spark, fan):
    rng = random.Random(fan)
    sizes = [rng.choice([0, 1, 2, 3, 5, 8, 30, 60]) for _ in range(300)]
    df = spark.createDataFrame([("hot", i, n, f"p{i}") for i, n in enumerate(sizes)] + [("b", 0, 3, "x")],
                               "repo_id string, file_ord bigint, chars bigint, path string")
    got = batching.pack_by_budget(df, ["repo_id"], 40, bucket=4, fan=fan).where("repo_id = 'hot'").orderBy("file_ord").collect()
    assert [r.part for r in got] == one_by_one(sizes, 40) and {r.parts for r in got} == {got[-1].part}


def test_positions(spark):
    rng = random.Random(5)
    nums = {g: sorted(rng.sample(range(5000), n)) for g, n in (("hot", 900), ("b", 3))}
    df = spark.createDataFrame([(g, i, f"k{i:05d}") for g, v in nums.items() for i in v], "g string, i bigint, s string")
    want = {(g, i): n for g, v in nums.items() for n, i in enumerate(v, 1)}
    for got in (positions_by_number(df, ["g"], "i", bucket=64), positions_by_range(df, ["g"], ["s"])):
        assert {(r.g, r.i): r.position for r in got.collect()} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_prune_before_the_shuffle(spark):
    df = memory.recent_failures(views.attempts(spark, "/root/testdata/sf0.001"))
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_no_nested_loops_and_narrow_scans(spark):
    import __spark_entry__ as entry

    for name in ("match_plan_paths", "asset_links", "missing_files", "checkpoint_pairing", "locate_content"):
        plan = plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    plan = plan_of(entry.queries()["directory_batches"](spark, "/root/testdata/sf0.001"))
    assert "text:string" not in plan


def test_findings_read_contents_once(spark):
    import __spark_entry__ as entry

    plan = plan_of(entry.queries()["repo_findings"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 1


def test_hot_repository(spark):
    """A third of all rows in one repository changes no result."""
    df = views.code(spark, "/root/testdata/sf0.001")
    hot = df.withColumn("repo_id", F.when(F.col("file_ord") % 3 == 0, "hot").otherwise(F.col("repo_id")))
    total = profile.language_mix(hot).agg(F.sum("files")).first()[0]
    assert total == df.count()
    packed = batching.directory_batches(hot.withColumn("chars", F.col("size")), 5000, bucket=16)
    assert packed.count() == total and packed.select("repo_id", "path").distinct().count() == total


def test_digests_of_documents(spark, monkeypatch):
    """The lists of a repository, which stand in each of its documents, are not joined to each of them."""
    monkeypatch.setattr(batching, "CELL", 2000)
    code = views.code(spark, "/root/testdata/sf0.001")
    batches = batching.directory_batches(code.withColumn("chars", F.col("size")), 5000)
    memory_text = code.select("repo_id").distinct().withColumn("memory_text", F.concat(F.lit("höher "), "repo_id"))
    for more in ({}, {"memory": memory_text}):
        texts = batching.batch_documents(batches, code, profile.repo_findings(code), **more)
        want = texts.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")
        got = batching.batch_documents(batches, code, profile.repo_findings(code), digests=True, **more)
        found = {tuple(r) for r in got.select(*sorted(got.columns)).collect()}
        assert found == {tuple(r) for r in want.select(*sorted(got.columns)).collect()} and len(found) > 20
