"""Strings found by positional grams against plain containment."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from codecensus.functions import grams
from codecensus.functions.grams import occurrences


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_occurrences(spark, block):
    rng = random.Random(block)
    draw = lambda n: "".join(rng.choice("abÄ€\n ") for _ in range(n))
    texts = [("r" if i % 4 else "q", i, draw(rng.choice([0, 1, 7, 8, 9, 60, 200]))) for i in range(60)] + [("r", 60, None), ("r", 61, "a" * 40)]
    needles = [("r", draw(rng.choice([1, 2, 3, 5, 8, 9, 17]))) for _ in range(60)]
    needles += [(r, t[k:k + n]) for r, _, t in texts if t for k, n in ((0, 8), (3, 11), (5, 30), (len(t) - 4, 4))]
    needles += [("r", "a" * n) for n in (8, 16, 20, 40, 41)] + [("q", ""), ("q", None), ("none", "a")]
    df = spark.createDataFrame(texts, "repo_id string, ord int, content string").repartition(3)
    nd = spark.createDataFrame(needles, "repo_id string, needle string")
    got = occurrences(nd, df, ["repo_id"], carry=("ord",), block=block).collect()
    want = {(r, n, i) for r, n in set(needles) if n for q, i, t in texts if q == r and n in (t or "")}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 200


def test_no_text_is_shuffled(spark):
    df = spark.createDataFrame([("r", 1, "some content")], "repo_id string, ord int, content string")
    nd = spark.createDataFrame([("r", "content")], "repo_id string, needle string")
    plan = occurrences(nd, df, ["repo_id"], carry=("ord",))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange" not in line or "content" not in line


def test_nothing(spark):
    df = spark.createDataFrame([("r", 1, "some content")], "repo_id string, ord int, content string")
    nd = spark.createDataFrame([("r", "content")], "repo_id string, needle string")
    assert occurrences(nd.limit(0), df, ["repo_id"]).count() == occurrences(nd, df.limit(0), ["repo_id"]).count() == 0


def test_strings_of_other_keys_give_no_rows(spark):
    """The table of what is looked for grows with the strings and knows their keys: texts give little else than hits."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    texts = [("r", i, draw(3000)) for i in range(20)]
    lines = [texts[i % 20][2][k:k + 30] for i, k in enumerate(range(0, 2900, 5))]
    needles = [("q", n) for n in lines * 5] + [("q", draw(30)) for _ in range(20_000)] + [("r", n) for n in lines]
    df = spark.createDataFrame(texts, "repo_id string, ord int, content string")
    nd = spark.createDataFrame(needles, "repo_id string, needle string").distinct().withColumn("salt", F.xxhash64("repo_id"))
    pieces = grams.needle_pieces(nd, "salt")
    assert pieces.count() == nd.count()
    rows = grams.text_pieces(df.withColumn("salt", F.xxhash64("repo_id")), "content", "salt", *grams.wanted_slots(pieces)).count()
    assert len(lines) <= rows <= 1.5 * len(lines)
