"""Fingerprints: texts and order by plain Python, collision rates against the exact similarity."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from codecensus.llm import fingerprints
from tests.llm.test_filters import split_words


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, text, _), (_, after, _) in zip(order, [*order[1:], order[0]]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        out[i] = (text, text[:len(text) - cut] + after[:cut], after)
    return out


def similarity(a, b):
    a, b = Counter(split_words(a)), Counter(split_words(b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_given_texts(small, frame):
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    rows += [(10_000, None, None), (10_001, "", "a"), (None, "ab\U0001f600cdé one two", "a"), (10_002, " \n ", "a"), (10_003, rows[0][1], "z")]
    docs = frame(rows)
    want = edited(rows)
    got = fingerprints.fingerprinted(docs).select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.written("first").alias("p"),
        fingerprints.likeness("first", "second").alias("e"), fingerprints.likeness("first", "next").alias("n")).collect()
    assert len(got) == len(rows)
    off_edited, off_next = [], []
    for r in got:
        text, other, after = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        off_edited.append(r.e - similarity(text, other))
        off_next.append(r.n - similarity(text, after))
    for off in (off_edited, off_next):  # 32 samples: a standard deviation of at most 0.09 each
        assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.42
    prints = {r.doc_id: r.p for r in got}
    assert prints[10_003] == prints[rows[0][0]] and len(prints[10_001]) == 8 * 32


def test_collision_rate_of_weights(spark):
    pairs = [("a a a b b c", "a b b b d"), ("x x x x x x x x y", "x y"), ("p q r", "p q r"), ("m n", "o")]
    texts = spark.createDataFrame([(str(i), "", a, b) for i, (a, b) in enumerate(pairs)], "_key string, both string, only_first string, only_second string")
    got = fingerprints.sampled(texts, samples=4000).select("_key", fingerprints.likeness("first", "second").alias("p")).collect()
    for r in got:
        assert abs(r.p - similarity(*pairs[int(r["_key"])])) < 0.04


def test_nothing_and_repeats(spark, frame, edge):
    assert fingerprints.fingerprinted(spark.createDataFrame([], edge.schema)).count() == 0
    one = fingerprints.fingerprinted(frame([(1, "a b c d", "s"), (1, "a b c d", "s")])).collect()
    assert len(one) == 1 and one[0]["first"] == one[0]["next"]
    assert fingerprints.fingerprinted(edge).select(F.countDistinct("_key")).first()[0] == 11


def test_error_of_the_query(spark, small):
    got = {r.doc_id: r for r in fingerprints.op9(spark, "/root/testdata/sf0.001").collect()}
    want = edited([(r.doc_id, r.text, r.source) for r in small.collect()])
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 128 for r in got.values())
    off = [near - similarity(want[i][0], other) for i, r in got.items() for near, other in (
        (r.near_edited, want[i][1]), (r.near_next, want[i][2]))]
    deviation = (sum(x * x for x in off) / len(off)) ** 0.5
    print(f"{len(off)} pairs: deviation {deviation:.4f}, largest {max(map(abs, off)):.4f}")
    assert deviation < 0.045 and max(map(abs, off)) < 0.21


def test_samples_need_no_logarithms(spark, capsys):
    """What runs for every word and sample is one hash, drawn once for both texts."""
    texts = spark.createDataFrame([("k", "a a b", "c", "a d")], "_key string, both string, only_first string, only_second string")
    fingerprints.sampled(texts).explain()
    plan = capsys.readouterr().out.lower()
    assert "xxhash64" in plan and "ln(" not in plan
    same, none = "r s t " * 9, ""
    rows = [("x", same, none, none), ("y", none, same, same), ("z", none, none, none)]
    got = {r["_key"]: r for r in fingerprints.sampled(spark.createDataFrame(rows, texts.schema)).collect()}
    assert set(got) == {"x", "y"} and got["x"]["first"] == got["x"]["second"] == got["y"]["first"] == got["y"]["second"]
