"""The backoff model against a plain one, and its normalisation."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecensus.llm import scoring
from tests.llm.test_filters import split_words


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *split_words(text), "</s>"]


class Plain:
    def __init__(self, texts):
        self.pairs, self.words, self.after = Counter(), Counter(), defaultdict(set)
        for text in texts:
            t = tokens(text)
            self.words.update(t[1:])
            for v, w in zip(t, t[1:]):
                self.pairs[v, w] += 1
                self.after[v].add(w)
        self.history = Counter()
        for (v, _), n in self.pairs.items():
            self.history[v] += n
        self.total = sum(self.words.values())
        kinds = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, scoring.K + 2)]
        self.d2, self.d1 = scoring.discounts(kinds(self.pairs)), scoring.discounts(kinds(self.words))
        self.unknown = 1 - sum(self.p1(w) for w in self.words)

    def discount(self, d, r):
        return d[r - 1] if r <= scoring.K else 1.0

    def p1(self, w):
        r = self.words[w]
        return self.discount(self.d1, r) * r / (self.total + 1) if r else self.unknown

    def p2(self, v, w):
        if not self.history[v]:
            return self.p1(w)
        kept = lambda x: self.discount(self.d2, self.pairs[v, x]) * self.pairs[v, x] / (self.history[v] + 1)
        if self.pairs[v, w]:
            return kept(w)
        return (1 - sum(map(kept, self.after[v]))) / (1 - sum(map(self.p1, self.after[v]))) * self.p1(w)


@pytest.mark.parametrize("which", ["small", "edge"])
def test_scores(which, request):
    docs = request.getfixturevalue(which).repartition(3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held")).collect()
    model = Plain([r.text for r in rows if not r.held])
    types = len(model.words)
    want = []
    for r in rows:
        t = tokens(r.text)
        want.append((repr(r.doc_id), r.held, len(t) - 1, sum(1 for w in t[1:] if model.words[w]), model.total,
                     sum(math.log10((model.words[w] + 1) / (model.total + types + 1)) for w in t[1:]),
                     sum(math.log10(model.p2(v, w)) for v, w in zip(t, t[1:]))))
    got = [(repr(r[0]), *r[1:]) for r in scoring.scored(docs, held, per_bucket=3_000 if which == "small" else 4_000_000).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_every_history_sums_to_one():
    model = Plain(["a b c a b d", "a b", "c c c c c c c c", "x y z a b c", ""])
    for v in ["<s>", "a", "b", "c", "new"]:
        assert sum(model.p2(v, w) for w in [*model.words, "unseen word"]) == pytest.approx(1)


def test_nothing(spark, edge):
    assert scoring.scored(spark.createDataFrame([], edge.schema), F.lit(False)).count() == 0
    all_held = scoring.scored(edge, F.lit(True)).collect()
    assert len(all_held) == edge.count() and {r.n_known for r in all_held} == {0}


def test_discounts_stay_good_turing():
    # bigrams of the training texts of sf0.1: n4 and n5 are close, which made the ratio of the plain counts exceed 1
    n = [1579638, 246704, 51653, 21705, 18939, 7580]
    xs, ys = [math.log(r) for r in range(1, 7)], [math.log(x) for x in n]
    mx, my = sum(xs) / 6, sum(ys) / 6
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    smooth = {r: r ** slope for r in range(1, 7)}
    share = 6 * smooth[6] / smooth[1]
    want = [((r + 1) * smooth[r + 1] / (r * smooth[r]) - share) / (1 - share) for r in range(1, 6)]
    assert scoring.discounts(n) == pytest.approx(want)
    assert scoring.discounts(n) == pytest.approx([0.2353, 0.4361, 0.5569, 0.6359, 0.6912], abs=1e-4)
    # numbers that follow a power of r are their own smoothed form
    assert scoring.discounts([3600, 900, 400, 225, 144, 100]) == pytest.approx([0.4, 0.6, 0.7, 0.76, 0.8])
    # falling, flat, rising and with a gap: always a discount, less of it for larger counts
    for n in ([900, 450, 300, 225, 180, 150], [7] * 6, [3, 5, 8, 20, 40, 90], [50, 9, 0, 4, 0, 1], [5, 1, 0, 0, 0, 0]):
        d = scoring.discounts(n)
        assert (d > 0).all() and (d < 1).all() and (d[1:] > d[:-1]).all()
    # only without types seen once or twice is there no estimate
    for n in ([0, 4, 1, 1, 1, 1], [4, 0, 1, 1, 1, 1], [0] * 6):
        assert scoring.discounts(n) == pytest.approx([0.5, 0.75, 5 / 6, 0.875, 0.9])


def test_a_bucket_is_settled_in_slices(spark, small, monkeypatch):
    """Slices of histories tell the same as the whole bucket, with less memory beside the sorted bigrams."""
    import tracemalloc


    docs = small.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 7 == 2).alias("held"))
    hot = np.sort(np.array([scoring.START, scoring.END]))
    group = scoring._bigrams(docs.coalesce(1), hot, 1).toArrow()
    found, peak = {}, {}
    for size in (10**9, 2_000):
        monkeypatch.setattr(scoring, "SETTLED_AT_ONCE", size)
        tracemalloc.start()
        rows = scoring._settle(1, hot, np.array([180, 180]))(group).to_pylist()
        peak[size] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        stats = sum(scoring._read(r["a"], np.int64) for r in rows if r["kind"] == scoring.STATS)
        sums = [np.concatenate([scoring._read(r[k], np.float64) for r in rows if r["kind"] == scoring.SUMS]) for k in "bc"]
        names = np.concatenate([scoring._read(r["a"], np.uint64) for r in rows if r["kind"] == scoring.WORDS])
        found[size] = stats.tolist(), np.round(np.concatenate(sums), 6).tolist(), sorted(names.tolist())
    whole, sliced = found.values()
    assert whole[0] == sliced[0] and whole[2] == sliced[2] and whole[1] == pytest.approx(sliced[1])
    assert peak[2_000] < 0.8 * peak[10**9]
