"""The n-gram join against all pairs."""

from __future__ import annotations

import inspect
import random
import re
import time
import tracemalloc
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codecensus.llm import common, ngram_join
from tests.llm.test_filters import split_words


def shingles(text):
    words = split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(doc_id, n, component) by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for who in holders.values():
        for n, i in enumerate(who):
            for j in who[n + 1:]:
                both[i, j] += 1
    for (i, j), n in both.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(seed, size, words, edits, first_id):
    """A text and copies of it, each with some words of its own; later ones drift from earlier ones."""
    rng = random.Random(seed)
    base = [f"s{seed}w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for i in range(size):
        if i % 4 == 3:
            base = list(base)
            base[rng.randrange(words)] = f"drift{i}"
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"own{seed}x{i}x{rng.randrange(100)}"
        out.append((first_id + i, " ".join(text), "s"))
    return out


@pytest.mark.parametrize("options", [{"per_fragment": 700}, {"rounds": 0}])  # 0: all by the exact rest
def test_families(frame, options, seed=1):
    rows = family(seed, 60, 80, 3, 1000) + family(seed + 10, 40, 30, 2, 500) + family(seed + 20, 25, 200, 9, 100)
    rng = random.Random(seed)
    shared = " ".join(f"passage{i}" for i in range(60))
    rows += [(3000 + i, f"{shared} " + " ".join(f"u{i}v{k}" for k in range(rng.randrange(1, 40))), "s") for i in range(50)]
    rows += [(4000 + i, rows[i % 7][1].upper(), "t") for i in range(20)] + [(5000, "a b c", "s"), (5001, "A  b\nC", "s")]
    rng.shuffle(rows)
    docs = frame(rows).repartition(5)
    want = brute(rows)
    got = ngram_join.grouped(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_exact_bounds(frame):
    # 7 of 9 shingles are more than 3/4, 6 of 8 are exactly 3/4, 15 of 21 are less
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:12]), "s"), (2, " ".join(words[:11] + ["z"]), "s"), (3, " ".join(words[20:31]), "s"),
            (4, " ".join(words[20:30] + ["q"]), "s"), (5, " ".join(words[50:68]), "s"), (6, " ".join(words[50:64] + list("abc")), "s"),
            (7, " ".join(words[100:110]), "s"), (8, " ".join(words[100:112]), "s")]
    got = ngram_join.grouped(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert {r.doc_id: r.component_id for r in got}[8] == 7  # 6 of 8


def test_given_tables(small, edge, spark):
    for docs in (small, edge):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        got = ngram_join.grouped(docs).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert ngram_join.grouped(spark.createDataFrame([], small.schema)).count() == 0


def test_one_of_each(edge, frame, spark):
    got = sorted((r.doc_id, r["_key"]) for r in ngram_join.one_of_each(edge).collect() if r.doc_id is not None)
    assert got == [(i, "x") for i in (1, 2, 3, 5, 6, 7, 8, 9, 10)]
    assert ngram_join.one_of_each(spark.createDataFrame([], edge.schema)).count() == 0


def test_dense_segments_with_near_misses(spark):
    """Groups counted by matrix products, with members around the bound that no leader reaches."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(90):
            text = list(base)
            for k in rng.sample(range(60), rng.choice((0, 1, 1, 2, 2, 3, 3, 4))):
                text[k] = f"g{g}own{i}x{k}"
            rows.append((len(rows), " ".join(text), "s"))
    got = ngram_join.grouped(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), per_fragment=2000, rounds=1, leaders=2
    ).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert len({r.component_id for r in got}) > 10


def test_a_fragment_is_counted_in_little_memory():
    rng = np.random.default_rng(1)
    shingle = rng.integers(0, 2**40, 400_000, dtype=np.uint64)
    shingle = np.concatenate([shingle, shingle[:100_000], rng.integers(0, 2**40, 500_000, dtype=np.uint64)])
    names = np.arange(10_000, dtype=np.int64) * 7919 - 40_000_000
    size = np.full(10_000, 100, "<u4")
    rows = pa.table({"frag": pa.array([0], pa.int32()), "label": [names.tobytes()], "size": [size.tobytes()],
                     "lead": [(size // 50).tobytes()], "shingle": [shingle.tobytes()]})
    tracemalloc.start()
    got = dict(zip(*ngram_join.shared_here(rows).to_pydict().values()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    holders = defaultdict(set)
    for k, x in enumerate(shingle.tolist()):
        holders[x].add(k // 100)
    want = defaultdict(int)
    for k, x in enumerate(shingle.tolist()):
        if k % 100 > 1 and len(holders[x]) > 1:
            want[int(names[k // 100])] += 1
    assert got == want
    # eight bytes a posting are its shingle
    assert peak < 45 * len(shingle)


def traced(function, *tables):
    """The result, and the most bytes of arrays that were there at a time."""
    tracemalloc.start()
    out = function(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_labels_of_one_posting_are_counted_in_little_memory():
    """As in a large table: of a text, a fragment holds one shingle or two."""
    rng = np.random.default_rng(3)
    count = 400_000
    names, shingle = rng.permutation(count).astype(np.int64) - 7, rng.integers(0, 2**40, count, dtype=np.uint64)
    shingle[::5] = shingle[1::5]
    columns = {"label": names, "size": np.ones(count, "<u4"), "lead": np.zeros(count, "<u4"), "shingle": shingle}
    rows = pa.table({"frag": pa.array([0] * 400, pa.int32())} | {
        c: pa.array([x.tobytes() for x in np.split(v, 400)], pa.binary()) for c, v in columns.items()})
    # batches that begin within others, as Spark's readers may give them
    rows = pa.concat_tables([rows.slice(0, 130), rows.slice(130, 270)])
    got, peak = traced(ngram_join.shared_here, rows)
    value, at, often = np.unique(shingle, return_inverse=True, return_counts=True)
    assert sorted(got["label"].to_pylist()) == sorted(names[often[at] > 1].tolist())
    assert set(got["shared"].to_pylist()) == {1}
    # 24 bytes a posting are the rows
    assert peak < 60 * count


def segments_of(rng, classes, groups, segments):
    """A row of segments of random groups, and what is known of their classes."""
    member = [np.sort(rng.choice(classes, rng.integers(2, 9), replace=False)) for _ in range(groups)]
    label = np.sort(rng.choice(10**6, classes, replace=False)).astype(np.int64) - 10**5
    flat = np.concatenate(member)
    row = ngram_join._group_row(3, label[flat], np.array([len(m) for m in member]), rng.integers(0, segments, groups, dtype=np.uint64))
    label = np.frombuffer(row["label"][0].as_py(), np.int64)
    s = np.frombuffer(row["shared"][0].as_py(), "<u4").astype(np.int64)
    known = pa.table({"label": label, "n": s + 1, "s": s, "c": label})
    return row, known.filter(pa.array(rng.random(len(label)) < 0.9))


@pytest.mark.parametrize("small", [64, 4])  # 4: nearly all by matrix products
def test_segments_are_counted_some_at_a_time(monkeypatch, small):
    row, known = segments_of(np.random.default_rng(5), 60, 900, 40)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    whole = [ngram_join.overlaps(salt, leaders)(row, known).to_pydict() for salt, leaders in ((0, 3), (2, None))]
    assert len(whole[1]["a"]) > 100
    monkeypatch.setattr(ngram_join, "AT_ONCE", 70)
    monkeypatch.setattr(ngram_join, "DENSE", 900)
    assert [ngram_join.overlaps(salt, leaders)(row, known).to_pydict() for salt, leaders in ((0, 3), (2, None))] == whole


def test_a_common_passage_is_counted_in_little_memory():
    classes = 6000
    label = np.arange(classes, dtype=np.int64)
    row = ngram_join._group_row(0, np.tile(label, 9), np.full(9, classes), np.zeros(9, np.uint64))
    known = pa.table({"label": label, "n": np.full(classes, 30), "s": np.full(classes, 16), "c": label})
    got, peak = traced(ngram_join.overlaps(3, None), row, known)
    assert got.num_rows == 0
    assert peak < 70_000_000


def test_components_leave_no_shuffle_files(spark, frame):
    def shuffled():
        # Spark removes them shortly after a query's end
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
        return set(re.findall(r"shuffle_\d+_", files))

    text = " ".join(f"w{i}" for i in range(60))
    docs = frame([(i, f"{text} {i % 7}", "a") for i in range(40)], extra=False)
    sets = ngram_join.table_of(ngram_join.sets(docs))
    before = shuffled()
    assert ngram_join.class_components(docs, sets, 1000).count() == 7
    until = time.time() + 10
    # the count itself leaves one
    while len(left := shuffled() - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 1


def test_memory_is_given_back_when_nothing_is_held(monkeypatch):
    """Workers take turns and live on: each counts with what its last task has left."""
    class Held:
        pass

    refs, left = [], []
    monkeypatch.setattr(common, "give_back", lambda: left.append(refs[-1]()))

    def held():
        out = Held()
        refs.append(weakref.ref(out))
        return out

    @common.trimmed_map
    def of_batches(batches):
        own = held()
        for batch in batches:
            yield batch, own is None

    @common.trimmed
    def of_group(table):
        own = held()
        return table, own is None

    @common.trimmed
    def of_two(first, second):
        own = held()
        return first, second, own is None

    assert list(of_batches(iter("ab"))) == [("a", False), ("b", False)]
    assert of_group("a") == ("a", False) and of_two("a", "b") == ("a", "b", False)
    assert left == [None] * 3
    # Spark goes by the number of arguments
    assert [len(inspect.getfullargspec(f).args) for f in (of_group, of_two)] == [1, 2]
