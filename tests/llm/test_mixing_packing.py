"""Mixing against its contract and exact water-filling; packing against whole-text encoding."""

from __future__ import annotations

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from codecensus.llm import mixing, packing
from tests.llm.test_filters import split_words


def exact_targets(sizes, cap=3):
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), Fraction(sum(sizes.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in free}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["small", "edge"])
def test_mixing(which, request, spark, tmp_path_factory):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(split_words(r.text))
    want = exact_targets(sizes)
    targets, takes = mixing.curriculum(docs, bucket_rows=16)
    got = {r.source: r for r in targets.collect()}
    assert set(got) == set(want)
    takes = takes.collect()
    taken = defaultdict(int)
    for r in takes:
        taken[r.source] += r.taken
        assert 0 < r.taken <= r.size and 0 <= r.position <= 1
    for source, target in want.items():
        assert got[source].target == pytest.approx(float(target)) and got[source].source_size == sizes[source]
        assert abs(taken[source] - target) <= 1
    # range-sorted: positions never fall from part to part
    positions = [r.position for r in takes]
    assert positions == sorted(positions)


def test_position_inverts_the_demand(spark):
    from pyspark.sql import functions as F

    grid = [(k / 10 - 1, q / 50) for k in range(21) for q in range(51)]
    df = spark.createDataFrame(grid, "tilt double, share double")
    for tilt, share, at in df.withColumn("at", mixing._position(F.col("share"), F.col("tilt"))).collect():
        assert 0 <= at <= 1 + 1e-9 and (1 - tilt) * at + tilt * at * at == pytest.approx(share, abs=1e-7)


def test_mixed_rows(edge, small, spark):
    got = mixing.mixed_rows(edge)
    assert got.columns == edge.columns and all(r["_key"] == "x" for r in got.collect())
    words = sum(len(split_words(r.text)) for r in mixing.mixed_rows(small).collect())
    assert words == pytest.approx(sum(len(split_words(r.text)) for r in small.collect()), rel=0.1)
    empty = spark.createDataFrame([], small.schema)
    assert mixing.mixed_rows(empty).count() == 0


@pytest.mark.parametrize("which", ["small", "edge"])
def test_packing(which, request):
    docs = request.getfixturevalue(which).coalesce(2)
    encoder = packing._encoder(packing.default_vocabulary())
    ids = defaultdict(list)
    texts = docs.select("doc_id", "text").collect()
    for r in texts:
        whole = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 1]
        ids[r.doc_id].append(whole)
    got = packing.pack_documents(docs, keep_ids=True, group_rows=300).collect()
    expected = sorted(
        (repr(d), n, a, zlib.crc32(np.array(w[a:a + 4096], "<u4").tobytes()), len(w[a:a + 4096]))
        for d, many in ids.items() for w in many for n, a in enumerate(range(0, len(w), 4096)))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.ids_crc32, r.length) for r in got) == expected
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in got) // 4096)
    groups = -(-len(got) // 300)
    assert len(sequences) <= 1.03 * least + 2 * groups


def test_special_strings_and_odd_spaces(frame):
    rows = [(1, "a<|endoftext|>b A<|ENDOFTEXT|> x y it's IT'S İstanbul ΑΣ Σ́ é", "s"),
            (2, "it's THE é\ń ﬁ \x1c\x85 z", "s")]
    encoder = packing._encoder(packing.default_vocabulary())
    got = {r.doc_id: r.ids for r in packing.pieces(frame(rows), packing.default_vocabulary(), keep_ids=True).collect()}
    for doc_id, text, _ in rows:
        want = [*encoder.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(got[doc_id], "<u4").tolist() == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 80, 700))[::-1]
    number, offset = packing.best_fit(lengths, 100, 4, 3500 * 2, rule=rule)
    for s in np.unique(number):
        part = lengths[number == s]
        assert part.sum() <= 100 and len(part) <= 4 and (part.astype(int) ** 2).sum() <= 7000
        assert np.array_equal(np.sort(offset[number == s]), np.cumsum([0, *part])[:-1])
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 4, 10**6)


def test_packing_nothing(spark, small):
    assert packing.pack_documents(spark.createDataFrame([], small.schema)).count() == 0


def test_plain_words_do_not_pass_the_encoder():
    """Words of Latin letters, digits and signs get the encoder's ids without its regular expressions."""
    words = packing.WordIds(packing.default_vocabulary())
    plain = ["bomente.", "selluedo&&&", "it's", "'llama", "größe", "ÀÉ'Re", "x2²y", "¿qué?", "a-b_c", "12,5%", "µ", "l'été", "don't'"]
    assert words.cut_here
    for word in plain:
        assert words.plain(word.encode()) == np.array(words.encoder.encode(word).ids, "<u4").tobytes(), word
    for word in ("e\u0301", "a\xa0b", "x<|endoftext|>", "\u0130", "a\x01"):
        assert words.plain(word.encode()) is None
    words.encode = lambda rest: [][0] if rest else None
    words.learn({w.lower().encode() for w in plain})
    assert len(words.known) == len(plain)


def test_op7_remembers_more_words():
    few, many = (packing.WordIds(packing.default_vocabulary(), n) for n in (None, packing.MANY))
    new = [f"{n}x".encode() for n in range(520_000)]
    learnt = []
    for words in (few, many):
        made = []
        words.plain = lambda w, made=made: made.append(w) or b"ids"
        for _ in range(2):
            for at in range(0, len(new), 50_000):
                words.learn(set(new[at:at + 50_000]))
        learnt.append(len(made))
        del words.plain
    assert learnt == [2 * len(new), len(new)]
    text = pa.array(["Abc. abc abc, x.y Caf\xe9! caf\xe9 can't CAN'T"] * 2)
    want = np.array(few.encoder.encode(text[0].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
    assert list(few.batch(text)) == list(many.batch(text)) == [want] * 2
