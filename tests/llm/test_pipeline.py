"""The pipeline stage by stage against plain Python versions of its decisions."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from codecensus.llm import packing
from tests.llm.test_filters import metrics, split_words, without_repeats
from tests.llm.test_mixing_packing import exact_targets
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert len(by_name) == 5

    def step(name, docs):
        out = by_name[name](spark, docs, SMALL).cache()
        assert name == "packing" or out.columns == columns
        return out, [(r.doc_id, r.text, r.source) for r in out.collect()] if name != "packing" else out.collect()

    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept, rows = step("quality_rules", docs)
    assert {i for i, _, _ in rows} == {i for i, t, _ in given if not metrics(t)[-1]}  # no line is that frequent here
    assert dict((i, t) for i, t, _ in rows).items() <= dict((i, t) for i, t, _ in given).items()

    want = without_repeats(rows)
    lines, after = step("line_dedup", kept)
    texts = {i: want[True, i, t][0] for i, t, _ in rows if not want[True, i, t][1] or split_words(want[True, i, t][0])}
    assert {i: t for i, t, _ in after} == texts

    single, rows = step("ngram_jaccard", lines)
    assert {i for i, _, _ in rows} == {c for _, _, c in brute(after)}

    mixed, taken = step("mixing", single)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(split_words(t))
    longest = max(len(split_words(t)) for _, t, _ in rows)
    words = Counter()
    for _, t, s in taken:
        words[s] += len(split_words(t))
    for source, target in exact_targets(sizes).items():
        assert abs(words[source] - target) <= longest / 2 + 1
    assert max(Counter(i for i, _, _ in taken).values()) <= 3

    _, pieces = step("packing", mixed)
    encoder = packing._encoder(packing.default_vocabulary())
    length = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    copies = Counter(i for i, _, _ in taken)
    assert total == Counter({i: n * length[i] for i, n in copies.items()})


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_nothing_and_odd_rows(spark, edge, stage):
    assert stage(spark, spark.createDataFrame([], edge.schema), SMALL).count() == 0
    assert stage(spark, edge, SMALL).count() >= 0


def test_stages_are_handed_on_as_parquet(spark, monkeypatch):
    read = []

    def seen(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, seen) for name, _ in corpus_pipeline.STAGES])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(corpus_pipeline.run(spark, SMALL).collect()) == sorted(docs.collect())
    for number, (name, files) in enumerate(zip([n for n, _ in corpus_pipeline.STAGES], read[1:]), 1):
        assert files and all(f"/{number}_{name}/" in f and f.endswith(".parquet") for f in files)
