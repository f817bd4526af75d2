"""Quality rules, line deduplication and licence scan against plain Python."""

from __future__ import annotations

import re
from collections import Counter

from codecensus.llm import licenses, line_dedup, quality
from tests.llm.conftest import EDGE, LINE

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def split_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def metrics(text):
    text = text or ""
    words = split_words(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split_words(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def test_base_metrics(small, edge):
    for docs in (small, edge):
        got = quality.judged(docs, carry=("doc_id", "text")).collect()
        assert len(got) == docs.count()
        for r in got:
            want = metrics(r.text)
            assert tuple(r[k] for k in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
            assert not (r.kept and r.base_failed)


def test_frequent_lines_of_a_host(frame, spark):
    other = "w{0} x{0} y{0} z{0} a{0} b{0} c{0} d{0} e{0} f{0} g{0} h{0}"
    rows = [(i, (LINE.upper() + "  \n" if i % 2 else LINE + "\n") + other.format(i), "hot") for i in range(30)]
    rows += [(100 + i, LINE + "\n" + other.format(i), "cold") for i in range(3)]  # rare on this host
    rows += [(200 + i, LINE + "\na b", "hot") for i in range(3)]  # nothing else: depleted
    rows += [(300 + i, "one text copied very often in this host and never called boilerplate", "hot") for i in range(40)]
    docs = frame(rows)
    got = {r.doc_id: r for r in quality.judged(docs, min_docs=10, max_share=0.3).collect()}
    assert all(got[i].removed_words == 10 and got[i].kept for i in range(30))
    assert all(got[100 + i].removed_words == 0 and got[100 + i].kept for i in range(3))
    assert not any(got[200 + i].kept for i in range(3))
    assert all(got[300 + i].kept for i in range(40))
    kept = {r.doc_id: r for r in quality.kept_documents(docs, min_docs=10, max_share=0.3).collect()}
    assert kept[4].text == other.format(4) and kept[4].n_chars == len(other.format(4)) and kept[4]["_key"] == "x"
    assert kept[100].text == rows[30][1] and 200 not in kept
    empty = spark.createDataFrame([], docs.schema)
    assert quality.judged(empty).count() == quality.kept_documents(empty).count() == 0


def without_repeats(rows):
    """Reading in order of id; a window seen before makes its three lines go."""
    first, out = {}, {}
    order = sorted({(i is not None, i or 0, t or "") for i, t, s in rows})
    for has, i, text in order:
        lines = text.split("\n")
        solid = [n for n, x in enumerate(lines) if split_words(x)]
        norm = [" ".join(split_words(lines[n])).lower() for n in solid]
        gone = set()
        for a in range(len(solid) - 2):
            key = tuple(norm[a:a + 3])
            if first.setdefault(key, (has, i, text, a)) != (has, i, text, a):
                gone |= set(solid[a:a + 3])
        out[has, i, text] = ("\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone))
    return out


def test_lines_are_taken_out_once_a_row(frame):
    """A filter on what remains does not bring a second copy of the function."""
    out = line_dedup.kept_documents(frame([(1, "a\nb\nc\nd", "s"), (2, "x\na\nb\nc", "s"), (3, "a\nb\nc", "s")]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "a\nb\nc\nd", 7), (2, "x", 1)]


def test_line_dedup(frame, small, spark):
    passage = "p one\nP   two \np three\np four"
    rows = [*EDGE, (20, f"head\n{passage}\ntail", "a"), (21, f"{passage.upper()}\n\nend", "b"), (22, passage, "b"),
            (23, "r\nr\nr\nr\nr", "a"), (24, "p one\nP two\nother", "a")]
    for docs, data in ((frame(rows), rows), (small, [(r.doc_id, r.text, r.source) for r in small.collect()])):
        want = without_repeats(data)
        got = line_dedup.deduplicated(docs).select("_row.doc_id", "_row.text", F_new("text"), "n_removed").collect()
        assert len(got) == len(data)
        for doc_id, old, new, removed in got:
            assert ((new or ""), removed) == want[doc_id is not None, doc_id or 0, old or ""]
    kept = {r.doc_id: r for r in line_dedup.kept_documents(frame(rows)).collect()}
    assert 22 not in kept and kept[21].text == "\nend" and kept[21].n_chars == 4 and kept[1].text is None
    assert line_dedup.deduplicated(spark.createDataFrame([], small.schema)).count() == 0


def F_new(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("new")


def test_licence_base_places(edge, small):
    def plain(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split()]
        return (len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None,
                ",".join(sorted({x for _, x in hits})))

    for docs in (small, edge):
        got = licenses.scanned(docs, carry=("doc_id", "text")).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(r.text)
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_templates(frame, spark):
    filler = "some words about nothing in particular " * 50
    rows = [
        (1, filler + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + filler, "a"),
        (2, filler + "permission granted free software copy person charge obtaining hereby" + filler, "a"),  # no order
        (3, "Licensed under the Apache License, Version 2.0 (the License)", "a"),
        (4, "Licensed under the Apache License", "a"),  # a key phrase is missing
        (5, "CC BY\nAll rights   reserved; cc-by GENERAL public-license", None), (6, None, None),
        (7, "Redistribution and use in source and binary forms, with or without any modification, are permitted", "a"),
        (8, "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met:", "a"),
    ]
    got = {r.doc_id: r for r in licenses.scanned(frame(rows)).collect()}
    assert got[1].labels == "mit" and got[1].templates[0].start == 300
    assert got[2].labels == "" and got[4].labels == "" and got[3].labels == "apache-2.0"
    assert (got[5].base_labels, got[5].n_base, got[5].first_word, got[5].last_word) == ("cc-by,gpl,reserved", 4, 0, 7)
    assert got[6].n_words == 0 and got[6].score == 0 and got[7].labels == "" and got[8].labels == "bsd"
    assert licenses.scanned(spark.createDataFrame([], frame(rows).schema)).count() == 0


def test_every_notice_is_tried():
    text = "this work is licensed under the gnu general public license version"
    # "3" is in most documents, so that it is not indexed
    index = licenses.build_index({b"3": 90, b"this": 80, b"is": 80}, 100)
    assert b"3" not in index.postings
    words = licenses.words_of(f"{text} 2 {'and so on ' * 20} {text} 3 {'and so on ' * 20} {text} 3")
    starts = [start for label, start, _ in licenses.find_templates(words, index) if label == "gpl-3.0"]
    assert starts == [12 + 60, 12 + 60 + 12 + 60]
    bsd = licenses.TEMPLATES["bsd"][0]
    common = {w: 50 for w in licenses.words_of(bsd)} | {
        w: 1 for w in licenses.words_of("redistribution source binary forms with without")}
    index = licenses.build_index(common, 100)
    words = licenses.words_of(bsd.replace("without modification", "without any modification") + " x" * 30 + " " + bsd)
    assert [label for label, _, _ in licenses.find_templates(words, index)] == ["bsd"]
    assert licenses.find_templates(words, index)[0][1] == len(licenses.words_of(bsd)) + 31


def test_frequent_lines_of_a_growing_host(frame):
    other = "w{0} x{0} y{0} z{0} a{0} b{0} c{0} d{0} e{0} f{0} g{0} h{0}"
    for size in (60, 600):  # the line is in 40 texts: first in two thirds, then in fewer than 10 %
        rows = [(i, (LINE + "\nHe said no.\n" if i < 40 else "") + other.format(i), "hot") for i in range(size)]
        got = {r.doc_id: r for r in quality.judged(frame(rows), many_docs=30).collect()}
        # the short line goes with the share only
        assert {got[i].removed_words for i in range(40)} == {13 if size == 60 else 10}
        assert not any(got[i].removed_words for i in range(40, size))
    got = quality.judged(frame(rows)).collect()
    assert not any(r.removed_words for r in got)
