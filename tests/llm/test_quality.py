"""Quality rules over the given tables against a plain version, and the plan of the pipeline's stage."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from codecensus.llm import quality
from tests.llm.test_filters import metrics, split_words


def plain_verdicts(rows, min_docs, max_share, many_docs, many_words, min_left=10, min_left_share=0.2):
    """(doc_id) -> (removed_words, kept) of (doc_id, text, source) rows."""
    holders, texts, normal = defaultdict(set), defaultdict(set), {}
    for _, text, source in rows:
        texts[source].add(text or "")
        for line in (text or "").split("\n"):
            if split_words(line):
                normal[line] = " ".join(split_words(line)).lower()
                holders[source, normal[line]].add(text)
    often = {
        (host, line) for (host, line), docs in holders.items()
        if (len(docs) >= min_docs and len(docs) > max_share * len(texts[host]))
        or (len(docs) >= many_docs and len(line.split()) >= many_words)}
    out = {}
    for doc_id, text, source in rows:
        n, *_, failed = metrics(text)
        removed = sum(len(split_words(x)) for x in (text or "").split("\n") if (source, normal.get(x)) in often)
        depleted = removed > 0 and (n - removed < min_left or n - removed < min_left_share * n)
        out[doc_id] = (removed, not failed and not depleted)
    return out


def test_whole_table_with_limits_that_bind(small):
    rows = [(r.doc_id, r.text, r.source) for r in small.collect()]
    for limits in ((2, 0.02, 3, 4), (3, 0.0, 1000, 5), (2, 0.5, 2, 1)):
        want = plain_verdicts(rows, *limits)
        got = quality.judged(small, **dict(zip(("min_docs", "max_share", "many_docs", "many_words"), limits)))
        got = {r.doc_id: (r.removed_words, r.kept) for r in got.collect()}
        assert got == want
    assert Counter(removed > 0 for removed, _ in want.values())[True] > 5 and any(not kept for _, kept in want.values())


def test_the_stage_extracts_words_once(small, capsys):
    quality.kept_documents(small).explain("formatted")
    plan = capsys.readouterr().out
    assert not [x for x in re.findall(r"^\(\d+\) Filter.*?(?=^\(\d+\)|\Z)", plan, re.S | re.M) if "regexp_extract_all" in x]
    assert "regexp_extract_all" not in plan  # the verdicts lie in a narrow table
