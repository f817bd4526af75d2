"""URL filters against plain Python."""

from __future__ import annotations

import re
from itertools import combinations

import pytest

from codecensus.llm import urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "://", "http://COM/", "http://com", "x://a://b/c", "HTTP://Www.Example.COM/en/x?y#z", "http://a.example.com/en",
       "http://notexample.com/en/", "http://example.com/en/1", "http://x.net/es/\n?q", "http://x.net/fr/#", "http://example.com:80/en/",
       "http://u@example.com/en/", "http://www.example.com?/en/", "\nhttp://b.com/\nx", "http://ÄÉ.com/ñ"]


@pytest.fixture(scope="session")
def tables(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://example.com/en/"), (4, "http://COM/")]
    rows += [(100 + i, f"https://{'bad-pills' if i % 3 == 0 else 'good'}.example.org/{'buy' if i % 2 else 'read'}/{i}?ref=1") for i in range(300)]
    pages = spark.createDataFrame([(*r, "h", "x") for r in rows], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(100 + i, 0 if i % 3 == 0 and i % 2 else 1, None) for i in range(200)], "doc_id long, quality int, toxic int")
    return pages, labels


def test_fixed_rules(tables):
    pages, labels = tables
    got = urls.judged(pages, labels, carry=("page_id", "url")).collect()
    assert len(got) == pages.count()
    for r in got:
        assert (r.host, r.path) == parts(r.url)
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and (verdict is None or r.verdict == verdict)


def test_mined_combination(tables, spark):
    pages, labels = tables
    got = {r.page_id: r for r in urls.judged(pages, labels).collect() if r.page_id and r.page_id >= 100}
    # only the combination is unwanted in the labels; pages without a label are judged by it too
    assert all((r.verdict == "block") == ((i - 100) % 3 == 0 and (i - 100) % 2 == 1) for i, r in got.items())
    none = spark.createDataFrame([], labels.schema)
    assert {r.verdict for r in urls.judged(pages, none).collect() if r.rule is None} == {"allow"}
    assert urls.judged(spark.createDataFrame([], pages.schema), labels).count() == 0


def plain_rules(rows, min_support=0.002, min_confidence=0.5, min_lift=2.0):
    """Every combination of tokens of a page, with the confidence of those that pass and have no shorter one as good."""
    base = sum(bad for _, bad in rows) / len(rows)
    sets = {frozenset(c) for t, _ in rows for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    passing = {}
    for s in sets:
        hits = [bad for t, bad in rows if s <= set(t)]
        c = sum(hits) / len(hits)
        if sum(hits) >= min_support * len(rows) and c >= min_confidence and (
                c >= min_lift * base or c > base and (1 - c) * min_lift <= 1 - base):
            passing[s] = c
    return {tuple(sorted(s)): c for s, c in passing.items() if not any(g < s and d >= c for g, d in passing.items())}


@pytest.mark.parametrize("bad_share", [4, 10])  # of twelve
def test_rules_of_few_pages(spark, bad_share):
    """Combinations in a few pages count, also where most pages are unwanted; tokens of the same pages stay apart."""
    rows = [(["h", f"a{i % 5}", f"b{i % 5}", f"c{i % 7}", f"d{i % 2}"], (i * 5) % 12 < bad_share) for i in range(120)]
    rows += [(["h", "x", "y", "z"], True)] * 2 + [(["x"], False), ([], False), (["h"], None)]
    want = plain_rules([(t, bool(bad)) for t, bad in rows])
    assert len(want) > 5 and any("y" in rule for rule in want)
    got = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, unwanted boolean")).collect()
    assert {tuple(r.tokens): r.confidence for r in got} == pytest.approx(want) and len(got) == len(want)


def test_matched_rules(spark):
    rules = [(1, ["a"]), (2, ["a", "b"]), (3, ["b", "c"]), (4, ["d"])]
    pages = [("u1", ["a", "b"]), ("u2", ["b", "a"]), ("u3", ["c", "b", "a"]), ("u4", ["c"]), ("u5", [])]
    found = urls.matched_rules(spark.createDataFrame(pages, "url string, tokens array<string>"),
                               spark.createDataFrame(rules, "rule_id long, tokens array<string>")).collect()
    assert {r.url: r.rules for r in found} == {"u1": 2, "u2": 2, "u3": 3}


def test_whole_host_labels_are_tokens(spark):
    row = spark.createDataFrame([("http://bad-pills.org/",)], "url string")
    got = row.select(urls.tokens(urls.host_of(row.url), urls.path_of(row.url), row.url)).first()[0]
    assert set(got) == {"host=bad-pills", "host=org", "word=bad", "word=pills", "word=org"}


def test_chance_makes_no_rules(spark):
    """Labels that do not depend on the tokens give no rule; a real dependency on as few pages as it takes does."""
    import random

    rng = random.Random(5)
    rows = [([f"h{rng.randrange(40)}", f"p{rng.randrange(60)}", f"q{rng.randrange(9)}"], rng.random() < 0.4) for _ in range(800)]
    schema = "tokens array<string>, unwanted boolean"
    assert urls.mined_rules(spark.createDataFrame(rows, schema)).count() > 20
    assert urls.mined_rules(spark.createDataFrame(rows, schema), max_chance=0.05).count() == 0
    rows += [([f"h{i}", "spam", "spam2"], True) for i in range(16)]
    got = urls.mined_rules(spark.createDataFrame(rows, schema), max_chance=0.05).collect()
    assert {tuple(r.tokens) for r in got} == {("spam",), ("spam2",)}
    # pages held out: everything that the rules block is unwanted, which 40 % of all pages are
    rules, names = urls.class_rules(spark.createDataFrame(rows, schema), max_chance=0.05)
    held = [(f"u{i}", [f"h{i % 40}", "spam2" if i % 4 == 0 else f"p{i % 60}"]) for i in range(80)]
    found = urls.matched_rules(spark.createDataFrame(held, "url string, tokens array<string>"), rules, names=names)
    assert {r.url for r in found.collect()} == {f"u{i}" for i in range(0, 80, 4)}
