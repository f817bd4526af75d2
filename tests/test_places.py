"""Running sums inside a row, and matches by them."""

from __future__ import annotations

import re
import time
from itertools import accumulate

from pyspark.sql import functions as F

from codecensus import rules
from codecensus.functions.places import sums_before
from codecensus.operators import markup


def test_sums_before(spark):
    rows = [([],), (None,), ([5],), (list(range(64)),), (list(range(65)),), ([3] * 1000,)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", sums_before(F.col("a")).alias("s")).collect()
    for r in got:
        assert r.s == (None if r.a is None else list(accumulate([0, *r.a]))[:len(r.a)])


def test_many_matches_of_a_file(spark):
    tags = [f'<p>é\n\n{i}</p><img\nalt="a{i}" src="{i}.png">' for i in range(4000)]
    text = "".join(tags)
    df = spark.createDataFrame([("r", "a.html", text)], "repo_id string, filename string, content string")
    begin = time.time()
    got = sorted((r.offset, r.line, r.src, r.alt, r.full_match) for r in markup.image_refs(df).where("type = 'img_tag'").collect())
    assert time.time() - begin < 60
    want = [(m.start(), text.count("\n", 0, m.start()) + 1, m[1], re.search("(?i)" + rules.ALT_TEXT, m[0])[1], m[0])
            for m in re.finditer("(?is)" + rules.IMG_TAG, text)]
    assert got == want and len(got) == 4000
