from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, source) tuples, with columns whose names operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
        if extra:
            for name in ("n_words", "_key", "size", "length", "piece", "kept", "_row", "labels", "copies", "_text"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
LINE = "the same line stands in many documents of this host"
EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "no id here but words enough to pass every rule", "b"),
    (5, "five", "b"), (5, "five", "b"), (6, LONG, "a"), (7, "x" * 50_000, "a"), (8, "\n\n\n" + LINE, None),
    (9, "ÄÖ ẞ ı İ ñ   é \U0001f600", "ü"), (10, "a b c d e f g h i j\nk l m n o\np q r s t\nu v w x y z", "a"),
    (11, "a b c d e f g h i j\nk l m n o\np q r s t\nu v w x y z", "b"),
]


@pytest.fixture(scope="session")
def edge(frame):
    return frame(EDGE)


@pytest.fixture(scope="session")
def small(spark):
    """All documents of the smallest data set."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
