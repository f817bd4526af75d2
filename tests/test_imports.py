"""Imports read with expressions against Python's own parser, on layouts put together at random."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from codecensus.operators import profile, responses

PIECES = [
    "import a.b as c, d\n", "from e.f import g, h as i\n", "from e import (g,  # one, two\n   h as z,\n)\n", "x = '''\nimport hidden\n'''\n",
    'y = "it\'s # no"; import j\n', "# import no\n", "if 1: import k; from l import *\n", "from . import rel\n", "from .m import n\n",
    "from ..o.p import q\n", 'def f():\n    """doc\n    import hidden\n    """\n    import r\n', 'z = "a\\\nimport hidden"\n',
    "try:\n    import s\nexcept ImportError: import t\n", "from u import v, \\\n    w\n", 't = """ \\""" import hidden\n"""; import aa\n',
    "d = {'a': 1, 'import': 2}\n", "from bb import cc  # dd, ee\n", 'r"""x\nfrom hidden import y"""\n', "é = 1\nimport ñu\n",
    "s = 'ab\\'; import hidden'\n", "class A: import ff\n", "lam = lambda x: x\n", "f'{d!r}: import hidden'\n", "x = 'a' 'b' \"c\"; import gg\n",
]


def test_layouts(spark):
    rng = random.Random(7)
    rows = [("r", f"{i}.py", "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9)))) for i in range(500)]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string")

    def found(exact):
        return sorted((r.path, r.root, tuple(r.names)) for r in profile.python_imports(df, exact=exact).collect())

    assert found(False) == found(True) and len(found(True)) > 1000


def test_long_literals_do_not_overflow(spark):
    text = 'x = """' + 'a "quoted" \\n line\nimport hidden\n' * 50_000 + '"""\nimport seen\n'
    df = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", "'" * 99_999), ("r", "c.py", None)], "repo_id string, path string, content string")
    assert [r.root for r in profile.python_imports(df).collect()] == ["seen"]


def test_fenced_code(spark):
    texts = ["pre ```python\n a \n``` post", "```python\nno end", "```rust\nx\n``` y ```", "　a\x1c ", "```\n```", "```javascript\na ```python\n b ``` c ```",
             "```rust\nx\n```\nbetween\n```", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", responses.fenced_code(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == ["a", "```python\nno end", "```rust\nx\n``` y ```", "a", "", "a", "between", None]
