"""Compare registered queries with their SQL: ``python -m tests.oracle [sf_dir] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.12g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, bool)) or v is None:
        return repr(v)
    if type(v).__name__ == "Decimal":
        return repr(int(v)) if v == v.to_integral_value() else f"{float(v):.12g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None if both sides agree, else a short report."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] == theirs[1]:
        return None if ours[1] else "both sides are empty"
    extra = sorted(set(ours[1]) - set(theirs[1]))[:2]
    lack = sorted(set(theirs[1]) - set(ours[1]))[:2]
    cut = lambda rows: [tuple(x[:300] for x in r) for r in rows]
    return f"rows {len(ours[1])} / {len(theirs[1])}\n   spark {cut(extra)}\n   sql   {cut(lack)}"


def make_spark(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("codecensus")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(entry.queries())
    spark, con = make_spark(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names:
        t = time.time()
        try:
            if name in oracles:
                report = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                report = None if n else "no rows"
        except Exception as e:  # one broken query must not hide the others
            report = "".join(traceback.format_exception_only(type(e), e))[:1500]
        took = time.time() - t
        print(f"{'ok  ' if report is None else 'FAIL'} {name} {took:.1f}s {report or ''}", flush=True)
        if report is not None:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {' '.join(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
