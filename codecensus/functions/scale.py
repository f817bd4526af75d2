"""Building blocks that keep one hot key from landing in one task.

* numbering rows inside a group by counting per bucket first (:func:`positions_by_number`,
  :func:`positions_by_range`);
* first/last row of a group as a combinable aggregate (:func:`first_by`, :func:`last_by`);
* top-k rows of a group through ``row_number() <= k``, for which Spark prunes each map-side
  partition to k rows per group before the shuffle (:func:`top_rows`);
* cutting lineage through reliable storage (:func:`durable`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65_536
# Spark prunes before the shuffle only up to spark.sql.optimizer.windowGroupLimitThreshold
MAX_PRUNED_ROWS = 1000


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def last_by(value: Column, order: Column, where: Column | None = None) -> Column:
    """Value of the last row by ``order``; rows failing ``where`` never take part."""
    return F.max_by(value, order if where is None else F.when(where, order))


def top_rows(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def positions_by_number(
    df: DataFrame, keys, number: str, out: str = "position", bucket: int = BUCKET
) -> DataFrame:
    """1-based position inside each group by an integer column that is unique in the group.

    A group is cut into value ranges of ``bucket`` numbers, so a window never holds more than
    ``bucket`` rows however large the group is; only the counts per range are accumulated
    per group.
    """
    keys = list(keys)
    cut = df.withColumn("_range", bucket_of(number, bucket))
    before = (
        Window.partitionBy(*keys).orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(number)
    return (
        cut.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_pos") + F.col("_off"))
        .drop("_range", "_pos", "_off")
    )


def bucket_of(column: str, size: int) -> Column:
    """Number of the bucket of ``size`` consecutive integers; exact for every bigint."""
    return F.expr(f"CAST(`{column}` AS BIGINT) div {size}L")


def positions_by_range(df: DataFrame, keys, order, out: str = "position") -> DataFrame:
    """1-based position inside each group by any sortable columns (strings included).

    Rows are range-partitioned on (keys, order) once and written to reliable storage, so the
    partition number is a stable bucket; a hot group spreads over many of them.
    """
    keys, order = list(keys), list(order)
    ranged = durable(
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    before = (
        Window.partitionBy(*keys).orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_pos") + F.col("_off"))
        .drop("_range", "_pos", "_off")
    )


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and continue from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where none is named, one
    inside the warehouse, which driver and executors share as well.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)
