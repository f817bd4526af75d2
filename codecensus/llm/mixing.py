"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target (its share of all words, at most ``cap`` times its own words) and a
schedule: the density with which its words are demanded over training time 0..1,

    density(t) = target * (1 + tilt * (2 t - 1)),        -1 <= tilt <= 1,

whose integral up to t is the cumulative demand ``target * ((1 - tilt) t + tilt t^2)``. Tilts are
centred so that the demands of all sources add up to the same number of words at every moment.
Words of a source are laid end to end in a fixed pseudo-random order, epoch after epoch; inverting
the cumulative demand at the place where a document starts gives its training position. Documents
are range-sorted by position. The last document that a target reaches is taken in part.

Nothing is held per source in one task: cumulative sizes come from sums per (source, hash bucket),
the targets from repeated sums over the table of sources.

Defined cases: null text or source -- size 0, a source of its own that sorts last; rows with equal
id and text are the same document and are counted as often as they occur; an empty table gives
empty results; columns of other names are carried by :func:`mixed_rows` and do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecensus.functions.scale import durable, positions_by_range
from codecensus.llm.common import documents, n_words, null_safe_join, row_key, text_of, unwrapped, wrapped

BUCKET_ROWS = 8192


def sized(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, source, size, order, copies): one row per different document."""
    return (
        docs.select(row_key().alias("_key"), "doc_id", "source", n_words(text_of()).alias("size"))
        .groupBy("_key")
        .agg(F.max("doc_id").alias("doc_id"), F.max("source").alias("source"),
             F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
        .withColumn("order", F.xxhash64(F.lit("order"), "_key"))
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, weight, target), sources weighing ``weights`` in turn.

    Targets share all words by weight; those above ``cap`` times their source's words stop there,
    and what they leave is shared again. Only sums reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    # code-point order is the byte order of UTF-8, by which Spark compares strings
    ranked = positions_by_range(
        sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], out="_rank"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = ranked.select("source", "source_size", weight.alias("weight"))
    table = durable(table)
    level, capped = None, F.lit(False)
    most = F.col("source_size") * float(cap)
    while True:
        fixed, rest, every, number = table.agg(
            F.sum(F.when(capped, most).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum("source_size"), F.count(F.when(capped, 1)),
        ).first()
        if not every:
            return table.withColumn("target", F.lit(0.0))
        if not rest:
            return table.withColumn("target", most)
        level = (every - fixed) / rest
        capped = F.col("weight") * level > most
        if table.where(capped).count() == number:
            return table.withColumn("target", F.when(capped, most).otherwise(F.col("weight") * level))


def tilted(targets: DataFrame, strength: float) -> DataFrame:
    """Adds ``tilt``: heavier sources come later, lighter ones earlier, and demands add up evenly."""
    mean, least, most = targets.agg(
        F.sum(F.col("target") * F.col("weight")) / F.sum("target"), F.min("weight"), F.max("weight")
    ).first()
    spread = max((most or 0) - (mean or 0), (mean or 0) - (least or 0)) if mean is not None else 0
    tilt = (F.col("weight") - F.lit(mean)) * F.lit(strength / spread) if spread else F.lit(0.0)
    return targets.withColumn("tilt", tilt.cast("double"))


def _position(share: Column, tilt: Column) -> Column:
    """t with (1 - tilt) t + tilt t^2 = share."""
    linear = 1 - tilt
    root = F.sqrt(F.greatest(linear * linear + 4 * tilt * share, F.lit(0.0)))
    # the form without cancellation; the denominator is 0 only where the share is
    return F.when(linear + root > 0, 2 * share / (linear + root)).otherwise(0.0)


def curriculum(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0,
    strength: float = 0.5, bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(targets, takes). takes: doc_id, source, copy, epoch, size, taken, position and keys for every
    copy of a document that the mix takes, range-sorted by position; ``position`` is in 0..1."""
    sizes = durable(sized(docs))
    targets = durable(tilted(source_targets(sizes, weights, cap), strength))
    rows = sizes.count()
    # one more bucket for every ``bucket_rows`` documents, so that a source's bucket stays small
    buckets = max(1, -(-rows // bucket_rows))
    placed = sizes.withColumn("_bucket", F.pmod("order", F.lit(buckets)))
    volume = F.col("size") * F.col("copies")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("source", "_bucket").agg(F.sum(volume).alias("_sum"))
        .select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("source", "_bucket").orderBy("order", "_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("_in", F.coalesce(F.sum(volume).over(inside), F.lit(0)))
    placed = null_safe_join(placed, offsets, ["source", "_bucket"])
    placed = null_safe_join(placed, targets, ["source"])
    # each row of a repeated document lies beside the first; every one again in each epoch
    placed = (
        placed.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1))))
        .withColumn("start", F.col("epoch") * F.col("source_size") + F.col("_offset") + F.col("_in")
                    + F.col("copy") * F.col("size"))
    )
    taken = F.least(F.col("size"), F.round("target").cast("long") - F.col("start"))
    takes = placed.withColumn("taken", taken).where("taken > 0")
    share = F.least(F.col("start") / F.col("target"), F.lit(1.0))
    takes = takes.withColumn("position", _position(share, F.col("tilt")))
    return targets, takes.select(
        "_key", "doc_id", "source", "order", "copies", "copy", "epoch", "size", "taken", "position"
    ).repartitionByRange("position", "order").sortWithinPartitions("position", "order", "copy", "epoch")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Documents as the mix reads them: every copy that is taken by at least half becomes a row
    with the columns of ``docs``, rows in order of training position within range-sorted parts."""
    _, takes = curriculum(docs, **options)
    takes = takes.where("2 * taken >= size").groupBy("_key").agg(F.collect_list("position").alias("_positions"))
    # one exchange of the texts by key serves the removal of repeated rows and the join
    keyed = wrapped(docs).withColumn("_key", row_key()).repartition("_key").dropDuplicates(["_key"])
    joined = keyed.join(takes, "_key").withColumn("_position", F.explode("_positions"))
    placed = joined.select("_row", "_position", "_key").repartitionByRange("_position", "_key")
    return unwrapped(placed.sortWithinPartitions("_position", "_key"), docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    targets, takes = curriculum(docs)
    per_doc = takes.groupBy("_key").agg(F.expr("sum(taken) div max(copies)").alias("taken"))
    rows = docs.select("doc_id", "source", n_words(text_of()).alias("size"), row_key().alias("_key"))
    rows = rows.join(per_doc, "_key", "left")
    return null_safe_join(rows, targets, ["source"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
