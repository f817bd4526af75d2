"""Document fingerprints by consistent weighted sampling.

A text is its words with their counts as weights. Counts are whole numbers, so a word of weight w stands for the units
(word, 1) to (word, w), which every text with at least that weight has too; sample i gives every unit a hash, and the smallest of a text is
its sample i. It is uniform over the text's weight and consistent between texts: two texts share a sample exactly with the
probability of their generalised Jaccard similarity, sum of min over sum of max of the weights. (Weights that are no whole
numbers would need logarithms, three for each word and sample, which took most of the time; a text has as many units as words.)
A fingerprint keeps 32 bits of the hash per sample, and the likeness of two fingerprints is the share of equal samples; its
standard deviation is at most 0.5 / sqrt(samples), 0.044 for the 128 of the query.

DataFrame functions only. A text and an edited form of it are sampled together: the units that both have are drawn once. Texts
are shuffled once by key (and the parts that go into neighbours' edited texts); counting words and taking minima need no
exchange after that, since a document's words stay in its partition.

Defined cases: null text -- empty; texts without words have the sample "none" throughout and are alike; repeated rows (equal
id, source and text) count as one; null ids sort first; the only row is its own neighbour; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.functions.scale import durable, positions_by_range
from codecensus.llm.common import WORD, documents, row_key, table, text_of

SAMPLES = 32
#: samples of the query
QUERY_SAMPLES = 128
#: samples drawn side by side in one row; more rows instead keep the generated code small
SIDE = 8


def _short(sample: Column) -> Column:
    """32 bits of a sample; "none" where a text has no word."""
    return F.when(sample.isNull(), F.lit(-1)).otherwise(F.hash(sample))


def sampled(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(_key, first, second): samples of two texts per row from _key, both, only_first, only_second, three strings whose
    words make up the texts. The input should be partitioned by _key."""
    kinds = (("both", 1, 1), ("only_first", 1, 0), ("only_second", 0, 1))

    def tagged(first: int, second: int):
        return lambda w: F.struct(F.xxhash64(w).alias("word"), F.lit(first).alias("first"), F.lit(second).alias("second"))

    words = F.concat(*[
        F.transform(F.regexp_extract_all(F.col(k), F.lit(WORD), F.lit(0)), tagged(a, b)) for k, a, b in kinds])
    common, most = F.least("first", "second"), F.greatest("first", "second")
    units = (
        texts.select("_key", F.explode(words).alias("_w")).select("_key", "_w.*")
        .groupBy("_key", "word").agg(F.sum("first").alias("first"), F.sum("second").alias("second"))
        .select("_key", "word", common.alias("common"), (F.col("first") > F.col("second")).alias("more"),
                F.explode(F.sequence(F.lit(1).cast("long"), most)).alias("unit"))
        # whose the unit is: of both texts, of the first or of the second
        .select("_key", F.when(F.col("unit") <= F.col("common"), 0).when(F.col("more"), 1).otherwise(2).alias("whose"),
                F.xxhash64("word", "unit").alias("unit"))
        .select("_key", "whose", "unit", F.explode(F.sequence(F.lit(0), F.lit(samples // SIDE - 1))).alias("_part"))
    )

    def drawn(i: int) -> Column:
        return F.xxhash64(F.col("unit").bitwiseXOR((F.col("_part") * SIDE + i).cast("long")))

    least = units.groupBy("_key", "_part", "whose").agg(*[F.min(drawn(i)).alias(f"m{i}") for i in range(SIDE)])
    owns = {"f": F.col("whose") != 2, "s": F.col("whose") != 1}
    # null where a text has no word
    parts = least.groupBy("_key", "_part").agg(*[
        F.min(F.when(own, F.col(f"m{i}"))).alias(f"{name}{i}") for i in range(SIDE) for name, own in owns.items()])

    def side(name: str) -> Column:
        return F.array(*[_short(F.col(f"{name}{i}")) for i in range(SIDE)])

    return (
        parts.select("_key", F.struct("_part", side("f").alias("f"), side("s").alias("s")).alias("_p"))
        .groupBy("_key").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        .select("_key", F.flatten("_p.f").alias("first"), F.flatten("_p.s").alias("second"))
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """(_key, _before, _before_id, _wanted): for each document the key and id of the one before it, by ascending id and from
    the first to the last, and the number of characters that one wants from it."""
    rows = docs.select(row_key().alias("_key"), "doc_id", F.length(text_of()).alias("_n")).groupBy("_key").agg(
        F.max("doc_id").alias("doc_id"), F.max("_n").alias("_n"))
    placed = positions_by_range(rows, [], ["doc_id", "_key"])
    placed = durable(placed.select("_key", "doc_id", "position", F.floor(F.col("_n") / 4).cast("int").alias("_wants")))
    count = placed.count()
    after = placed.select(
        (F.col("position") % F.lit(max(count, 1)) + 1).alias("position"), F.col("_key").alias("_before"),
        F.col("doc_id").alias("_before_id"), F.col("_wants").alias("_wanted"))
    pairs = placed.select("_key", "position").join(after, "position").select("_key", "_before", "_before_id", "_wanted")
    return durable(pairs)


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """_key, doc_id, n_chars, edited_sha256, and the samples of the text, its edited text and the next document."""
    pairs = neighbours(docs)
    # no id here: every use of the texts reads the same columns, so that one exchange serves them all
    texts = (
        docs.select(row_key().alias("_key"), text_of().alias("_text"))
        .repartition("_key").dropDuplicates(["_key"])
    )
    heads = texts.join(pairs, "_key").select(
        F.col("_before").alias("_key"), F.substring("_text", F.lit(1), F.col("_wanted")).alias("_head"))
    length = F.length("_text")
    kept = length - F.floor(length / 4).cast("int")
    whole = texts.join(heads, "_key").withColumn("_stay", F.substring("_text", F.lit(1), kept))
    # words that end inside the common part belong to both texts, a word across the cut to neither form alone
    edge = F.length(F.regexp_extract("_stay", r"^(?s:.*)[\x20\x09-\x0D]", 0))
    whole = whole.withColumn("_edge", edge).select(
        "_key", length.cast("long").alias("n_chars"), F.sha2(F.concat("_stay", "_head"), 256).alias("edited_sha256"),
        F.substring("_stay", F.lit(1), F.col("_edge")).alias("both"),
        F.substring("_text", F.col("_edge") + 1, length).alias("only_first"),
        F.concat(F.substring("_stay", F.col("_edge") + 1, F.length("_stay")), "_head").alias("only_second"))
    drawn = sampled(whole.select("_key", "both", "only_first", "only_second"), samples)
    none = F.array_repeat(F.lit(-1), samples)
    prints = table(
        whole.select("_key", "n_chars", "edited_sha256").join(drawn, "_key", "left")
        .withColumn("first", F.coalesce("first", none)).withColumn("second", F.coalesce("second", none)))
    following = prints.select("_key", F.col("first").alias("next")).join(pairs.drop("_wanted"), "_key")
    return prints.join(following.select(F.col("_before").alias("_key"), F.col("_before_id").alias("doc_id"), "next"), "_key")


def likeness(a: str, b: str) -> Column:
    """Share of equal samples."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a)


def written(samples: str) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = fingerprinted(docs, QUERY_SAMPLES).select(
        "_key", "n_chars", "edited_sha256", written("first").alias("fingerprint"), written("second").alias("edited_fingerprint"),
        likeness("first", "second").alias("near_edited"), likeness("first", "next").alias("near_next"))
    return docs.select("doc_id", row_key().alias("_key")).join(out, "_key").drop("_key")
