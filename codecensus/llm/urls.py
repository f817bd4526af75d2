"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

A URL becomes a set of tokens (host labels, host endings, path parts, query names). FP-growth over
the token sets of labelled pages, each with an item for its label, finds combinations; those that
imply the unwanted label with enough support, confidence and lift, and more often than chance explains, become rules, and a rule that a more general
rule of at least its confidence contains is pruned. Rules are matched by inverted index: different sets of URL tokens meet
each rule at its rarest token, and a rule whose tokens are all there fires. Mining reads every labelled page; the number of rules is bounded by ``min_support``, not by the input.

DataFrame functions and Spark's own FP-growth only.

Defined cases: null URL or one without ``://`` -- empty host and path, no tokens, no rule; no labels or none unwanted -- no
mined rules, all else is allowed; null labels count as wanted; repeated pages each give a row; a null page id is carried.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.functions.scale import durable
from codecensus.llm.common import lower_az

#: (verdict, host, path): fits the host and its subdomains when the URL's path starts with the path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UNWANTED = "label=unwanted"


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels and endings of the host, parts of the path, names in the query."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(lower_az(path), "[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    words = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    kinds = (("host=", labels), ("word=", words), ("path=", parts), ("query=", names))

    def named(kind: str):
        return lambda x: F.concat(F.lit(kind), x)

    return F.array_distinct(F.concat(*[F.transform(values, named(kind)) for kind, values in kinds]))


def same_pages(baskets: DataFrame) -> DataFrame:
    """(token, name): tokens that stand in exactly the same baskets share a name, one of them. Tokens of all baskets are left
    out: a rule says the same without them. The baskets are different token sets."""
    h = F.xxhash64("tokens")
    each = baskets.select(h.alias("_a"), F.xxhash64(h, F.lit(1)).alias("_b"), F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    marks = durable(marks.where(F.col("_n") < baskets.count()))
    names = marks.groupBy("_n", "_a", "_b").agg(F.min("token").alias("name"))
    return durable(marks.join(names, ["_n", "_a", "_b"]).select("token", "name"))


def contained(sets: DataFrame, rules: DataFrame, extra: Column | None = None) -> DataFrame:
    """Rows of ``sets`` (with ``tokens``) with each of ``rules`` (``_tokens`` and the token ``_rare`` of them) they hold."""
    fits = (F.col("_token") == F.col("_rare")) & (F.size(F.array_except("_tokens", "tokens")) == 0)
    return sets.withColumn("_token", F.explode("tokens")).join(rules, fits if extra is None else fits & extra)


def with_rarest(rules: DataFrame, keys) -> DataFrame:
    """``rules`` with ``_rare``, the token of each that the fewest rules hold (of equal ones the first)."""
    each = rules.select(*keys, F.explode("tokens").alias("_rare"))
    often = each.groupBy("_rare").agg(F.count(F.lit(1)).alias("_often"))
    rarest = each.join(often, "_rare").groupBy(*keys).agg(F.min(F.struct("_often", "_rare"))["_rare"].alias("_rare"))
    return rules.join(rarest, list(keys))


def class_rules(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 2.0,
    max_chance: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rule_id, tokens, confidence, lift, support), whose tokens are names of classes of tokens that stand on the same
    labelled pages, and (token, name) of the classes; from rows of ``tokens`` and ``unwanted``.

    A rule must raise the share of unwanted pages ``min_lift`` times, or lower that of the others as many times; the first
    alone is out of reach where more than 1 / ``min_lift`` of the pages are unwanted. With ``max_chance`` it must also be no
    chance: n pages of which a share c is unwanted, where the share of all is p, come about with a probability of at most
    exp(-n KL(c, p)) (Chernoff); that, times the number of combinations that were tried, may not exceed ``max_chance``."""
    rows = labelled.select(F.array_sort("tokens").alias("tokens"), F.coalesce("unwanted", F.lit(False)).alias("unwanted"))
    rows = durable(rows.groupBy("tokens", "unwanted").agg(F.count(F.lit(1)).alias("_pages")))
    names = same_pages(rows.select("tokens").distinct())
    short = (
        rows.select("tokens", F.explode("tokens").alias("token")).distinct().join(names, "token")
        .groupBy("tokens").agg(F.collect_set("name").alias("items")))
    empty = F.array().cast("array<string>")
    baskets = durable(
        rows.join(short, "tokens", "left").withColumn("items", F.coalesce("items", empty))
        .select(F.when(F.col("unwanted"), F.concat("items", F.array(F.lit(UNWANTED)))).otherwise(F.col("items")).alias("items"),
                F.explode(F.sequence(F.lit(1), F.col("_pages"))).alias("_copy")).select("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    base = F.col("confidence") / F.col("lift")
    rules = durable(
        model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == UNWANTED))
        .where((F.col("lift") >= min_lift) | ((F.col("lift") > 1) & ((1 - F.col("confidence")) * min_lift <= 1 - base)))
        .where(F.lit(True) if max_chance is None else no_chance(baskets.count(), tried(model), max_chance))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
        .withColumn("rule_id", F.xxhash64("tokens")))
    # most rules have a rule of one token less that covers them; the rest is compared by its rarest token
    less = F.filter(F.transform("tokens", lambda t: F.array_remove("tokens", t)), lambda x: F.size(x) > 0)
    shorter = rules.select("rule_id", "confidence", F.explode(less).alias("_tokens"))
    general = rules.select(F.col("tokens").alias("_tokens"), F.col("confidence").alias("_confidence"))
    near = shorter.join(general, "_tokens").where("_confidence >= confidence").select("rule_id").distinct()
    rules = durable(rules.join(near, "rule_id", "left_anti"))
    general = with_rarest(rules, ["rule_id"]).select(
        F.col("tokens").alias("_tokens"), F.col("confidence").alias("_confidence"), "_rare")
    wider = (F.size("_tokens") < F.size("tokens")) & (F.col("_confidence") >= F.col("confidence"))
    covered = contained(rules, general, wider).select("rule_id").distinct()
    return durable(rules.join(covered, "rule_id", "left_anti")), names


def tried(model) -> int:
    """Combinations whose rule was looked at: those that are frequent together with the label."""
    return max(1, model.freqItemsets.where(F.array_contains("items", UNWANTED)).count() - 1)


def no_chance(pages: int, combinations: int, max_chance: float) -> Column:
    """Whether confidence, lift and support of a rule are beyond chance."""
    c, p = F.col("confidence"), F.col("confidence") / F.col("lift")
    n = F.col("support") * pages / c
    rest = F.when(c < 1, (1 - c) * F.ln((1 - c) / (1 - p))).otherwise(0.0)
    return n * (c * F.ln(c / p) + rest) >= math.log(combinations / max_chance)


def mined_rules(labelled: DataFrame, **mining) -> DataFrame:
    """The rules of :func:`class_rules` with every token in place of its class, in all combinations: for reading. URLs are
    matched with the classes, whose number does not multiply."""
    rules, names = class_rules(labelled, **mining)
    empty = F.array().cast("array<string>")
    members = names.groupBy("name").agg(F.array_sort(F.collect_list("token")).alias("_members"))
    ways = rules.select("rule_id", F.explode("tokens").alias("name")).join(members, "name").groupBy("rule_id").agg(
        F.collect_list("_members").alias("_ways"))
    first = F.array(empty)
    every = F.aggregate("_ways", first, lambda done, choice: F.flatten(
        F.transform(done, lambda x: F.transform(choice, lambda t: F.concat(x, F.array(t))))))
    out = rules.drop("tokens").join(ways, "rule_id").select(F.explode(every).alias("tokens"), "confidence", "lift", "support")
    out = out.withColumn("tokens", F.array_sort("tokens"))
    return out.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "lift", "support")


def matched_rules(urls: DataFrame, rules: DataFrame, key: str = "url", names: DataFrame | None = None) -> DataFrame:
    """(key, rules): for each different URL the number of mined rules whose tokens it holds. URLs of equal tokens are
    matched once. With ``names`` (token, name) a URL holds a name if it holds any of its tokens."""
    index = with_rarest(durable(rules), ["rule_id"]).select(F.col("tokens").alias("_tokens"), "_rare")
    urls = urls.select(key, F.array_sort("tokens").alias("_set"))
    sets = urls.select("_set").distinct().withColumn("tokens", F.col("_set"))
    if names is not None:
        sets = sets.select("_set", F.explode("tokens").alias("token")).join(names, "token").groupBy("_set").agg(
            F.collect_set("name").alias("tokens"))
    found = contained(sets, index).groupBy("_set").agg(F.count(F.lit(1)).alias("rules"))
    return urls.join(found, "_set").select(key, "rules")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, carry=("page_id",), **mining) -> DataFrame:
    """host, path, rule, verdict and mined (number of mined rules that fire) for every page."""
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    different = urls.where("url IS NOT NULL").select("url", "host", "path").distinct().withColumn(
        "tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    label = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("unwanted"))
    labelled = urls.join(label, "page_id").select(
        tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "unwanted")
    rules_found, names = class_rules(labelled, **mining)
    fired = matched_rules(different, rules_found, names=names)
    rows = pages.select(*carry, F.col("url").alias("_url"))
    out = rows.join(fired.withColumnRenamed("url", "_url"), "_url", "left")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    out = out.withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.coalesce("rules", F.lit(0).cast("long"))
    return out.select(
        *carry, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(mined > 0, "block").otherwise("allow")).alias("verdict"), mined.alias("mined_rules"))


def op8(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), max_chance=0.05)
