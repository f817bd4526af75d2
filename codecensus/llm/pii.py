"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their check holds. The method adds kinds of its own: bank account
numbers confirmed by mod-97, shorter card numbers confirmed by Luhn, phone-like or identity numbers without a
sign of their own, access key ids by their shape, and secrets: values behind ``=`` or ``:`` with letters, digits and many
different characters. These start at the score their pattern and check earn, words within ``reach`` characters on either
side raise or lower it, and those that reach ``threshold`` become spans. Added spans never replace base ones.

A pattern runs over a text twice: its matches, and the gaps between them; the lengths of both give the places. Patterns
are written so that a failed start never rescans a long run. DataFrame functions only, one scan, no shuffle.

Defined cases: null text -- empty, no spans; repeated rows each give a row; an empty table gives an empty result; columns in
``carry`` are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import documents, lower_az, text_of

# A match can start only where the character before could not have been part of it, or at the end of the
# match before; possessive loops do not give back what they read.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SHORT_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])(?![\x20.-][0-9])"
IDENTITY = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ACCESS_KEY = r"(?<![A-Za-z0-9])A(?:KIA|SIA|GPA|ROA|IDA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"""(?<![A-Za-z0-9+/_-])(?<=[:=][\x20]{0,2}["']{0,1})[A-Za-z0-9+/_-]{12,256}+(?![A-Za-z0-9+/_-])"""

# fixed values: words near a span that speak for or against its kind
SPEAKS_FOR = {
    "iban": "iban|account|konto|cuenta|compte|bank",
    "short_card": "card|visa|amex|credit|karte|tarjeta|carte",
    "local_phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "identity": "ssn|social security|identity|tax id",
    "access_key": "aws|access|key|credential",
    "secret": "passw|pwd|secret|token|api.?key|access.?key|credential|bearer|private|auth",
}
SPEAKS_AGAINST = "order|invoice|isbn|version|item|serial|part no"

# fixed values: score of pattern and checksum, and what nearby words add or take
PRIOR = {"iban": 0.7, "short_card": 0.5, "local_phone": 0.5, "identity": 0.4, "access_key": 0.95, "secret": 0.45}
STEP_UP, STEP_DOWN = 0.3, 0.3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """True if the digits of ``match`` pass Luhn's check."""
    number = F.reverse(_digits(match))
    values = F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: (
        F.when(i % 2 == 1, F.substring(number, i, F.lit(1)).cast("int"))
        .otherwise(F.substring(number, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(number, i, F.lit(1)) > "4", 9).otherwise(0))))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """True if an account number passes ISO 7064's mod 97."""
    plain = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    characters = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)))
    rest = F.aggregate(characters, F.lit(0), lambda a, x: F.when(
        x.between("0", "9"), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return rest == 1


#: different characters that a secret has at least
MIXED = 7
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(16, 19), luhn(match)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "short_card":
        return luhn(match)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        different = F.size(F.array_distinct(F.split(match, "")))
        return match.rlike("[A-Za-z]") & match.rlike("[0-9]") & (different >= MIXED)
    return F.lit(True)


#: kind -> (pattern, what a text must hold for the pattern to be tried)
BASE = {
    "email": (EMAIL, lambda text: F.contains(text, F.lit("@"))),
    "ip": (IP, lambda text: text.rlike(r"[0-9]\.[0-9]")),
    "card": (CARD, lambda text: text.rlike("[0-9]")),
    "phone": (PHONE, lambda text: F.contains(text, F.lit("+"))),
}
ADDED = {
    "iban": (IBAN, lambda text: text.rlike("[A-Z][A-Z][0-9][0-9]")),
    "short_card": (SHORT_CARD, lambda text: text.rlike("[0-9]")),
    "local_phone": (LOCAL_PHONE, lambda text: text.rlike("[0-9][0-9][0-9]")),
    "identity": (IDENTITY, lambda text: text.rlike("[0-9]-[0-9]")),
    "access_key": (ACCESS_KEY, lambda text: text.rlike("A(?:KIA|SIA|GPA|ROA|IDA)[A-Z0-9]")),
    "secret": (SECRET, lambda text: text.rlike("[:=][\\x20]{0,2}[\"']?[A-Za-z0-9+/_-]{12}")),
}


BLOCK = 64


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def spans(df: DataFrame, kind: str, text: str, pattern: str, guard) -> DataFrame:
    """Adds column ``kind``: array of (start, end, found) of the confirmed matches, ascending; places in code points."""
    raw, gap, end = f"_{kind}_raw", f"_{kind}_gap", f"_{kind}_end"
    # places only for texts with a match: the gaps are read a second time
    df = df.withColumn(raw, F.when(guard(F.col(text)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(gap, F.when(F.size(raw) > 0, F.split(text, pattern)))
    # places are sums of all lengths before; sums over blocks keep that far from quadratic in the matches
    total, sums = f"_{kind}_total", f"_{kind}_sums"
    df = df.withColumn(total, F.slice(F.zip_with(gap, raw, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))),
                                      F.lit(1), F.size(raw)))
    df = df.withColumn(sums, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(total) / BLOCK).cast("int")), lambda b: _sum(F.slice(total, b * BLOCK + 1, F.lit(BLOCK)))))
    df = df.withColumn(sums, F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b))))

    def start(_: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return (F.get(sums, block) + _sum(F.slice(total, block * BLOCK + 1, i % BLOCK)) + F.length(F.get(gap, i)))

    # arrays that a lambda reads are named twice: the optimizer would else move their making into the lambda
    ready = (F.size(total) > 0) & (F.size(sums) > 0) & (F.size(gap) > 0)
    df = df.withColumn(end, F.when(ready, F.transform(raw, start)))
    found = F.zip_with(end, raw, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))
    return df.withColumn(kind, F.filter(found, lambda x: valid(kind, x["found"]))).drop(raw, gap, end, total, sums)


def scored(kind: str, text: str, reach: int) -> Column:
    """Spans of an added kind with their scores after a look at the words on both sides of them."""
    def look(x: Column) -> Column:
        before = F.substring(F.col(text), F.greatest(x["start"] - reach + 1, F.lit(1)), F.least(F.lit(reach), x["start"]))
        after = F.substring(F.col(text), x["end"] + 1, F.lit(reach))
        near = lower_az(F.concat(before, F.lit("\n"), after))
        score = (F.lit(PRIOR[kind]) + F.when(near.rlike(SPEAKS_FOR[kind]), STEP_UP).otherwise(0.0)
                 - F.when(near.rlike(SPEAKS_AGAINST), STEP_DOWN).otherwise(0.0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), score.alias("score"))

    return F.transform(kind, look)


def found(docs: DataFrame, reach: int = 40, threshold: float = 0.65, carry=("doc_id",)) -> DataFrame:
    """One array of spans (start, end, found; added kinds also score) per kind, for every document."""
    rows = docs.select(F.struct(*carry).alias("_carry"), text_of().alias("_text"))
    for kind, (pattern, guard) in {**BASE, **ADDED}.items():
        rows = spans(rows, kind, "_text", pattern, guard)
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    taken = F.concat(*[F.coalesce(F.col(base), none) for base in BASE])

    def free(x: Column) -> Column:
        # what a base span covers is that span
        return (x["score"] >= threshold) & ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))

    for kind in ADDED:
        rows = rows.withColumn(kind, F.when(F.size(kind) > 0, F.filter(scored(kind, "_text", reach), free)))
    return rows.select("_carry.*", *BASE, *ADDED)


def joined(kinds) -> Column:
    def place(kind: str):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))

    none = F.array().cast("array<string>")
    return F.concat_ws(",", *[F.coalesce(F.transform(kind, place(kind)), none) for kind in kinds])


def span_rows(docs: DataFrame, carry=("doc_id",), **options) -> DataFrame:
    """Spans as rows (carry..., kind, start, end, found), for masking or review."""
    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    parts = [F.coalesce(F.transform(kind, named(kind)), none) for kind in (*BASE, *ADDED)]
    return found(docs, carry=carry, **options).select(*carry, F.explode(F.concat(*parts)).alias("_s")).select(*carry, "_s.*")


def op1(spark, sf_dir: str) -> DataFrame:
    rows = found(documents(spark, sf_dir))
    counts = [F.coalesce(F.when(F.col(k).isNotNull(), F.size(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    every = [F.coalesce(F.when(F.col(k).isNotNull(), F.size(k)), F.lit(0)) for k in (*BASE, *ADDED)]
    n_spans = reduce(Column.__add__, every).cast("long").alias("n_spans")
    return rows.select("doc_id", *counts, n_spans, F.sha2(joined(BASE), 256).alias("base_sha256"), joined([*BASE, *ADDED]).alias("spans"))
