"""Licence scan with a positional index of rare licence words.

Templates are short licence notices with mandatory key phrases. The corpus gives every template word its
inverse document frequency; the index holds each template's ``rare`` highest-IDF words with their places.
A text looks up its own words in the index; each hit votes for (template, text place - template place),
votes of neighbouring offsets (``slack``) are joined, and every alignment whose votes carry at least ``share`` of the
template's indexed weight, and near which all its key phrases stand, gives its label and a place. Alignments within
``slack`` of a better one that passed are the same notice.

Corpus work is one count of template words over all documents (partial counts per task, as many rows as
templates have words) and one scan; texts are never shuffled. The index is as large as the templates are.

Base labels come from fixed phrases. Defined cases: null text -- no words, no labels, score 0; repeated
rows each give a row; an empty table gives an empty result; columns in ``carry`` are carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codecensus.llm.common import documents

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# fixed values: phrases whose places are the base result, with their labels
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: notices and the phrases without which they do not count
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met",
            ("redistribution and use", "with or without modification")),
    "cc-by-nc-4.0": ("this work is licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike license",
                 ("creative commons attribution", "sharealike")),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3",
                ("general public license", "version 3")),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software",
            ("permission is hereby granted", "free of charge")),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
}


def words_of(text: str | None) -> list[bytes]:
    """Words after A-Z are lower-cased; every byte of a non-ASCII character is a word byte."""
    return WORDS.findall((text or "").encode().lower())


@dataclass(frozen=True)
class Index:
    """word -> (template, place, weight) of the indexed words; weight and key phrases per template."""

    postings: dict
    weight: dict
    phrases: dict
    length: dict
    slack: int = 2
    share: float = 0.6


def document_frequency(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Documents that hold each template word, and all documents; counted over the whole table."""
    wanted = frozenset(w for notice, _ in templates.values() for w in words_of(notice))

    def count(batches):
        held: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                held.update(wanted.intersection(words_of(text)))
        held[b""] = rows
        yield pa.RecordBatch.from_pylist(
            [{"word": w.decode(), "n": n} for w, n in held.items()],
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    # at most one row per template word and task leaves the executors, one per word reaches the driver
    total = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word.encode(): r.n for r in total.collect()}
    return counts, counts.pop(b"", 0)


def build_index(frequency: dict[bytes, int], n_docs: int, rare: int = 6, templates=TEMPLATES, **limits) -> Index:
    postings, weight, phrases, length = defaultdict(list), {}, {}, {}
    for label, (notice, mandatory) in templates.items():
        words = words_of(notice)
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in words}
        chosen = set(sorted(idf, key=lambda w: (-idf[w], w))[:rare])
        for place, word in enumerate(words):
            if word in chosen:
                postings[word].append((label, place, idf[word]))
        weight[label] = sum(idf[w] for w in words if w in chosen)
        phrases[label] = [tuple(p.encode().split(b" ")) for p in mandatory]
        length[label] = len(words)
    return Index(dict(postings), weight, phrases, length, **limits)


def _stands(words: list[bytes], phrase: tuple[bytes, ...], begin: int, end: int) -> bool:
    size = len(phrase)
    return any(tuple(words[i:i + size]) == phrase for i in range(max(0, begin), min(end, len(words)) - size + 1))


def find_templates(words: list[bytes], index: Index) -> list[tuple[str, int, float]]:
    """(label, start, score) of every notice that is found; of alignments within ``slack`` the best that passes."""
    votes: dict[str, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for at, word in enumerate(words):
        for label, place, weight in index.postings.get(word, ()):
            votes[label][at - place][place] = weight
    found = []
    for label, offsets in votes.items():
        likely = []
        for offset in offsets:
            joined: dict[int, float] = {}
            for near in range(offset - index.slack, offset + index.slack + 1):
                joined.update(offsets.get(near, {}))
            score = min(sum(joined.values()) / index.weight[label], 1.0)
            if score >= index.share:
                likely.append((-score, offset))
        taken: set[int] = set()
        for score, start in sorted(likely):
            end = start + index.length[label] + index.slack
            if taken.isdisjoint(range(start - index.slack, start + index.slack + 1)) and all(
                _stands(words, phrase, start - index.slack, end) for phrase in index.phrases[label]
            ):
                taken.add(start)
                found.append((label, start, -score))
    return sorted(found)


_BASE = {tuple(phrase.encode().split(b" ")): label for phrase, label in BASE_PHRASES.items()}
_BASE_ENDS = {phrase[0] for phrase in _BASE}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    return [
        (at, label) for at, word in enumerate(words) if word in _BASE_ENDS
        for phrase, label in _BASE.items()
        if word == phrase[0] and tuple(words[at:at + len(phrase)]) == phrase
    ]


FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, templates array<struct<label: string, start: long, score: double>>")


def scanned(docs: DataFrame, carry=("doc_id",), rare: int = 6, **limits) -> DataFrame:
    """Base places and labels, template matches with their starts, all labels and the best score per document."""
    frequency, n_docs = document_frequency(docs)
    index = build_index(frequency, n_docs, rare, **limits)
    rows = docs.select(*carry, F.col("text").alias("_text"))
    schema = StructType([*rows.drop("_text").schema.fields, *StructType.fromDDL(FOUND).fields])
    names = [f.name for f in schema.fields][-8:]

    def scan(batches):
        for batch in batches:
            out = []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                base = base_places(words)
                found = find_templates(words, index)
                base_labels = sorted({label for _, label in base})
                labels = sorted({*base_labels, *(label for label, _, _ in found)})
                score = max([0.0, *(s for _, _, s in found), *([1.0] if base else [])])
                out.append((
                    len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(base_labels), ",".join(labels), score,
                    [{"label": a, "start": b, "score": c} for a, b, c in found]))
            yield _beside(batch, "_text", names, out)

    return rows.mapInArrow(scan, schema)


_TYPES = dict(zip(
    ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "templates"),
    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
     pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])))))


def _beside(batch: pa.RecordBatch, drop: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kept = [i for i, name in enumerate(batch.schema.names) if name != drop]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(i) for i in kept], *[pa.array(c, _TYPES[n]) for c, n in zip(columns, names)]],
        names=[*[batch.schema.names[i] for i in kept], *names])


def op4(spark, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir)).drop("templates")
