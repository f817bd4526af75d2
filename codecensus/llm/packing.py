"""Best-fit packing of documents into training sequences under several capacities.

A document's token ids end with ``end_id``; only documents longer than a sequence are cut, into full
pieces and a rest. Pieces are dealt by hash into groups of about ``group_rows``; every group is packed by
vector best fit: pieces in descending order of length go, among the open sequences that have room in every
dimension (tokens, documents, attention cost = sum of squared lengths), to the one with the smallest
weighted norm of what remains (or the largest weighted dot product of demand and remaining room). Groups are
random parts of the same mixture, so only a group's last few sequences have avoidable room. With the default limits, as in op7 and the
pipeline, tokens alone decide what fits: each piece has at least one token, and the sum of squares never exceeds the squared sum,
so 4096 documents and a cost of 4096 * 4096 cannot bind. The contract's aim is few sequences; tighter limits are for the caller.

Tokens are made in the scan, word by word with a bounded memo per task, and shuffled only if ``keep_ids``
asks for them; what is grouped are rows of a few numbers.

Defined cases: null text -- empty, so its only token is ``end_id``; repeated rows are packed each; a
null id is carried; an empty table gives an empty result; columns in ``carry`` are carried.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codecensus.llm.common import documents, written

CAPACITY = 4096
#: words whose ids a worker remembers unless told otherwise, half of them since the last change of generation
MEMO = 300_000
#: and in op7, which has its executors to itself: some 200 bytes a word
MANY = 1_500_000
#: characters whose words are looked up at once
PORTION = 1_000_000


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


#: the parts of a vocabulary file that say how text is cut, for which words of Latin letters, digits and signs can be cut here
_CUT = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: visible characters below U+0100; of these no two combine, and none is a blank to one side only
_PLAIN = re.compile("[!-~\xa1-\xac\xae-\xff]+")
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Ids (little-endian 32 bit) of texts under a vocabulary that drops white space, so that words between
    white space are encoded alone; the words seen last are remembered in two generations, ``memo`` at most.

    A new word of plain characters is cut as the vocabulary says, and only its parts are given to the vocabulary's model:
    regular expressions and alignments took the encoder most of its time. Any other word is encoded whole.
    """

    def __init__(self, vocabulary: str, memo: int | None = None):
        self.encoder, self.memo = _encoder(vocabulary), memo or MEMO
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        rules = json.loads(self.encoder.to_str())
        self.cut_here = (rules["normalizer"], rules["pre_tokenizer"]) == _CUT
        self.model, self.names = self.encoder.model, _byte_names()
        self.sign = lru_cache(maxsize=10_000)(self.part)

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        again = new.intersection(self.before)
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        new -= again
        if not new:
            return
        if len(self.known) + len(new) > self.memo // 2:
            self.before, self.known = self.known, {w: self.known[w] for w in words if w in self.known}
        rest = []
        for word in new:
            ids = self.plain(word) if self.cut_here else None
            if ids is None:
                rest.append(word)
            else:
                self.known[word] = ids
        self.encode(rest)

    def plain(self, word: bytes) -> bytes | None:
        """Ids of a word of plain characters; None for others and where an added token may stand."""
        text = word.decode()
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return None
        text = text.lower()
        if text.isalpha():
            return self.part(text)
        # digits and signs come again and again, and letters may be known as a word
        return b"".join([self.known.get(x.encode()) or self.part(x) if x.isalpha() else self.sign(x) for x in _PARTS.findall(text)])

    def part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.names)
        ids = [token.id for token in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 5_000):
            part = [w.decode() for w in new[at:at + 5_000]]
            # one encoding for many words: white space separates them and leaves no token
            encoded = self.encoder.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            starts = np.array([s for s, _ in encoded.offsets], np.int64)
            begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
            cuts = np.searchsorted(starts, begin)
            raw = ids.tobytes()
            for i, word in enumerate(part):
                self.known[word.encode()] = raw[4 * cuts[i]:4 * cuts[i + 1]]

    def batch(self, texts: pa.Array):
        """Ids of each text as bytes; texts are taken in portions of bounded size."""
        at = 0
        while at < len(texts):
            portion, size = [], 0
            while at < len(texts) and (not portion or size < PORTION):
                text = (texts[at].as_py() or "").encode()
                # the vocabulary lower-cases; doing so here for A-Z halves the different words
                portion.append(text.split() if b"<|" in text else text.lower().split())
                size += len(text)
                at += 1
            self.learn({w for words in portion for w in words})
            for words in portion:
                yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _word_ids(vocabulary: str, memo: int | None) -> WordIds:
    """One memo per worker process, whatever the number of tasks it runs."""
    return WordIds(vocabulary, memo)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, carry=("doc_id",),
           keep_ids: bool = False, memo: int | None = None) -> DataFrame:
    """(carry..., piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    rows = docs.select(*carry, F.col("text").alias("_text"))
    made = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    schema = StructType([*rows.drop("_text").schema.fields, *StructType.fromDDL(made).fields])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = _word_ids(vocabulary, memo)
        for batch in batches:
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, raw in enumerate(encoder.batch(batch.column("_text"))):
                raw += end
                for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    source.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            taken = pa.array(source, pa.int64())
            columns = [batch.column(i).take(taken) for i in kept]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int,
             weights=(1.0, 0.1, 0.1), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; lengths in the order in which they are placed."""
    room = np.empty((len(lengths), 3))
    whole = np.array([capacity, max_docs, max_cost], float)
    weight = np.asarray(weights)
    # sequences stay in ``open_`` while anything may still go in
    open_ = np.empty(0, np.int64)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    shortest = np.minimum.accumulate(lengths[::-1])[::-1] if len(lengths) else lengths
    made = 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) * length])
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left = room[open_] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            if rule == "norm":
                score = (((left[fits] / whole) ** 2) * weight).sum(axis=1)
            else:
                score = -((need / whole) * (room[open_[fits]] / whole) * weight).sum(axis=1)
            at = open_[fits[np.argmin(score)]]
        else:
            at = made
            room[at] = whole
            made += 1
            open_ = np.append(open_, at)
        sequence[i] = at
        offset[i] = capacity - room[at, 0]
        room[at] -= need
        if i + 1 < len(lengths) and (room[at, 0] < shortest[i + 1] or room[at, 1] < 1):
            open_ = open_[open_ != at]
    return sequence, offset


def packed(cut: DataFrame, capacity: int = CAPACITY, max_docs: int = 4096, max_cost: int = CAPACITY * CAPACITY,
           group_rows: int = 8192, weights=(1.0, 0.1, 0.1), rule: str = "norm") -> DataFrame:
    """``cut`` (with a ``length``) and the sequence_id and offset of every row."""
    # the number gives equal rows places of their own, and is fixed once it is written
    numbered = written(cut.withColumn("_id", F.monotonically_increasing_id()), slim=True)
    groups = max(1, -(-numbered.count() // group_rows))
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_id"), F.lit(groups)))
    schema = StructType([*cut.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_id", "ascending")])
        number, offset = best_fit(group.column("length").to_numpy(), capacity, max_docs, max_cost, weights, rule)
        ids = group.column("_group").to_numpy() * 2**32 + number
        return (
            group.drop_columns(["_group", "_id"])
            .append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        )

    return dealt.groupBy("_group").applyInArrow(pack, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, carry=("doc_id",), keep_ids: bool = False,
                   memo: int | None = None, **limits) -> DataFrame:
    capacity = limits.get("capacity", CAPACITY)
    return packed(pieces(docs, vocabulary or default_vocabulary(), capacity, carry=carry, keep_ids=keep_ids, memo=memo), **limits)


def op7(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), memo=MANY)
