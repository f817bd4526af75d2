"""Positional byte pieces: finding whole strings in texts without moving the texts.

A string of at most ``PIECE`` bytes is one piece; a longer one is covered by pieces of ``PIECE`` bytes that follow each other
(the last one may overlap) and occurs where all of them occur at fitting places. A piece is looked for by its anchor, its
first 24, 16 or 8 bytes (all of a shorter one), hashed together with the keys. Where an anchor stands, a text gives the
bytes from there, no more than pieces of that kind have, and these are compared with the piece, so a hit is exact. UTF-8
text contains a string exactly where its bytes do.

Texts are read where they are and give only anchors that some string of their keys needs; which these are, tasks know by a
table of bits (a Bloom filter) of ``SPREAD`` bits a piece and at most ``2 ** SLOT_BITS`` in all. Other anchors it lets
through find no partner in the join that follows; beyond 2 ** SLOT_BITS / SPREAD pieces there are more of these, which costs
time and disk, but no hit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scale import durable

LONG = 8
#: bytes of anchors of more than one gram
ANCHORS = (8, 16, 24)
#: bytes of a piece; also the kind of the pieces of longer strings, of which every place counts
PIECE = 128
SPREAD = 32
SLOT_BITS = 28
PROBES = 4
#: bytes of texts that are taken at once: the numbers made of them stay in a core's cache
BLOCK = 1 << 16
#: rows of a batch that is handed on
ROWS = 10_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(raw: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Eight bytes from every place in [begin, end) as one number, zeros behind the end."""
    part = np.zeros(end - begin + LONG - 1, np.uint64)
    taken = raw[begin:end + LONG - 1]
    part[:len(taken)] = taken
    out = np.zeros(end - begin, np.uint64)
    for k in range(LONG):
        out = (out << np.uint64(8)) | part[k:k + end - begin]
    return out


def kind_of(length: int) -> int:
    """The kind of a string of so many bytes: the length of its anchor, or ``PIECE``."""
    return PIECE if length > PIECE else max((a for a in ANCHORS if a <= length), default=length)


def anchor_of(kind: int) -> int:
    return min(kind, ANCHORS[-1])


def mixed(x: np.ndarray, gram: np.ndarray) -> np.ndarray:
    x = (x ^ gram) * _ODD
    x ^= x >> np.uint64(32)
    return x


def hashed(kinds, every: np.ndarray, salts: np.ndarray):
    """(kind, hash of the anchor that begins at each place) for ``every`` place as :func:`windows` gives it."""
    with np.errstate(over="ignore"):
        chain = salts
        for kind in sorted(kinds):
            anchor = anchor_of(kind)
            if anchor < LONG:
                x = mixed(salts, every & np.uint64(~((1 << 8 * (LONG - anchor)) - 1) & (1 << 64) - 1))
            else:
                # the eight bytes before are in the chain for anchors of all lengths, in turn
                for begin in range(0 if chain is salts else done, anchor, LONG):
                    size = len(every) - begin
                    chain = mixed(chain[:max(0, size)], every[begin:])
                x, done = chain, anchor
            x = (x + np.uint64(kind)) * _ODD
            x ^= x >> np.uint64(29)
            yield kind, x


def probes(bits: int) -> list[int]:
    """How far a hash is shifted for each of its places in the table."""
    return [round(i * (64 - bits) / (PROBES - 1)) for i in reversed(range(PROBES))]


def needle_pieces(needles: DataFrame, salt: str, column: str = "needle") -> DataFrame:
    """``needles`` without ``salt`` and with one row per piece that covers a string: kind, hash, piece, shift (its place in
    the string) and pieces (their number). Empty strings have none."""
    names = [c for c in needles.columns if c != salt]

    def cover(batches):
        for batch in batches:
            row, kinds, pieces, shifts, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                raw = (text or "").encode()
                if not raw:
                    continue
                places = [0] if len(raw) <= PIECE else sorted({*range(0, len(raw) - PIECE + 1, PIECE), len(raw) - PIECE})
                for place in places:
                    row.append(i)
                    kinds.append(kind_of(len(raw)))
                    pieces.append(raw[place:place + PIECE])
                    shifts.append(place)
                    counts.append(len(places))
            kind = np.array(kinds, np.int32)
            salts = batch.column(salt).to_numpy(zero_copy_only=False).view(np.uint64)[row] if row else np.zeros(0, np.uint64)
            out = np.zeros(len(row), np.uint64)
            for k in sorted(set(kinds)):
                at = np.flatnonzero(kind == k)
                whole = b"".join(pieces[i][:anchor_of(k)].ljust(ANCHORS[-1], b"\0") for i in at)
                every = windows(np.frombuffer(whole, np.uint8), 0, len(whole))
                out[at] = next(hashed([k], every, np.repeat(salts[at], ANCHORS[-1])))[1][::ANCHORS[-1]]
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(taken) for name in names], pa.array(kind), pa.array(out.view(np.int64)),
                 pa.array(pieces, pa.binary()), pa.array(shifts, pa.int64()), pa.array(counts, pa.int32())],
                names=[*names, "kind", "hash", "piece", "shift", "pieces"])

    out = StructType([*needles.select(*names).schema.fields, *StructType.fromDDL("kind int, hash long, piece binary, shift long, pieces int").fields])
    return needles.mapInArrow(cover, out)


def wanted_slots(pieces: DataFrame) -> tuple[bytes, int, dict[int, int]]:
    """The table, the logarithm of its size, and the longest piece of every kind there is: no more than
    2 ** SLOT_BITS bits reach the driver, whatever the number of strings is."""
    found = pieces.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("piece")).alias("longest")).collect()
    kinds = {r.kind: r.longest for r in found}
    bits = min(SLOT_BITS, max(16, math.ceil(math.log2(SPREAD * (sum(r.n for r in found) + 1)))))
    slots = F.array(*[F.shiftrightunsigned("hash", k).bitwiseAND(F.lit((1 << bits) - 1)) for k in probes(bits)])
    at = F.col("slot") + 1
    rows = pieces.select(F.explode(slots).alias("slot")).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        begin = (r.bucket - 1) * len(part)
        table[begin:begin + len(part)] = part[:len(table) - begin]
    return table.tobytes(), bits, kinds


def text_pieces(texts: DataFrame, column: str, salt: str, table: bytes, bits: int, kinds: dict[int, int], block: int = BLOCK) -> DataFrame:
    """(every column but the text and ``salt``, kind, hash, place, window) of the anchors in ``table``: all places of kind
    ``PIECE``, of the others one for each different window of a text or of a block of it."""
    sent = texts.sparkSession.sparkContext.broadcast(table)
    kept = [c for c in texts.columns if c not in (column, salt)]
    fields = StructType.fromDDL("row long, kind int, hash long, place long, window binary")
    ahead = max([LONG, *kinds.values()]) - 1

    def found(parts, slots):
        """Lists row, kind, hash, place, window for parts (row, salt, text, begin) of texts."""
        out = ([], [], [], [], [])
        cuts = [text[begin:begin + block + ahead] for _, _, text, begin in parts]
        starts = np.cumsum([0, *map(len, cuts)])
        joined = b"".join(cuts)
        every = windows(np.frombuffer(joined, np.uint8), 0, len(joined))
        salts = np.repeat(np.array([x[1] for x in parts], np.int64).view(np.uint64), np.diff(starts))
        for kind, hashes in hashed(kinds, every, salts):
            anchor, longest, at = anchor_of(kind), kinds[kind], None
            for k in probes(bits):
                slot = (hashes >> np.uint64(k)) & np.uint64((1 << bits) - 1)
                bit = slots[(slot >> np.uint64(3)).view(np.int64)] >> (slot.astype(np.uint8) & np.uint8(7))
                hit = np.flatnonzero(bit & np.uint8(1))
                at, hashes = hit if at is None else at[hit], hashes[hit]
            part = np.searchsorted(starts, at, side="right") - 1
            # an anchor ends in its part and begins where the part is not yet the next one's
            own = (at + anchor <= starts[part + 1]) & (at - starts[part] < block)
            at, hashes, part = at[own], hashes[own], part[own]
            # strings without anchor beyond their own bytes need no more than these
            size = anchor if anchor < LONG else longest
            known, ends = set(), starts[1:].tolist()
            for i, h, p in zip(at.tolist(), hashes.view(np.int64).tolist(), part.tolist()):
                window = joined[i:min(i + size, ends[p])]
                if kind != PIECE:
                    if (p, window) in known:
                        continue
                    known.add((p, window))
                row, _, _, begin = parts[p]
                for values, value in zip(out, (row, kind, h, begin + i - (ends[p] - len(cuts[p])), window)):
                    values.append(value)
        return out

    def read(batches):
        slots = np.frombuffer(sent.value, np.uint8)

        def handed(batch, lists):
            for begin in range(0, len(lists[0]), ROWS):
                columns = [pa.array(x[begin:begin + ROWS], t) for x, t in zip(lists, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(columns[0]) for c in kept], *columns[1:]], names=[*kept, *fields.names[1:]])

        for batch in batches:
            salts, waiting, held = batch.column(salt).to_pylist(), [], 0
            for i in range(batch.num_rows):
                text = (batch.column(column)[i].as_py() or "").encode()
                for begin in range(0, len(text), block):
                    waiting.append((i, salts[i], text, begin))
                    held += min(block, len(text) - begin)
                    if held >= BLOCK:
                        yield from handed(batch, found(waiting, slots))
                        waiting, held = [], 0
            if waiting:
                yield from handed(batch, found(waiting, slots))

    out = StructType([*texts.select(*kept).schema.fields, *fields.fields[1:]])
    return texts.select(*kept, salt, column).mapInArrow(read, out)


def occurrences(needles: DataFrame, texts: DataFrame, keys, column: str = "needle", text: str = "content", carry=(), block: int = BLOCK) -> DataFrame:
    """(keys, needle, carry) for every string and every text of equal ``keys`` that contains it; one row per row of
    ``texts``. Strings are the distinct (keys, ``column``) of ``needles``."""
    keys = list(keys)
    salt = F.xxhash64(*[F.col(k).cast("string") for k in keys]).alias("_salt")
    pieces = durable(needle_pieces(needles.select(*keys, column).distinct().select("*", salt), "_salt", column))
    table, bits, kinds = wanted_slots(pieces)
    rows = texts.select(*keys, *carry, F.monotonically_increasing_id().alias("_row"), salt, text)
    met = text_pieces(rows, text, "_salt", table, bits, kinds, block).join(pieces, [*keys, "kind", "hash"]).where(
        F.startswith("window", "piece"))
    # a text gives each place of the pieces of longer strings once; one piece needs no place
    begin = F.when(F.col("pieces") > 1, F.col("place") - F.col("shift"))
    # dealt once for both groupings
    dealt = met.select(*keys, column, "pieces", *carry, "_row", begin.alias("_begin")).repartition(*keys, column, "_row")
    placed = dealt.groupBy(*keys, column, "pieces", *carry, "_row", "_begin").agg(F.count(F.lit(1)).alias("_n"))
    return placed.where("pieces = 1 OR _n = pieces").select(*keys, column, *carry, "_row").distinct().drop("_row")
