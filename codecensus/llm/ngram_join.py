"""Exact n-gram Jaccard join and its groups, by vertical partitioning.

A document is the set of its five-word shingles, as 64-bit hashes; the hash order is the global order, cut into
fragments of consecutive values. Documents with equal sets form one class and go on as one.

1. *Candidates.* Two sets with Jaccard >= 3/4 share at least k shingles among the first n - ceil(3n/4) + k of each. Only these
   prefixes, with k an eighth of the set, are sent to fragments, and a class goes on if that many prefix shingles of it occur in
   other classes (k of the smallest partner it may have). One shared passage of a long text is thus not enough.
2. *Fragments.* The whole sets of those classes are sent to fragments, which keep the shingles of two or more
   classes, class by class. A class of which less than 3/4 of the shingles are shared has no partner and drops out.
3. *Segments.* The order of the shared shingles is then refined: by anchor, the holder that shares most of its set. The
   shingles of one anchor are a segment (several consecutive ones where they have more postings than a fragment), so
   that the common part of a group of similar texts is counted in few places.
4. *Partial overlaps.* Every segment counts the overlaps of its ``leaders`` with the classes of other components. A pair is only
   sent on if its overlap there, and all that both hold in other segments, could reach 3/4; a pair that does not
   pass somewhere is no link. Sums per pair are thus exact for links and never too large. Links are
   closed to components, and the next of at most ``rounds`` rounds, with other leaders, looks across components only.
5. *The rest, exactly.* Then every segment counts all pairs of different components, with the same test. Pairs inside a
   component need no count: they can change nothing.

Every link between different texts thus acts on the result. Work of steps 1-4 is linear in the postings. Step 5 compares the
classes outside a segment's largest component with its others by matrix products in blocks: time grows with that product,
rows only with the pairs that pass. Postings of a shingle that many documents of a task hold are merged
before the shuffle of step 1, and equal sets before the others.

Defined cases: null or wordless text -- empty set, linked with nothing; fewer than five words -- one shingle of
all words; equal texts -- one class; a null id belongs to groups but never names one that has other ids; an empty
table gives an empty result; other columns are carried by :func:`one_of_each` only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import documents, freed, hashed_words, mixed, row_key, text_of, trimmed, trimmed_map
from codecensus.llm.common import table as table_of
from codecensus.llm.common import unwrapped, wrapped, written
from codecensus.llm.components import components

WORDS = 5
PORTION = 3_000_000
LEADERS = 8
# segments of more classes than this are counted by matrix products
SMALL = 64
PORTION_ROWS = 50_000
#: fragments of the hash order at least, so that small inputs are spread too
FRAGMENTS = 16
_STEP = np.uint64(0xD6E8FEB86659FD93)


def portions(batches, column: str = "text", portion: int = PORTION):
    """(batch, first row, texts as bytes) in portions of bounded size, so that arrays stay small."""
    for batch in batches:
        values = batch.column(column)
        texts, size, first = [], 0, 0
        for row in range(batch.num_rows):
            text = (values[row].as_py() or "").encode()
            texts.append(text)
            size += len(text)
            if size >= portion or len(texts) >= PORTION_ROWS:
                yield batch, first, texts
                texts, size, first = [], 0, row + 1
        if texts:
            yield batch, first, texts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text."""
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    rolled = np.full(max(0, len(words) - WORDS + 1), np.uint64(WORDS))
    for k in range(WORDS):
        rolled = rolled * _STEP + words[k:k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for end, n in zip(ends, counts):
        start = end - n
        if n >= WORDS:
            out.append(np.unique(rolled[start:end - WORDS + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[start:end]:
                    one = one * _STEP + w
            out.append(mixed(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    with np.errstate(over="ignore"):
        first, second = mixed(shingles).sum(dtype=np.uint64), (mixed(shingles + _STEP) | np.uint64(1)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def _eighth(n):
    return np.maximum(1, n // 8)


def prefix_length(n: int) -> int:
    return min(n, n - -(-3 * n // 4) + int(_eighth(n)))


def least_shared() -> Column:
    """Prefix shingles that a set of n shares with any partner; the smallest partner has 3n/4."""
    return F.greatest(F.lit(1), F.expr("((3 * n + 3) div 4) div 8"))


def sets(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, n, s1, s2) for every row: size and signature of its shingle set."""
    @trimmed_map
    def make(batches):
        for batch, first, texts in portions(batches):
            found = [(len(s), *signature(s)) for s in shingle_sets(texts)]
            n, s1, s2 = (pa.array(x, pa.int64()) for x in zip(*found))
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, s1, s2], names=["_key", "doc_id", "n", "s1", "s2"])

    rows = docs.select(row_key().alias("_key"), "doc_id", text_of().alias("text"))
    return rows.mapInArrow(make, "_key string, doc_id long, n long, s1 long, s2 long")


def fragment_of(shingles: np.ndarray, fragments: int) -> np.ndarray:
    """Number of the range that holds each hash; ascending with the hash."""
    return ((shingles >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


_PACKED = "frag int, label binary, size binary, lead binary, shingle binary"
_PACKED_ARROW = pa.schema([("frag", pa.int32()), *[(x, pa.binary()) for x in ("label", "size", "lead", "shingle")]])


def _packed(fragments: int, labels: list[int], flat: np.ndarray, owner: np.ndarray, ahead: np.ndarray | None = None):
    """One row per fragment: the labels that reach it, each one's number of shingles there, how many of those are marked
    ``ahead``, and the shingles. ``owner`` is the place in ``labels``, ascending."""
    if not len(flat):
        return
    where = fragment_of(flat, fragments)
    if ahead is None:
        ahead, order = np.zeros(len(flat), bool), np.argsort(where, kind="stable")
    else:
        order = np.lexsort((~ahead, owner, where))
    # only fragments that occur: there may be many more of them than shingles here
    reached, cuts = np.unique(where[order], return_index=True)
    names = np.array(labels, np.int64)
    rows = []
    for f, part in zip(reached.tolist(), np.split(order, cuts[1:])):
        begin = _begins(owner[part])
        who = owner[part][begin]
        size = np.diff(np.append(begin, len(part)))
        lead = np.add.reduceat(ahead[part].astype(np.int64), begin)
        rows.append((f, names[who].tobytes(), size.astype("<u4").tobytes(), lead.astype("<u4").tobytes(), flat[part].tobytes()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_ARROW.types)], schema=_PACKED_ARROW)


#: postings of a fragment that are sorted or counted at once
AT_ONCE = 200_000


def _flat(column, kind) -> np.ndarray:
    """The values in the rows of a binary column, one after the other; without a copy if the column is one piece."""
    kind, parts = np.dtype(kind), []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        _, ends, data = chunk.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
        first, last = (int(ends[chunk.offset + i]) for i in (0, len(chunk)))
        if last > first:
            parts.append(np.frombuffer(data, kind, (last - first) // kind.itemsize, first))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, kind), *parts])


def _parts(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """(label, size, lead, shingle) of a fragment, batch by batch as it came: nothing is copied, however few postings a label has."""
    return [tuple(_flat(batch.column(c), t) for c, t in (("label", np.int64), ("size", "<u4"), ("lead", "<u4"), ("shingle", np.uint64)))
            for batch in table.to_batches()]


def _slices(parts, at_once: int | None = None):
    """(shingle, label, whether marked) of the postings, range of hashes by range, about ``at_once`` in each; a shingle stands in
    one only."""
    parts = [(label, lead, shingle, np.repeat(np.arange(len(label), dtype=np.uint32), size), (np.cumsum(size) - size).astype(np.uint32))
             for label, size, lead, shingle in parts if len(shingle)]
    if not parts:
        return
    low, high = min(x[2].min() for x in parts), max(x[2].max() for x in parts)
    width = (high - low) // np.uint64(max(1, -(-sum(len(x[2]) for x in parts) // (at_once or AT_ONCE)))) + np.uint64(1)
    for k in range(int((high - low) // width) + 1):
        values, labels, marks = [], [], []
        for label, lead, shingle, who, start in parts:
            # a smaller hash wraps round and is none of these
            with np.errstate(over="ignore"):
                at = np.flatnonzero(shingle - (low + np.uint64(k) * width) < width)
            own = who[at]
            values.append(shingle[at])
            labels.append(label[own])
            # the first ``lead`` postings of each label in a row are marked
            marks.append(at - start[own] < lead[own])
        value = np.concatenate(values)
        if len(value):
            yield value, np.concatenate(labels), np.concatenate(marks)


@trimmed
def shared_here(table: pa.Table) -> pa.Table:
    """(label, shared) of the prefix shingles of a fragment. Postings are sorted range by range, and labels only where they
    stand, so that a fragment takes little more memory than its rows."""
    parts = _parts(table)
    # labels without postings bring their number
    names, counts = [label[size == 0] for label, size, _, _ in parts], [lead[size == 0].astype(np.int64) for _, size, lead, _ in parts]
    for value, label, marked in _slices(parts):
        order = np.argsort(value, kind="stable")
        value, label, marked = value[order], label[order], marked[order]
        # sets that stand in several tasks meet themselves: only different labels count
        begin = _begins(value)
        low, high = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
        met = np.repeat(low != high, np.diff(np.append(begin, len(label)))) & ~marked
        found, often = np.unique(label[met], return_counts=True)
        names.append(found)
        counts.append(often)
    label, at = np.unique(np.concatenate([np.zeros(0, np.int64), *names]), return_inverse=True)
    shared = np.bincount(at, weights=np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(label))
    return pa.table({"label": pa.array(label, pa.int64()), "shared": pa.array(shared.astype(np.int64))})


def candidates(docs: DataFrame, fragments: int) -> DataFrame:
    """(label, shared): prefix shingles that a set shares with other sets (at least that many are counted, copies of a set in
    several tasks may count more); ``label`` is s1."""
    @trimmed_map
    def emit(batches):
        for _, _, texts in portions(batches):
            own = {}
            for s in shingle_sets(texts):
                if len(s):
                    own.setdefault(signature(s)[0], s[:prefix_length(len(s))])
            labels, lengths = list(own), [len(s) for s in own.values()]
            if not labels:
                continue
            flat = np.concatenate(list(own.values()))
            owner = np.repeat(np.arange(len(labels)), lengths)
            _, first, inverse, often = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            # one posting per shingle leaves the task: with it every other task learns that it is shared. What is shared
            # here is counted here, and marked on its way
            here = often[inverse] > 1
            keep = np.sort(first)
            yield from _packed(fragments, labels, flat[keep], owner[keep], here[keep])
            known = np.bincount(owner[here], minlength=len(labels))
            some = np.flatnonzero(known)
            if len(some):
                names = np.array(labels, np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((
                    int(fragment_of(mixed(names[:1].astype(np.uint64)), fragments)[0]), names.tobytes(),
                    np.zeros(len(some), "<u4").tobytes(), known[some].astype("<u4").tobytes(), b""), _PACKED_ARROW.types)],
                    schema=_PACKED_ARROW)

    rows = docs.select(text_of().alias("text")).mapInArrow(emit, _PACKED)
    met = rows.groupBy("frag").applyInArrow(shared_here, "label long, shared long")
    return met.groupBy("label").agg(F.sum("shared").alias("shared"))


_GROUPS = "frag int, label binary, groups binary, member binary, segment binary, shared binary"


def _group_row(frag: int, label, size, segment=None) -> pa.Table:
    """The row of a fragment: its labels, the sizes of the groups of labels that share a shingle, the members of the
    groups as places in ``label``, the groups' segments and each label's number of shared shingles."""
    names, member = np.unique(label), np.empty(len(label), "<u4")
    for i in range(0, len(label), AT_ONCE):
        member[i:i + AT_ONCE] = np.searchsorted(names, label[i:i + AT_ONCE])
    return pa.table({
        "frag": pa.array([frag], pa.int32()), "label": [names.astype(np.int64).tobytes()], "groups": [size.astype("<u4").tobytes()],
        "member": [member.tobytes()], "segment": [b"" if segment is None else segment.astype(np.uint64).tobytes()],
        "shared": [np.bincount(member, minlength=len(names)).astype("<u4").tobytes()]})


def fragment_table(docs: DataFrame, chosen: DataFrame, fragments: int) -> DataFrame:
    """One row per fragment of the hash order, as by :func:`_group_row`, of the shingles that chosen classes share."""
    rows = wrapped(docs).withColumn("_key", row_key()).join(
        chosen.select("_key", "label").hint("shuffle_hash"), "_key").select("label", text_of().alias("text"))

    @trimmed_map
    def emit(batches):
        for batch, first, texts in portions(batches):
            labels = batch.column("label").slice(first, len(texts)).to_pylist()
            own = dict(zip(labels, shingle_sets(texts)))
            lengths = [len(x) for x in own.values()]
            yield from _packed(fragments, list(own), np.concatenate([np.zeros(0, np.uint64), *own.values()]),
                               np.repeat(np.arange(len(own)), lengths))

    @trimmed
    def group(table: pa.Table) -> pa.Table:
        labels, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for value, label, _ in _slices(_parts(table)):
            order = np.lexsort((label, value))
            value, label = value[order], label[order]
            # a repeated row of a chosen document gives its postings twice
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (label[1:] != label[:-1])])
            value, label = value[fresh], label[fresh]
            size = np.diff(np.append(_begins(value), len(value)))
            labels.append(label[np.repeat(size > 1, size)])
            sizes.append(size[size > 1])
        return _group_row(table.column("frag")[0].as_py(), np.concatenate(labels), np.concatenate(sizes))

    return rows.mapInArrow(emit, _PACKED).groupBy("frag").applyInArrow(group, _GROUPS)


def _begins(key: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def fragment_labels(table: DataFrame) -> DataFrame:
    """(frag, label, shared) rows of a fragment or segment table."""
    @trimmed_map
    def spread(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                frag = batch.column("frag")[row].as_py()
                label, shared = (_flat(batch.column(c).slice(row, 1), t) for c, t in (("label", np.int64), ("shared", "<u4")))
                for i in range(0, len(label), AT_ONCE):
                    part = label[i:i + AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), frag, np.int32)), pa.array(part),
                         pa.array(shared[i:i + AT_ONCE].astype(np.int64))], names=["frag", "label", "shared"])

    return table.select("frag", "label", "shared").mapInArrow(spread, "frag int, label long, shared long")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _postings(fragment: pa.Table, known: pa.Table):
    """Postings of a fragment that belong to labels in ``known``: group number and place in the fragment's labels;
    and c, n and s by place."""
    label = _flat(fragment.column("label"), np.int64)
    names = known.column("label").to_numpy()
    order = np.argsort(names)
    at = np.searchsorted(names[order], label)
    at = order[np.minimum(at, len(names) - 1)]
    alive = names[at] == label
    c, n, s = (known.column(x).to_numpy()[at] for x in ("c", "n", "s"))
    groups, member = _flat(fragment.column("groups"), "<u4"), _flat(fragment.column("member"), "<u4")
    keep = alive[member]
    return label, np.repeat(np.arange(len(groups), dtype=np.uint32), groups)[keep], member[keep], c, n, s


def _across(group: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Postings in groups that hold more than one component."""
    if not len(group):
        return np.zeros(0, bool)
    begin = _begins(group)
    low, high = np.minimum.reduceat(c, begin), np.maximum.reduceat(c, begin)
    return np.repeat(low != high, np.diff(np.append(begin, len(group))))


_SENT = "frag int, segment binary, groups binary, label binary"
_SENT_ARROW = pa.schema([("frag", pa.int32()), *[(x, pa.binary()) for x in ("segment", "groups", "label")]])


def to_segments(fragments: int, per_fragment: int):
    """Shared shingles of a fragment of the hash order, sent to the fragments of the refined one."""
    @trimmed
    def send(fragment: pa.Table, known: pa.Table) -> pa.Table:
        if not fragment.num_rows or not known.num_rows:
            return _SENT_ARROW.empty_table()
        label, group, member, c, n, s = _postings(fragment, known)
        wide = _across(group, member)
        group, member = group[wide], member[wide]
        if not len(group):
            return _SENT_ARROW.empty_table()
        with np.errstate(over="ignore"):
            tie = mixed(label.astype(np.uint64))
        order = np.lexsort((tie, -(32 * s // np.maximum(n, 1))))
        place = np.empty(len(label), np.uint32)
        place[order] = np.arange(len(label))
        begin = _begins(group)
        size = np.diff(np.append(begin, len(group)))
        anchor = np.minimum.reduceat(place[member], begin)
        # the hash order spreads an anchor's shingles evenly, so its part here tells its whole size; tasks that
        # cut an anchor differently only make more segments
        part = np.bincount(anchor, weights=size, minlength=len(label)) * fragments / per_fragment
        pieces = (2 ** np.ceil(np.log2(np.maximum(part, 1)))).astype(np.int64)[anchor]
        with np.errstate(over="ignore"):
            piece = (fragment.column("frag")[0].as_py() * pieces // fragments + pieces).astype(np.uint64)
            segment = mixed(label[order[anchor]].astype(np.uint64) + piece * _STEP)
        to = fragment_of(mixed(segment + _STEP), fragments)
        by = np.argsort(to, kind="stable")
        reached, cuts = np.unique(to[by], return_index=True)
        rows = []
        for f, at in zip(reached.tolist(), np.split(by, cuts[1:])):
            whose = label[member[_ranges(begin[at], size[at])]]
            rows.append((f, segment[at].tobytes(), size[at].astype("<u4").tobytes(), whose.tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _SENT_ARROW.types)], schema=_SENT_ARROW)

    return send


@trimmed
def segment_row(table: pa.Table) -> pa.Table:
    """The row of a fragment of the refined order."""
    segment, size, label = (
        _flat(table.column(c), t) for c, t in (("segment", np.uint64), ("groups", "<u4"), ("label", np.int64)))
    return _group_row(table.column("frag")[0].as_py(), label, size, segment)


_PAIRS = "a long, b long, na long, nb long, both long"
_NO_PAIRS = pa.schema([(x, pa.int64()) for x in ("a", "b", "na", "nb", "both")])


def _pair_table(label, n, x, y, both) -> pa.Table:
    swap = label[x] > label[y]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    return pa.table([pa.array(v, pa.int64()) for v in (label[a], label[b], n[a], n[b], both)], schema=_NO_PAIRS)


def _fits(n: np.ndarray, s: np.ndarray, x, y) -> np.ndarray:
    """Whether overlaps as large as the shared shingles ``s`` of both allow could reach 3/4 of the union."""
    return 7 * np.minimum(s[x], s[y]) >= 3 * (n[x] + n[y])


def _small(group, loc, place, member, c, n, s, leaders):
    """(pair of locs, overlap) of the leaders with later classes; shingle by shingle."""
    count = len(place)
    order = np.lexsort((place[loc], group))
    group, loc = group[order], loc[order]
    begin = _begins(group)
    within = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
    pair, both = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(min(leaders, int(within.max(initial=0)))):
        after = np.flatnonzero(within > k)
        x, y = loc[after - within[after] + k], loc[after]
        u, v = member[x], member[y]
        fits = (place[x] < leaders) & (c[u] != c[v]) & _fits(n, s, u, v)
        found, often = np.unique(x[fits] * count + y[fits], return_counts=True)
        pair, at = np.unique(np.concatenate([pair, found]), return_inverse=True)
        both = np.bincount(at, weights=np.concatenate([both, often]), minlength=len(pair)).astype(np.int64)
    return pair // count, pair % count, both


#: numbers in the larger of two blocks that are multiplied
DENSE = 4_000_000


def _large(group, loc, members, place, member, c, n, s, rest, leaders, block=512):
    """The same for one segment of many classes (``members``, by place), by products of blocks of its 0/1 matrix."""
    columns, column = np.unique(group, return_inverse=True)
    block = max(16, min(block, DENSE // (4 * len(columns))))
    order = np.argsort(place[loc], kind="stable")
    column, cuts = column[order], np.searchsorted(place[loc][order], np.arange(len(members) + 1))

    def dense(places):
        out = np.zeros((len(places), len(columns)), np.float32)
        size = cuts[places + 1] - cuts[places]
        out[np.repeat(np.arange(len(places)), size), column[_ranges(cuts[places], size)]] = 1
        return out

    of = member[members]
    if leaders < len(members):
        rows = np.arange(leaders)
    else:
        # a pair inside the largest component need not be looked at
        names, often = np.unique(c[of], return_counts=True)
        rows = np.flatnonzero(c[of] != names[often.argmax()])
    is_row = np.zeros(len(members), bool)
    is_row[rows] = True
    found = []
    for j in range(0, len(members), 4 * block):
        cols = np.arange(j, min(j + 4 * block, len(members)))
        right = dense(cols).T
        for i in range(0, len(rows), block):
            part = rows[i:i + block]
            both = dense(part) @ right
            x, y = of[part][:, None], of[cols][None]
            other = np.minimum(rest[members[part]][:, None], rest[members[cols]][None])
            pick = (c[x] != c[y]) & (both > 0) & (7 * (both + other) >= 3 * (n[x] + n[y])) & (~is_row[cols][None] | (part[:, None] < cols[None]))
            u, v = np.nonzero(pick)
            found.append((members[part[u]], members[cols[v]], both[u, v].astype(np.int64)))
    return [np.concatenate(f) if found else np.zeros(0, np.int64) for f in (zip(*found) if found else [()] * 3)]


def _by_segment(segment: np.ndarray, group: np.ndarray, member: np.ndarray, at_once: int | None = None):
    """(segment, group, member) of the postings, some whole segments after others, about ``at_once`` postings in each;
    ``segment`` is that of a group."""
    size = np.bincount(group, minlength=len(segment))
    start = np.cumsum(size) - size
    by = np.argsort(segment, kind="stable")
    before = np.cumsum(size[by]) - size[by]
    first = _begins(segment[by])
    cuts = first[_begins(before[first] // (at_once or AT_ONCE))]
    for some in np.split(by, cuts[1:]):
        at = _ranges(start[some], size[some])
        if len(at):
            yield np.repeat(segment[some], size[some]), group[at], member[at]


def _overlaps(segment, group, member, tie, c, n, s, salt, leaders):
    """(two places in the fragment's labels, overlap) of pairs in some segments that may reach 3/4, segment by segment."""
    # a loc is a class in a segment
    names, loc, size = np.unique(segment * len(c) + member, return_inverse=True, return_counts=True)
    # segments without a living posting leave no gap in the numbers
    at, of = np.unique(names // len(c), return_inverse=True)[1], names % len(c)
    rest = s[of] - size
    order = np.lexsort((tie[of], tie[of] if salt else -size / np.maximum(n[of], 1), at))
    begin = _begins(at)
    many = np.diff(np.append(begin, len(at)))
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at)) - np.repeat(begin, many)
    wide = _across(group, c[member])
    group, loc = group[wide], loc[wide]
    top = len(at) if leaders is None else leaders
    large = many[at[loc]] > SMALL if len(loc) else np.zeros(0, bool)
    x, y, both = _small(group[~large], loc[~large], place, of, c, n, s, min(top, SMALL))
    pass_ = 7 * (both + np.minimum(rest[x], rest[y])) >= 3 * (n[of[x]] + n[of[y]])
    found = [(x[pass_], y[pass_], both[pass_])]
    for k in np.unique(at[loc[large]]):
        here = large & (at[loc] == k)
        found.append(_large(group[here], loc[here], order[begin[k]:begin[k] + many[k]], place, of, c, n, s, rest, top))
    x, y, both = (np.concatenate(f) for f in zip(*found))
    return of[x], of[y], both


def overlaps(salt: int, leaders: int | None):
    """Partial overlaps, segment by segment, of pairs of different components that may reach 3/4: those of each
    segment's leaders, or all (``leaders`` None)."""
    @trimmed
    def count(fragment: pa.Table, known: pa.Table) -> pa.Table:
        if not fragment.num_rows or not known.num_rows:
            return _NO_PAIRS.empty_table()
        label, group, member, c, n, s = _postings(fragment, known)
        with np.errstate(over="ignore"):
            tie = mixed(label.astype(np.uint64) + np.uint64(salt) * _STEP)
        segment = np.unique(_flat(fragment.column("segment"), np.uint64), return_inverse=True)[1]
        found = [[np.zeros(0, np.int64)] * 3]
        for part in _by_segment(segment, group, member):
            found.append(_overlaps(*part, tie, c, n, s, salt, leaders))
        x, y, both = (np.concatenate(f) for f in zip(*found))
        pair, at = np.unique(np.minimum(x, y) * len(label) + np.maximum(x, y), return_inverse=True)
        both = np.bincount(at, weights=both, minlength=len(pair)).astype(np.int64)
        return _pair_table(label, n, pair // max(len(label), 1), pair % max(len(label), 1), both)

    return count


def _links(partial: DataFrame) -> DataFrame:
    """Pairs whose summed overlaps reach 3/4 of the union."""
    return (
        partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
        .where("100 * both >= 75 * (na + nb - both)").select("a", "b")
    )


def _total(table: DataFrame) -> int:
    """Shingles of all sets."""
    with freed(table.sparkSession):
        return table.agg(F.sum("n")).first()[0] or 0


def class_components(docs: DataFrame, table: DataFrame, per_fragment: int, rounds: int = 3, leaders: int = LEADERS) -> DataFrame:
    """(label, c): component of every class that has links; ``c`` is the smallest label in it."""
    # one class per signature; its first row by key stands for it
    classes = written(
        table.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("_key").alias("_key"))
        .select(F.col("s1").alias("label"), "n", "_key"))
    total = _total(table)
    # a prefix has three eighths of a set
    found = candidates(docs, max(FRAGMENTS, -(-3 * total // (8 * per_fragment))))
    chosen = table_of(classes.join(found, "label").where(F.col("shared") >= least_shared()).drop("shared"), slim=True)
    fragments = max(FRAGMENTS, -(-_total(chosen) // per_fragment))
    hashed = table_of(fragment_table(docs, chosen, fragments), slim=True)

    def sharing(table, classes):
        """Labels by fragment, and the classes that share enough of their shingles."""
        reach = written(fragment_labels(table), slim=True)
        shared = reach.groupBy("label").agg(F.sum("shared").alias("s"))
        alive = classes.select("label", "n").join(shared, "label").where("4 * s >= 3 * n")
        return reach, written(alive.withColumn("c", F.col("label")))

    def met(table, reach, function, schema):
        known = reach.select("frag", "label").join(state, "label")
        return table.groupBy("frag").cogroup(known.groupBy("frag")).applyInArrow(function, schema)

    reach, state = sharing(hashed, chosen)
    sent = met(hashed, reach, to_segments(fragments, per_fragment), _SENT)
    segments = table_of(sent.groupBy("frag").applyInArrow(segment_row, _GROUPS), slim=True)
    reach, state = sharing(segments, state)
    for salt, most in [*((r, leaders) for r in range(rounds)), (rounds, None)]:
        links = table_of(_links(met(segments, reach, overlaps(salt, most), _PAIRS)), slim=True)
        with freed(links.sparkSession):
            none = links.isEmpty()
        if none:
            continue
        grown = components(state.select(F.col("label").alias("id"), "c"), links)
        state = written(state.drop("c").join(grown.withColumnRenamed("id", "label"), "label"))
    return state.select("label", "n", "c")


def grouped(docs: DataFrame, per_fragment: int = 1_000_000, rounds: int = 3, leaders: int = LEADERS) -> DataFrame:
    """(_key, doc_id, n_shingles, component_id) for every row."""
    table = table_of(sets(docs), slim=True)
    state = class_components(docs, table, per_fragment, rounds, leaders)
    named = table.join(state.select(F.col("label").alias("s1"), "n", "c"), ["s1", "n"], "left").select(
        "_key", "doc_id", "n",
        # a class without links is a component of its own; an empty set is one per row
        F.when(F.col("n") == 0, F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
        .when(F.col("c").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("c").alias("a"), F.lit(0).cast("long").alias("b")))
        .otherwise(F.struct(F.lit(2).alias("k"), F.col("s1").alias("a"), F.col("s2").alias("b"))).alias("_group"))
    named = table_of(named)
    least = named.where("n > 0").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    return named.join(least, "_group", "left").select(
        "_key", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "_group")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Documents that stand for their group (smallest id; nulls last), and all without words."""
    rows = grouped(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_key").alias("k"))
    first = rows.where("n_shingles > 0").groupBy("_group").agg(F.min(order).alias("_first")).select(F.col("_first.k").alias("_key"))
    empty = rows.where("n_shingles = 0").select("_key")
    stay = first.union(empty).distinct()
    whole = wrapped(docs).withColumn("_key", row_key()).repartition("_key").dropDuplicates(["_key"])
    return unwrapped(whole.join(stay, "_key", "left_semi"), docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
