"""Language-model scores under a Katz backoff model.

Tokens are words (A-Z lower-cased) and one end per text; the history of a token is the word before it, or the start.
Bigram and unigram counts of the training texts are discounted after Good and Turing (Katz's form, counts up to ``K``, counts
of counts smoothed by a log-linear fit); a level without any type seen once or without any seen twice has no such estimate and
keeps back half a count per type instead. What a history keeps back is spread over the words not seen after it in proportion
to their unigram probabilities,

    p(w | v) = d(c(v,w)) c(v,w) / (c(v) + 1)      if the bigram was seen
             = backoff(v) p(w)                    otherwise; p(w) alone after an unknown history
    p(w)     = d(c(w)) c(w) / (N + 1), the rest for the one unknown word,

with ``backoff`` normalised exactly per history (the added one leaves every history some mass). A token is evaluated
down this recursion until it finds a count.

The counts and the tokens that ask for them meet once. Each task sorts the bigrams of its texts and sends them, packed,
to a bucket chosen by history; there a history's counts are complete and most tokens are settled. Bigrams that were
never seen, and the followers of their histories, travel on to buckets by word for p(w), and by history for the backoff;
sums return per task and text. Histories with more than a quarter of a bucket of tokens are dealt by the whole bigram,
with their counts at hand (at most four such words per bucket). The tables between the steps are written to
the shared folder, partitioned by bucket, so a lost executor costs only what it was doing.

Words are 64-bit hashes. Defined cases: null text -- empty, one token; null id -- a training text; repeated rows
count and score as often as they occur; no training texts -- every word unknown; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecensus.llm.common import documents, hashed_words, mixed, table, text_of
from codecensus.llm.ngram_join import fragment_of, portions

K = 5
#: bytes of text whose bigrams are sorted and sent together
SENT_AT_ONCE = 6_000_000
#: bigrams of a bucket that are settled together, but for a history with more
SETTLED_AT_ONCE = 500_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
UNKNOWN = np.uint64(0)
_STEP = np.uint64(0xA0761D6478BD642F)
_TABLE = "kind int, dest int, batch long, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("batch", pa.int64()), *[(x, pa.binary()) for x in "abcde"]])
SUMS, HEAD, STATS, WORDS, FOLLOWERS, UNSEEN, HISTORY, MASS, LATE, ASKING = range(10)


def _pressed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _coded(x: np.ndarray) -> bytes:
    """64-bit values as their distinct ones and a place for each, for arrays with many repeats."""
    names, place = np.unique(x, return_inverse=True)
    place = place.astype("<u2" if len(names) <= 1 << 16 else "<u4")
    head = np.array([len(names), place.itemsize], "<u4").tobytes()
    return zstandard.compress(head + names.tobytes() + place.tobytes(), 3)


def _uncoded(value: bytes, dtype) -> np.ndarray:
    raw = zstandard.decompress(value)
    count, width = np.frombuffer(raw, "<u4", 2)
    names = np.frombuffer(raw, dtype, count, 8)
    return names[np.frombuffer(raw, f"<u{width}", -1, 8 + 8 * int(count))] if count else names


def _row(kind: int, dest: int, batch: int, *arrays) -> tuple:
    """Arrays are packed; values that are packed already stay."""
    packed = [x if isinstance(x, bytes) else _pressed(x) for x in arrays]
    return (kind, dest, batch, *packed, *[None] * (5 - len(arrays)))


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def _read(value: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value), dtype)


def _rows(table: pa.Table, kind: int):
    return table.filter(pc.equal(table.column("kind"), kind)).to_pylist()


def _joined(rows: list[dict], column: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[_read(r[column], dtype) for r in rows]])


def _joined_coded(rows: list[dict], column: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[_uncoded(r[column], dtype) for r in rows]])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lookup(names: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values by ascending names; 0 for others."""
    if not len(names):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[at] == asked, values[at], 0)


def bucket_of(v: np.ndarray, w: np.ndarray | None, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by ``v``; words in ``hot`` are dealt by both."""
    by_v = fragment_of(mixed(v + _STEP), buckets)
    if w is None or not len(hot):
        return by_v
    at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
    return np.where(hot[at] == v, fragment_of(mixed(v * _STEP + w), buckets), by_v)


def frequent_words(docs: DataFrame, buckets: int) -> list[int]:
    """Words that make up a quarter of a bucket or more, by sums of what is that frequent in a portion."""
    def count(batches):
        for _, _, texts in portions(batches):
            words, n = np.unique(hashed_words(texts)[0], return_counts=True)
            often = n >= max(1, n.sum() // (4 * buckets))
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # at most four words can fill a quarter of each bucket
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(4 * buckets).collect()]


def training_counts(docs: DataFrame, hot: list[int]) -> dict[int, int]:
    """Exact training counts of the frequent words, and of all "words" and "texts"."""
    names = np.sort(np.array(hot, np.int64).view(np.uint64))

    def count(batches):
        total = np.zeros(len(names) + 2, np.int64)
        for batch, first, texts in portions(batches):
            train = ~np.array(batch.column("held").slice(first, len(texts)).to_pylist(), bool)
            kept = [t for t, yes in zip(texts, train) if yes]
            words, _ = hashed_words(kept)
            total[-2:] += len(words), len(kept)
            if len(names):
                at = np.minimum(np.searchsorted(names, words), len(names) - 1)
                total[:-2] += np.bincount(at[names[at] == words], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

    sums = dict(map(tuple, docs.select("text", "held").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n")).collect()))
    out = {int(w): sums.get(i, 0) for i, w in enumerate(names.view(np.int64))}
    return out | {"words": sums.get(len(names), 0), "texts": sums.get(len(names) + 1, 0)}


_PACKED = "bucket int, batch long, head binary, train binary, v binary, types binary, w binary, texts binary, text binary, n binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(x, pa.binary()) for x in (
    "head", "train", "v", "types", "w", "texts", "text", "n")]])


def _bigrams(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Bigrams of every portion of texts, sorted and packed, one row per bucket."""
    def emit(batches):
        task = TaskContext.get().partitionId()
        # the larger a portion, the fewer times a word's hash is sent
        for number, (batch, first, texts) in enumerate(portions(batches, portion=SENT_AT_ONCE)):
            part = batch.slice(first, len(texts))
            held = np.array(part.column("held").to_pylist(), bool)
            words, counts = hashed_words(texts)
            ends = np.cumsum(counts)
            v, w = np.insert(words, ends - counts, START), np.insert(words, ends, END)
            text = np.repeat(np.arange(len(texts)), counts + 1)
            bucket = bucket_of(v, w, hot, buckets)
            order = np.lexsort((w, v, bucket))
            v, w, text, bucket = v[order], w[order], text[order], bucket[order]
            each = _starts(bucket, v, w, text)
            n = np.diff(np.append(each, len(v)))
            v, w, text, bucket = v[each], w[each], text[each], bucket[each]
            ids = part.column("doc_id")
            head = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                             held.astype(np.int64), counts]).tobytes()
            rows = []
            for begin, end in zip(at := _starts(bucket), [*at[1:], len(bucket)]):
                a, b = v[begin:end], w[begin:end]
                kinds = _starts(a, b)
                runs = _starts(a[kinds])
                rows.append((
                    bucket[begin], (task << 32) + number, head if not rows else None, _pressed(np.packbits(~held)), _pressed(a[kinds][runs]),
                    _pressed(np.diff(np.append(runs, len(kinds))).astype("<u4")), _coded(b[kinds]), *map(_pressed, (
                        np.diff(np.append(kinds, len(a))).astype("<u4"), text[begin:end].astype("<u2"), n[begin:end].astype("<u4")))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED_ARROW.types)], schema=_PACKED_ARROW)

    return docs.mapInArrow(emit, _PACKED)


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1:K + 2]


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; the list no longer holds them."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _settle(buckets: int, hot: np.ndarray, hot_counts: np.ndarray):
    """Step at the history's bucket."""
    def settle(group: pa.Table) -> pa.Table:
        out, v, w, text, n, train, batches = [], [], [], [], [], [], []
        for i, r in enumerate(group.to_pylist()):
            if r["head"]:
                out.append((HEAD, 0, r["batch"], r["head"], None, None, None, None))
            batches.append(r["batch"])
            texts = _read(r["texts"], "<u4")
            v.append(np.repeat(np.repeat(_read(r["v"], np.uint64), _read(r["types"], "<u4")), texts))
            w.append(np.repeat(_uncoded(r["w"], np.uint64), texts))
            place = _read(r["text"], "<u2").astype(np.int64)
            train.append(np.unpackbits(_read(r["train"], np.uint8)).astype(bool)[place])
            text.append(place + (i << 16))
            n.append(_read(r["n"], "<u4"))
        columns = [_emptied(x) for x in (v, w, text, n, train)]
        order = np.lexsort((columns[1], columns[0]))
        for i, x in enumerate(columns):
            columns[i] = x[order]
        del order, x
        who, inverse = np.unique(columns[2], return_inverse=True)
        base, logs, known, small = np.zeros(len(who)), np.zeros(len(who)), np.zeros(len(who)), np.zeros((len(who), K))
        # a history stays whole; what is computed beside the sorted arrays grows with a slice only
        runs = _starts(columns[0])
        cuts = runs[np.unique(np.searchsorted(runs, np.arange(0, len(inverse), SETTLED_AT_ONCE)).clip(max=len(runs) - 1))]
        for begin, end in zip(cuts, [*cuts[1:], len(inverse)]):
            sums = histories(out, batches, *[x[begin:end] for x in columns], inverse[begin:end], len(who))
            for total, x in zip((base, logs, known, small), sums):
                total += x
        cuts = _starts(who >> 16)
        for begin, end in zip(cuts, [*cuts[1:], len(who)]):
            out.append(_row(SUMS, 0, batches[who[begin] >> 16], (who[begin:end] & 0xFFFF).astype("<u2"), base[begin:end], logs[begin:end],
                            known[begin:end].astype("<u4"), small[begin:end].astype("<u4")))
        return _table(out)

    def histories(out, batches, v, w, text, n, train, inverse, texts):
        """Adds what the histories in ``v`` have to tell to ``out``; returns their sums per text."""
        n = n.astype(np.int64)
        kinds = _starts(v, w)
        size = np.diff(np.append(kinds, len(v)))
        both = np.add.reduceat(n * train, kinds)
        tv, tw = v[kinds], w[kinds]
        runs = _starts(tv)
        names = tv[runs]
        followers = np.diff(np.append(runs, len(tv)))
        is_hot = np.isin(names, hot)
        count = np.where(is_hot, _lookup(hot, hot_counts, names), np.add.reduceat(both, runs))
        tc = np.repeat(count, followers)
        # sums per text
        c, r = np.repeat(tc, size), np.repeat(both, size)
        word = v != START
        seen = r > 0
        add = lambda x: np.bincount(inverse, weights=x, minlength=texts)
        base, known = add(n * np.log10(c + 1.0) * word), add(n * (c > 0) * word)
        logs = add(np.where(seen, n * (np.log10(np.maximum(r, 1)) - np.log10(c + 1.0)), 0.0))
        small = np.stack([add(n * (r == k)) for k in range(1, K + 1)], axis=1)
        del r, word
        # numbers that the whole model needs
        own = ~is_hot & (count > 0)
        out.append(_row(STATS, 0, 0, np.concatenate([_count_of_counts(both[both > 0]), _count_of_counts(count[own]), [own.sum()]]).astype(np.int64)))
        by_word = bucket_of(names[own], None, hot, buckets)
        for d in np.unique(by_word):
            out.append(_row(WORDS, d, 0, names[own][by_word == d], count[own][by_word == d]))
        # what is not settled here: unseen bigrams, and the followers of their histories
        late = ~seen
        asked = np.unique(v[late & (c > 0)])
        active = is_hot | np.isin(names, asked)
        some = np.repeat(active, followers) & (both > 0)
        to = bucket_of(tw[some], tv[some], hot, buckets)
        for d in np.unique(to):
            out.append(_row(FOLLOWERS, d, 0, _coded(tv[some][to == d]), _coded(tw[some][to == d])))
        lv, lw, lt, ln = np.where(c[late] > 0, v[late], UNKNOWN), w[late], text[late], n[late]
        to = bucket_of(lw, lv, hot, buckets)
        for d in np.unique(to):
            at = to == d
            out.append(_row(UNSEEN, d, 0, _coded(lv[at]), _coded(lw[at]), _coded(np.array(batches)[lt[at] >> 16]),
                            (lt[at] & 0xFFFF).astype("<u2"), ln[at].astype("<u4")))
        few = np.stack([np.add.reduceat((both == k).astype(np.int64), runs) for k in range(1, K + 1)], axis=1)
        rest = np.add.reduceat(np.where(both > K, both, 0), runs)
        to = bucket_of(names[active], None, hot, buckets)
        for d in np.unique(to):
            at = np.flatnonzero(active)[to == d]
            out.append(_row(HISTORY, d, 0, names[at], count[at], few[at], rest[at]))
        return base, logs, known, small

    return settle


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1..K) from the numbers n of types seen 1..K+1 times; d of larger counts is 1.

    Katz's d with the numbers smoothed first, as in simple Good-Turing: each non-zero number is averaged over the gap around
    it and a line is fitted to its logarithm over log r. With n(r) ~ r ** slope, (r + 1) n(r+1) / (r n(r)) is
    (1 + 1/r) ** (slope + 1) and Katz's share (K + 1) ** (slope + 1), so every d lies in (0, 1) whatever the slope is.
    """
    n = np.asarray(n, float)
    r = np.arange(1, K + 1)
    if not n[0] or not n[1]:
        # no line without types seen once and twice: half a count is kept back
        return (r - 0.5) / r
    seen = np.flatnonzero(n) + 1
    before, after = np.append(0, seen[:-1]), np.append(seen[1:], 2 * seen[-1] - seen[-2])
    x, y = np.log(seen), np.log(2 * n[seen - 1] / (after - before))
    x -= x.mean()
    power = (x * y).sum() / (x * x).sum() + 1
    top, step = np.log(K + 1), np.log1p(1 / r)
    if abs(power) < 1e-9:
        return 1 - step / top
    return (np.expm1(power * top) - np.expm1(power * step)) / np.expm1(power * top)


def _word_probability(counts: np.ndarray, model: dict) -> np.ndarray:
    d = np.concatenate([[0.0], model["word_discounts"], [1.0]])
    p = d[np.minimum(counts, K + 1)] * counts / (model["tokens"] + 1)
    return np.where(counts > 0, p, model["unknown"])


def _per_text(kind: int, batch: np.ndarray, text: np.ndarray, value: np.ndarray) -> list[tuple]:
    order = np.lexsort((text, batch))
    batch, text, value = batch[order], text[order], value[order]
    each = _starts(batch, text)
    if not len(each):
        return []
    value, batch, text = np.add.reduceat(value, each), batch[each], text[each]
    cuts = _starts(batch)
    return [_row(kind, 0, batch[a], text[a:b].astype("<u2"), value[a:b]) for a, b in zip(cuts, [*cuts[1:], len(batch)])]


def _by_word(model: dict):
    def look(group: pa.Table) -> pa.Table:
        rows = _rows(group, WORDS)
        names, counts = _joined(rows, "a", np.uint64), _joined(rows, "b", np.int64)
        names, counts = np.concatenate([names, model["hot"]]), np.concatenate([counts, model["hot_counts"]])
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        out = []
        rows = _rows(group, FOLLOWERS)
        v, w = _joined_coded(rows, "a", np.uint64), _joined_coded(rows, "b", np.uint64)
        histories, at = np.unique(v, return_inverse=True)
        mass = np.bincount(at, weights=_word_probability(_lookup(names, counts, w), model), minlength=len(histories))
        to = bucket_of(histories, None, model["hot"], model["buckets"])
        out += [_row(MASS, d, 0, histories[to == d], mass[to == d]) for d in np.unique(to)]
        rows = _rows(group, UNSEEN)
        v, w, batch = (_joined_coded(rows, k, t) for k, t in zip("abc", (np.uint64, np.uint64, np.int64)))
        text, n = (_joined(rows, k, t) for k, t in zip("de", ("<u2", "<u4")))
        out += _per_text(LATE, batch, text, n * np.log10(_word_probability(_lookup(names, counts, w), model)))
        asking = v != UNKNOWN
        to = np.where(asking, bucket_of(v, None, model["hot"], model["buckets"]), -1)
        out += [_row(ASKING, d, 0, _coded(v[to == d]), _coded(batch[to == d]), text[to == d], n[to == d]) for d in np.unique(to[asking])]
        return _table(out)

    return look


def backoff(few: np.ndarray, rest: np.ndarray, count: np.ndarray, mass: np.ndarray, model: dict) -> np.ndarray:
    """What the discounts leave over what the unseen words have."""
    kept = (few * (np.arange(1, K + 1) * model["pair_discounts"])).sum(axis=1) + rest
    return (1 - kept / (count + 1)) / (1 - mass)


def _by_history(model: dict):
    def look(group: pa.Table) -> pa.Table:
        rows = _rows(group, HISTORY)
        v, count, rest = _joined(rows, "a", np.uint64), _joined(rows, "b", np.int64), _joined(rows, "d", np.int64)
        few = _joined(rows, "c", np.int64).reshape(-1, K)
        names, at = np.unique(v, return_inverse=True)
        total = np.zeros((len(names), K), np.int64)
        np.add.at(total, at, few)
        every = np.zeros(len(names), np.int64)
        every[at] = count
        larger = np.bincount(at, weights=rest, minlength=len(names))
        rows = _rows(group, MASS)
        mv, mass = _joined(rows, "a", np.uint64), _joined(rows, "b", np.float64)
        known = np.isin(mv, names)
        covered = np.bincount(np.searchsorted(names, mv[known]), weights=mass[known], minlength=len(names))
        logs = np.log10(backoff(total, larger, every, covered, model))
        rows = _rows(group, ASKING)
        v, batch = (_joined_coded(rows, k, t) for k, t in zip("ab", (np.uint64, np.int64)))
        text, n = (_joined(rows, k, t) for k, t in zip("cd", ("<u2", "<u4")))
        return _table(_per_text(LATE, batch, text, n * _lookup(names, logs, v)))

    return look


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(model: dict):
    def finish(group: pa.Table) -> pa.Table:
        head = np.frombuffer(_rows(group, HEAD)[0]["a"], np.int64).reshape(4, -1)
        size = head.shape[1]
        base, score, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        logs = np.log10(model["pair_discounts"])
        for r in _rows(group, SUMS):
            at = _read(r["a"], "<u2")
            base[at] += _read(r["b"], np.float64)
            score[at] += _read(r["c"], np.float64) + _read(r["e"], "<u4").reshape(-1, K) @ logs
            known[at] += _read(r["d"], "<u4")
        for r in _rows(group, LATE):
            score[_read(r["a"], "<u2")] += _read(r["b"], np.float64)
        tokens = head[3] + 1
        base += np.log10(model["texts"] + 1.0) - tokens * np.log10(model["tokens"] + model["types"] + 1.0)
        return pa.table({
            "doc_id": pa.array(head[0], pa.int64(), mask=head[1].astype(bool)), "held_out": pa.array(head[2].astype(bool)),
            "n_tokens": pa.array(tokens), "n_known": pa.array(known + (model["texts"] > 0)),
            "train_tokens": pa.array(np.full(size, model["tokens"], np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    return finish


def scored(docs: DataFrame, held_out, per_bucket: int = 3_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; the model learns from
    the rows where ``held_out`` (a column) is false. ``per_bucket``: tokens that a bucket is planned for."""
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(4, -(-characters // (6 * per_bucket))))
    counts = training_counts(rows, frequent_words(rows, buckets))
    words, texts = counts.pop("words"), counts.pop("texts")
    hot = np.array([*counts, *np.array([START, END]).view(np.int64)], np.int64).view(np.uint64)
    hot_counts = np.array([*counts.values(), texts, texts], np.int64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]

    first = table(_bigrams(rows, hot, buckets).groupBy("bucket").applyInArrow(_settle(buckets, hot, hot_counts), _TABLE))
    stats = [_read(bytes(r.a), np.int64) for r in first.where(F.col("kind") == STATS).select("a").toLocalIterator()]
    stats = sum(stats, np.zeros(2 * (K + 1) + 1, np.int64))
    special = hot_counts[hot != START]
    word_counts = stats[K + 1:2 * (K + 1)] + _count_of_counts(special[special > 0])
    model = {
        "buckets": buckets, "hot": hot, "hot_counts": np.where(hot == START, 0, hot_counts), "texts": texts, "tokens": words + texts,
        "types": int(stats[-1] + (special > 0).sum()), "pair_discounts": discounts(stats[:K + 1]), "word_discounts": discounts(word_counts),
    }
    # the unknown word has what the discounts of all others leave
    left = (word_counts[:K] * np.arange(1, K + 1) * (1 - model["word_discounts"])).sum() + 1
    model["unknown"] = float(left / (model["tokens"] + 1))

    second = table(first.where(F.col("kind").isin(WORDS, FOLLOWERS, UNSEEN)).groupBy("dest").applyInArrow(_by_word(model), _TABLE))
    third = (
        first.where(F.col("kind") == HISTORY).union(second.where(F.col("kind").isin(MASS, ASKING)))
        .groupBy("dest").applyInArrow(_by_history(model), _TABLE))
    parts = first.where(F.col("kind").isin(SUMS, HEAD)).union(second.where(F.col("kind") == LATE)).union(third)
    return parts.groupBy("batch").applyInArrow(_finish(model), _OUT)


def op2(spark, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return scored(documents(spark, sf_dir), remainder == 2)
