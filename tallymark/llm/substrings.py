"""Removal of repeated passages by recompression.

Recompression: a text is a row of symbols, at first its words. Each round names maximal runs of
one symbol, then splits all symbols into left and right ones by a bit of their name and names
each pair of a left and a right neighbour. Names are made from the names of the parts alone, so
they are the same in every document, and equal substrings get equal symbols in their interior:
with each symbol goes its reach, the stretch of words that its parse depends on, and wherever
those words stand the symbol stands.

Of the symbols whose reach lies inside a window of ``window_words`` words, those of the highest
round are taken and of these the one of least name; the digest of its reach is the window's key.
Equal windows have equal keys, and neighbouring windows mostly share one, so keys are far fewer
than windows. A window in which no symbol's reach fits has its own digest as key.

Spark joins the documents' work in three steps, each on groups of neighbouring documents that
are kept, compressed, in a checkpoint. A text that a smaller doc_id has as well, as a whole,
takes part in none of them: all its windows are repeats, and the first copy speaks for them.
1. every group lists its keys once; keys listed by several groups, or by several documents of
   one, are shared;
2. windows with a shared key are verified: their 128-bit digests are listed once a group with
   the smallest and largest doc_id there, and the smallest doc_id of all groups is found;
3. each group marks the words of windows that also start in a smaller doc_id.
A key or window of very many documents counts once for each group that has it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm._common import durable, map_slices, text_columns, utf8

WINDOW_WORDS = 13
ROUNDS = 2
#: A group of documents ends at this many bytes of text.
GROUP_BYTES = 1 << 20
#: Words whose names a task keeps.
NAMES_KEPT = 300_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xD6E8FEB86659FD93
_NO_KEY = _U(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Names:
    """128-bit names of words, the most recent ones kept."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.empty((1 << 12, 2), _U)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two columns of 64-bit names."""
        if len(self.number) > NAMES_KEPT:
            self._reset()
        number = self.number
        if new := list(set(words).difference(number)):
            first, end = len(number), len(number) + len(new)
            while end > len(self.table):
                self.table = np.concatenate((self.table, np.empty_like(self.table)))
            self.table[first:end] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), ">u8").reshape(-1, 2)
            number.update(zip(new, range(first, end), strict=True))
        return self.table[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]


@lru_cache(maxsize=8)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64."""
    return _all_powers(base, max(1 << 16, 1 << (n - 1).bit_length()))[:n]


def _stretches(names: np.ndarray, first: np.ndarray, last: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A digest of names[first:last] for each pair; equal stretches have equal digests anywhere."""
    n = len(names)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(names * _powers(base, n), dtype=_U)))
    back = _powers(pow(base, -1, 1 << 64), n)
    return _mix((sums[last] - sums[first]) * back[np.minimum(first, n - 1)] + (last - first).astype(_U) * _U(_BASE_2))


def _round(name: np.ndarray, left: np.ndarray, right: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and reaches of the symbols after one round of runs and pairs."""
    n = len(name)
    if n < 2:
        return name, left - 99, right + 99
    # Runs: a symbol's neighbours show where its run ends.
    starts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    ends = np.append(starts[1:], n) - 1
    size = (ends - starts + 1).astype(_U)
    seen = name[starts]
    name2 = np.where(size > 1, _mix(seen * _U(3) + size * _U(_BASE) + _U(number)), seen)
    left2 = np.where(starts > 0, left[np.maximum(starts - 1, 0)], -99)
    right2 = np.where(ends < n - 1, right[np.minimum(ends + 1, n - 1)], 1 << 40)
    left2, right2 = np.minimum(left2, left[starts]), np.maximum(right2, right[ends])
    name, left, right, n = name2, left2, right2, len(starts)
    if n < 2:
        return name, left, right
    # Pairs: left symbols join right ones after them; one left alone depends on the neighbour it did not join.
    is_right = (_mix(name + _U(number)) & _U(1)).astype(bool)
    joins = ~is_right[:-1] & is_right[1:]
    head, tail = np.append(joins, False), np.concatenate(([False], joins))
    before_left = np.concatenate(([-99], left[:-1]))
    after_right = np.append(right[1:], 1 << 40)
    partner = np.append(name[1:], _U(0))
    out_name = np.where(head, _mix(_mix(name) * _U(5) + partner + _U(number)), name)
    out_left = np.where(head, left, np.where(is_right, np.minimum(left, before_left), left))
    out_right = np.where(head, np.maximum(right, after_right), np.where(is_right, right, np.maximum(right, after_right)))
    keep = ~tail
    return out_name[keep], out_left[keep], out_right[keep]


def window_keys(names: np.ndarray, window: int = WINDOW_WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """The key of each window of a document's words (their 64-bit names)."""
    n = len(names) - window + 1
    if n < 1:
        return np.zeros(0, _U)
    name, left, right = names, np.arange(len(names)), np.arange(1, len(names) + 1)
    levels = []
    for k in range(1, rounds + 1):
        name, left, right = _round(name, left, right, k)
        levels.append((name, left, right))
    keys = np.full(n, _NO_KEY, _U)
    open_ = np.ones(n, bool)
    for k in range(rounds, 0, -1):
        name, left, right = levels[k - 1]
        fits = (right - left <= window) & (left >= 0) & (right <= len(names))
        name, left, right = name[fits], left[fits], right[fits]
        if not len(name):
            continue
        # Windows p with right - window <= p <= left hold the symbol's reach.
        first, last = np.maximum(right - window, 0), np.minimum(left, n - 1)
        still = np.concatenate(([0], np.cumsum(open_)))
        wanted = (last >= first) & (still[np.maximum(last, first - 1) + 1] > still[first])
        name, left, right, first, last = name[wanted], left[wanted], right[wanted], first[wanted], last[wanted]
        if not len(name):
            continue
        many = last - first + 1
        at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        rank = _mix(name + _U(77))
        digest = _stretches(names, left, right) + _U(k)
        # Of least name; between symbols of one name, of the least digest of the reach.
        least = np.full(n, _NO_KEY, _U)
        np.minimum.at(least, at, np.repeat(rank, many))
        mine = np.repeat(rank, many) == least[at]
        found = np.full(n, _NO_KEY, _U)
        np.minimum.at(found, at[mine], np.repeat(digest, many)[mine])
        use = open_ & (least != _NO_KEY)
        keys[use] = found[use]
        open_ &= ~use
    if open_.any():
        at = np.flatnonzero(open_)
        keys[at] = _stretches(names, at, at + window)
    return keys


def window_digests(names: np.ndarray, window: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each window, from the two columns of names."""
    at = np.arange(len(names) - window + 1)
    return _stretches(names[:, 0], at, at + window), _stretches(names[:, 1], at, at + window, _BASE_2)


def _pack(docs: list[tuple[int | None, bytes]]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(docs, protocol=5))


def _unpack(blob: bytes) -> list[tuple[int | None, bytes]]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _groups(docs: DataFrame) -> DataFrame:
    """group, blob, and for each different text its ids, their places in the group and its 128-bit digest: neighbouring documents together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def ended() -> pa.RecordBatch:
            ids: dict[bytes, list[int]] = {}
            places: dict[bytes, list[int]] = {}
            for place, (i, t) in enumerate(held):
                if i is not None:
                    digest = xxhash.xxh3_128_digest(t)
                    ids.setdefault(digest, []).append(i)
                    places.setdefault(digest, []).append(place)
            halves = np.frombuffer(b"".join(ids), ">i8").astype(np.int64).reshape(-1, 2)
            lists = (pa.array([list(x.values())], pa.list_(pa.list_(pa.int64()))) for x in (ids, places))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_pack(held)], pa.binary()), *lists, *(pa.array([x], pa.list_(pa.int64())) for x in halves.T)], ["group", "blob", "ids", "places", "h1", "h2"])

        for b in batches:
            for doc in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                held.append(doc)
                size += len(doc[1]) + 16
                if size >= GROUP_BYTES:
                    yield ended()
                    number, held, size = number + 1, [], 0
        if held:
            yield ended()

    return map_slices(docs, work, "group long, blob binary, ids array<array<long>>, places array<array<long>>, h1 array<long>, h2 array<long>")


def _copies(held: DataFrame) -> DataFrame:
    """group, copies: the places in a group of rows whose whole text a smaller id has too.

    Places, not ids: of two rows of one id with different texts, one can be a copy and the other not.
    A text counts once a group, so one with very many copies has no more rows than there are groups.
    """
    texts = held.select("group", F.explode(F.arrays_zip("ids", "places", "h1", "h2")).alias("t")).select("group", "t.*")
    first = texts.groupBy("h1", "h2").agg(F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last")).filter("first < last")
    later = texts.join(first, ["h1", "h2"]).select("group", F.explode(F.filter("places", lambda _, k: F.get("ids", k) > F.col("first"))).alias("place"))
    return later.groupBy("group").agg(F.collect_list("place").alias("copies"))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


class Row:
    """The words of a group's documents in one row, a separator after each document."""

    def __init__(self, blob: bytes, names: Names, window: int, copies: set[int] | frozenset[int] = frozenset()) -> None:
        """copies: places of rows that are left out, as a smaller id has all their windows; ``copied`` has their words."""
        docs = [(doc_id, text.split()) for doc_id, text in _unpack(blob)]
        out = [place in copies and len(words) >= window for place, (_, words) in enumerate(docs)]
        self.copied = [d for d, left in zip(docs, out, strict=True) if left]
        self.docs = [d for d, left in zip(docs, out, strict=True) if not left]
        if not self.docs:
            self.docs = [(None, [])]
            self.empty = True
        else:
            self.empty = False
        sizes = np.array([len(w) for _, w in self.docs])
        self.ends = np.cumsum(sizes + 1)
        self.names = np.zeros((int(self.ends[-1]), 2), _U)
        is_word = np.ones(len(self.names), bool)
        is_word[self.ends - 1] = False
        self.names[is_word] = names.of([w for _, words in self.docs for w in words])
        # Windows without a separator, of documents with an id.
        n = max(0, len(self.names) - window + 1)
        before = np.concatenate(([0], np.cumsum(~is_word)))
        ok = before[window : window + n] == before[:n]
        self.doc = np.repeat(np.arange(len(self.docs)), sizes + 1)[:n]
        ids = np.array([-1 if i is None else i for i, _ in self.docs], np.int64)
        null = np.array([i is None for i, _ in self.docs])
        self.ids = ids[self.doc]
        self.valid = ok & ~null[self.doc]


def _rows(batch: pa.RecordBatch, names: Names, window: int) -> Iterator[tuple[int, int, Row]]:
    for k, (group, blob) in enumerate(zip(batch.column("group").to_pylist(), batch.column("blob").to_pylist(), strict=True)):
        yield k, group, Row(blob, names, window, frozenset(_array(batch.column("copies"), k).tolist()))


def _list_keys(groups: DataFrame, window: int, rounds: int) -> DataFrame:
    """group, key: every key of a group once. groups: group, blob, copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for b in batches:
            for _, group, row in _rows(b, names, window):
                keys = np.unique(window_keys(row.names[:, 0], window, rounds)[row.valid])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), group), pa.int64()), _longs(keys)], ["group", "key"])

    return map_slices(groups, work, "group long, key long")


def _list_windows(groups: DataFrame, window: int, rounds: int) -> DataFrame:
    """group, d1, d2, least, most: every window with a shared key once a group. groups: group, blob, copies, keys (those shared with other groups)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for b in batches:
            for k, group, row in _rows(b, names, window):
                at = np.flatnonzero(row.valid)
                keys = window_keys(row.names[:, 0], window, rounds)[at]
                d1, d2 = (d[at] for d in window_digests(row.names, window))
                # Shared with other groups, or by several documents of this one.
                order = np.argsort(keys, kind="stable")
                starts = _starts(keys[order])
                docs = row.ids[at][order]
                several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts) if len(starts) else np.zeros(0, bool)
                shared = np.union1d(_array(b.column("keys"), k).view(_U), keys[order][starts][several])
                use = np.isin(keys, shared)
                d1, d2, doc = d1[use], d2[use], row.ids[at][use]
                order = np.lexsort((doc, d2, d1))
                d1, d2, doc = d1[order], d2[order], doc[order]
                first = _starts(d1, d2)
                last = np.append(first[1:], len(d1))[: len(first)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), group), pa.int64()), _longs(d1[first]), _longs(d2[first]), pa.array(doc[first], pa.int64()), pa.array(doc[last], pa.int64())], ["group", "d1", "d2", "least", "most"])

    return map_slices(groups, work, "group long, d1 long, d2 long, least long, most long")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _array(column: pa.Array, k: int) -> np.ndarray:
    """The list of longs in row k; null is empty."""
    return column[k].values.to_numpy(zero_copy_only=False).astype(np.int64) if column[k].is_valid else np.zeros(0, np.int64)


def _remove(groups: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text). groups: group, blob, copies, d1, d2, first (parallel lists)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for b in batches:
            for k, _, row in _rows(b, names, window):
                d1, d2, first = (_array(b.column(c), k) for c in ("d1", "d2", "first"))
                order = np.lexsort((d2, d1.view(_U)))
                d1, d2, first = d1.view(_U)[order], d2.view(_U)[order], first[order]
                gone = np.zeros(len(row.names), bool)
                if len(d1):
                    mine1, mine2 = window_digests(row.names, window)
                    low, high = np.searchsorted(d1, mine1), np.searchsorted(d1, mine1, "right")
                    hit = np.zeros(len(mine1), bool)
                    for step in range(int((high - low).max(initial=0))):  # one step unless first halves of digests agree
                        at = np.minimum(low + step, len(d1) - 1)
                        hit |= (low + step < high) & (d2[at] == mine2) & (first[at] < row.ids)
                    at = np.flatnonzero(hit & row.valid)
                    mask = np.zeros(len(row.names) + 1, np.int64)
                    np.add.at(mask, at, 1)
                    np.add.at(mask, at + window, -1)
                    gone = np.cumsum(mask)[:-1] > 0
                out = [(doc_id, len(words), len(words), "") for doc_id, words in row.copied]
                for (doc_id, words), end in () if row.empty else zip(row.docs, row.ends.tolist(), strict=True):
                    mine = gone[end - 1 - len(words) : end - 1]
                    kept = [w for w, g in zip(words, mine.tolist(), strict=True) if not g] if mine.any() else words
                    out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_slices(groups, work, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space): one row for each row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a document of smaller
    doc_id; windows are judged on the input. A null text has no words. A row with a null id
    neither loses words nor makes others lose them; rows of one id count as one document.
    """
    held = durable(_groups(text_columns(docs, id_col, text_col)))
    known = held.select("group", "blob").join(_copies(held), "group", "left")
    by_key = Window.partitionBy("key")
    shared = _list_keys(known, window, rounds).withColumn("n", F.count("*").over(by_key)).filter("n > 1").groupBy("group").agg(F.collect_list("key").alias("keys"))
    windows = _list_windows(known.join(shared, "group", "left"), window, rounds)
    by_digest = Window.partitionBy("d1", "d2")
    repeated = windows.withColumn("first", F.min("least").over(by_digest)).filter("first < most")
    repeated = repeated.groupBy("group").agg(*[F.collect_list(c).alias(c) for c in ("d1", "d2", "first")])
    return _remove(known.join(repeated, "group", "left"), window)


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``remove_repeats`` with the SHA-256 of the words left in place of them."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in SQL, over all windows.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT rid, unnest(generate_series(k, k + 12)) AS q FROM g JOIN f USING (g) WHERE f.first < g.doc_id),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
y AS (SELECT x.rid, count(r.q) AS n_removed, string_agg(x.word, ' ' ORDER BY x.q) FILTER (WHERE r.q IS NULL) AS kept FROM x LEFT JOIN r ON r.rid = x.rid AND r.q = x.q GROUP BY x.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(y.n_removed, 0) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.rid = d.rid
"""
