"""Spelling variants: words within one edit of each other, found with a bit-sliced position index.

The index holds, for each (position, letter), the set of words that have this letter there, as bits
of 64-bit numbers. A query reads its letters in turn and carries four such sets at once: words equal
so far, words with one letter replaced so far, words one letter ahead (they have one more), and words
one letter behind (they lack one). Each step intersects them with the index at the query's own
position and at the positions shifted by one; what is left at the end, with the right length, is near.
One NumPy instruction moves the sets of all queries of a block by a letter.

Which words meet: of two words within one edit, the shorter one of n letters, either the first n // 2
letters agree or the last n - n // 2 do (the edit stands behind the one or before the other). So the
vocabulary is dealt by (n, side, half), twice for each of the two lengths a word can be the shorter or
the longer of, and only words of one such group share an index. A pair whose first halves agree is left
out of the other group, so each pair is found once and counts and maxima add up. Groups of more than
``GROUP`` words are dealt over cells of index part x query part.

Only sums leave a group: a word's near words and the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import durable, map_slices, text_columns, utf8

MIN_LENGTH, MIN_COUNT = 5, 3
#: One of this many (document, word) pairs loses a letter.
EVERY = 97
#: A form has at least this many times the occurrences of its variant.
TIMES = 2
#: Words that share one index; larger groups are dealt over cells of at most about this many.
GROUP = 16384
#: Words counted in a task before partial counts are passed on.
HELD = 1 << 19
#: Characters of words, and (query, 64 words) pairs, that are worked on at once.
CHARS, UNITS = 1 << 22, 1 << 19

# The letters: a-z and U+00C0 to U+00FF, whose UTF-8 is C3 80 to C3 BF. In Latin-1 each is one byte.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_CODES = np.zeros(256, np.int64)
_CODES[np.r_[0x61:0x7B, 0xC0:0x100]] = np.arange(1, 91)
_WIDTH = 91
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(doc_id: int | None, text: bytes) -> Counter[bytes]:
    """The words of a document (UTF-8) and how often each occurs, after the deletions."""
    found = Counter(_RUN.findall(text.lower()))  # of bytes: A-Z only
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    # All are taken out before any is put back: what a deletion leaves may itself be a run that loses a letter.
    for run, n in [(r, found.pop(r)) for r in list(found) if zlib.crc32(r, start) % EVERY == 0]:
        said = run.decode()
        at = zlib.crc32(run, start) % len(said)
        found[(said[:at] + said[at + 1 :]).encode()] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least so many letters and occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w.decode(), n) for w, n in held.items() if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                for w, n in words_of(doc_id, text).items():
                    held[w] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    counted = map_slices(text_columns(docs, id_col, text_col), work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


class Index:
    """The bit-sliced position index of some words: row r is bit r % 64 of lane r // 64."""

    def __init__(self, letters: np.ndarray, rows: np.ndarray) -> None:
        """letters: a row of codes for each word, 0 after its end; rows: those that are indexed, in order."""
        self.letters, self.lanes = letters[rows], (len(rows) + 63) // 64
        place = np.arange(len(rows))
        self.lane, self.bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
        self.keep = self.lanes * _WIDTH * 8 * letters.shape[1] <= 1 << 26
        self.made: dict[int, np.ndarray] = {}

    def at(self, position: int) -> np.ndarray:
        """The words with each letter at a position: [lane * _WIDTH + letter]."""
        if position not in self.made:
            if not self.keep:
                self.made = {k: v for k, v in self.made.items() if abs(k - position) <= 2}
            column = np.zeros(self.lanes * _WIDTH, np.uint64)
            np.add.at(column, self.lane * _WIDTH + self.letters[:, position], self.bit)  # each bit once: a sum is a union
            self.made[position] = column
        return self.made[position]

    def where(self, mask: np.ndarray) -> np.ndarray:
        """The words of a mask over the indexed rows, by lane."""
        out = np.zeros(self.lanes, np.uint64)
        np.add.at(out, self.lane, np.where(mask, self.bit, np.uint64(0)))
        return out


def near(letters: np.ndarray, long: np.ndarray, cell: np.ndarray, side: np.ndarray, role: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, indexed row) of one cell each that are one edit apart.

    letters: words of n or n + 1 (``long``) letters; cell: numbers that do not fall; side: 1 where the cell shares the last
    letters; role: 1 indexed, 2 query, 3 both.
    """
    rows = np.flatnonzero(role & 1)
    index = Index(letters, rows)
    if not index.lanes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shorter, longer = index.where(~long[rows]), index.where(long[rows])
    queries = np.flatnonzero(role & 2)
    first, last = np.searchsorted(cell[rows], cell[queries], "left"), np.searchsorted(cell[rows], cell[queries], "right")
    queries, first, last = (x[last > first] for x in (queries, first, last))
    width = ((last - 1) >> 6) - (first >> 6) + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(width)
    begin = 0
    while begin < len(queries):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + UNITS, "right")))
        part = slice(begin, stop)
        for of_long in (False, True):
            mine = np.flatnonzero(long[queries[part]] == of_long) + begin
            if not len(mine):
                continue
            query = np.repeat(queries[mine], width[mine])
            start, end = np.repeat(first[mine], width[mine]), np.repeat(last[mine], width[mine])
            lane = (start >> 6) + np.arange(len(query)) - np.repeat(np.cumsum(width[mine]) - width[mine], width[mine])
            mask = np.where(lane == start >> 6, _ALL << (start & 63).astype(np.uint64), _ALL)
            mask &= np.where(lane == (end - 1) >> 6, _ALL >> (63 - ((end - 1) & 63)).astype(np.uint64), _ALL)
            sets = _behind(index, letters, query, lane, mask, side, n, shorter) if of_long else _ahead(index, letters, query, lane, mask, side, n, shorter, longer)
            hit = np.flatnonzero(sets)
            bits = np.unpackbits(sets[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            unit, bit = np.nonzero(bits)
            found.append((query[hit[unit]], rows[lane[hit[unit]] * 64 + bit]))
        begin = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _ahead(index: Index, letters: np.ndarray, query: np.ndarray, lane: np.ndarray, mask: np.ndarray, side: np.ndarray, n: int, shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For queries of n letters: words with one letter replaced, or with one more."""
    base, equal, replaced, ahead, half = lane * _WIDTH, mask.copy(), np.zeros_like(mask), mask.copy(), mask
    for i in range(n):
        at = base + letters[query, i]
        here, next_ = index.at(i)[at], index.at(i + 1)[at]
        replaced = (replaced & here) | (equal & ~here)
        equal = equal & here
        ahead = (ahead & next_) | equal
        if i + 1 == n // 2:
            half = equal
    return ((replaced & shorter[lane]) | (ahead & longer[lane])) & ~np.where(side[query] == 1, half, np.uint64(0))


def _behind(index: Index, letters: np.ndarray, query: np.ndarray, lane: np.ndarray, mask: np.ndarray, side: np.ndarray, n: int, shorter: np.ndarray) -> np.ndarray:
    """For queries of n + 1 letters: words with one letter less."""
    base, equal, behind, half = lane * _WIDTH, mask.copy(), np.zeros_like(mask), mask
    for i in range(n + 1):
        at = base + letters[query, i]
        behind = (behind & index.at(i - 1)[at]) | equal if i else equal
        equal = equal & index.at(i)[at]
        if i + 1 == n // 2:
            half = equal
    return behind & shorter[lane] & ~np.where(side[query] == 1, half, np.uint64(0))


def _cells(words: DataFrame, group: int) -> DataFrame:
    """n_short, cell, side, role, word, n: each word in its groups, and those that are too large in cells."""
    size = F.length("word")

    def member(short: int) -> list:
        """As one of two words whose shorter one has ``size - short`` letters."""
        n = size - short
        half = F.floor(n / 2).cast("int")
        return [
            F.struct(n.alias("n_short"), F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")),
            F.struct(n.alias("n_short"), F.lit(1).alias("side"), F.substring("word", size - n + half + 1, n - half).alias("half")),
        ]

    dealt = words.select("word", "n", F.explode(F.array(*member(0), *member(1))).alias("g")).select("word", "n", "g.n_short", "g.side", "g.half")
    key = ["n_short", "side", "half"]
    large = dealt.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > group).withColumn("parts", F.ceil(F.col("members") / group).cast("int")).drop("members")
    joined = dealt.join(large, key, "left")
    part = F.expr("cast(pmod(xxhash64(word), parts) as int)")
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("q"), F.lit(3).alias("role")))).otherwise(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda j: F.when(j == part, F.array(F.struct(j.alias("i"), j.alias("q"), F.lit(3).alias("role")))).otherwise(F.array(F.struct(part.alias("i"), j.alias("q"), F.lit(1).alias("role")), F.struct(j.alias("i"), part.alias("q"), F.lit(2).alias("role")))),
            )
        )
    )
    spread = joined.withColumn("c", F.explode(cells))
    return spread.select("n_short", F.concat_ws(":", "n_short", "side", "c.i", "c.q", "half").alias("cell"), "side", "c.role", "word", "n")


def _found(batch: pa.Table) -> pa.RecordBatch:
    """word, n_near, best_n, best: the near words of the queries in whole cells of one n_short."""
    cell = batch.column("cell").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    change = np.flatnonzero(np.diff(cell, prepend=-1))
    sizes = np.diff(np.append(change, len(cell)))
    several = np.repeat(sizes > 1, sizes)
    words = batch.column("word").filter(pa.array(several)).to_pylist()
    cell = np.repeat(np.arange(len(sizes)), sizes)[several]
    n, side, role = (batch.column(c).to_numpy()[several].astype(np.int64) for c in ("n", "side", "role"))
    short = batch.column("n_short")[0].as_py()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.zeros((len(words), short + 2), np.uint8)
    codes = _CODES[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    letters[np.arange(short + 2) < lengths[:, None]] = codes
    query, other = near(letters, lengths > short, cell, side, role, short)
    order = np.lexsort((other, -n[other], query))  # rows of a cell are in the order of their words
    query, other = query[order], other[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    count = np.diff(np.append(first, len(query)))
    best = other[first]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in query[first].tolist()], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[k] for k in best.tolist()], pa.string())],
        ["word", "n_near", "best_n", "best"],
    )


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best: sums and maxima of each cell; a word may have several rows, and has none without a near word.

    words: (word, n), each word once and of a-z and U+00C0 to U+00FF only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """The results of a table of whole cells, one n_short at a time."""
            short = table.column("n_short").to_numpy()
            cuts = [*np.flatnonzero(np.diff(short, prepend=-1)).tolist(), len(short)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield _found(table.slice(a, b - a))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            size += int(b.column("n_short").to_numpy().sum())
            if size < CHARS:
                continue
            table = pa.concat_tables(held)
            cell = table.column("cell")
            last = cell[-1].as_py()
            same = len(cell) - 1
            while same and cell[same - 1].as_py() == last:
                same -= 1
            if same:
                yield from whole(table.slice(0, same))
            held = [table.slice(same)]
            size = int(held[0].column("n_short").to_numpy().sum()) if same else 0
        if held:
            yield from whole(pa.concat_tables(held))

    cells = _cells(words, group).repartition("cell").sortWithinPartitions("n_short", "cell", "word")
    return cells.mapInArrow(work, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """word, root: where following (word, form) ends. Every round doubles the steps; n at least doubles with each, so few do."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        now = durable(now.join(further, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")))
        moved = not now.filter("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the vocabulary of ``docs``.

    A null or empty text has no words; a null id counts as an empty one in the deletions, and rows that repeat count
    as often as they stand there. An empty table gives no rows.
    """
    words = durable(vocabulary(docs, id_col, text_col))
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = none.unionByName(near_words(words, group).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    summed = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.less") >= TIMES * F.col("n")
    out = durable(summed.select("word", "n", "n_near", F.when(is_form, F.col("b.best")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n")))
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
