"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

The alphabet is the word. A pattern is a window of ``window_words`` consecutive words of a
benchmark item; a shorter item is one pattern of its own length, and patterns of each length
are searched together, as the method asks. For length m and blocks of B words the shift table
gives, for a block, how far its last occurrence in any pattern is from that pattern's end;
a block that occurs in none skips m - B + 1 words. Where the shift is 0 the bucket under that
suffix block lists the patterns that end so, and the words are compared one to one.

Only the benchmark is sent to the tasks, in blocks of at most ``BLOCK_BYTES`` of text; a larger
benchmark takes several passes over the documents, each adding its hits to those found before.
The documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import durable, keep_rows, map_slices, text_columns, utf8

WINDOW_WORDS = 10
BLOCK_WORDS = 2
#: Text of benchmark items in one pass; its tables take some twenty times as much in a Python worker.
BLOCK_BYTES = 4 << 20

#: A-Z become a-z; of ASCII, only digits and letters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(_FOLD).split()


class WuManber:
    """Patterns of one length: word tuples, each with the items that have it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int) -> None:
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), length - end)
            self.bucket[pattern[length - self.block :]][pattern] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """The first word of each occurrence, and the items that have the pattern."""
        m, b, skip, shift = self.length, self.block, self.skip, self.shift.get
        at, n = m, len(words)
        while at <= n:
            suffix = tuple(words[at - b : at])
            if step := shift(suffix, skip):
                at += step
                continue
            if (items := self.bucket[suffix].get(tuple(words[at - m : at]))) is not None:
                yield at - m, items
            at += 1


def searchers(items: list[tuple[str | None, str | None]], window_words: int = WINDOW_WORDS) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = words_of((text or "").encode())
        m = min(window_words, len(words))
        for at in range(len(words) - m + 1) if m else ():
            known = by_length[m][tuple(words[at : at + m])]
            if item_id is not None:
                known.add(item_id)
    return [WuManber(patterns, m) for m, patterns in sorted(by_length.items())]


def hits(words: list[bytes], found: list[WuManber]) -> tuple[np.ndarray, set[str]]:
    """Which words are inside an occurrence, and the items that occur."""
    mask, items = np.zeros(len(words), bool), set()
    for searcher in found:
        for at, known in searcher.search(words):
            mask[at : at + searcher.length] = True
            items |= known
    return mask, items


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true words, as (first, end)."""
    if not mask.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """The different items in blocks of about BLOCK_BYTES, and whether each is the last; only one at a time is on the driver."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], k == n - 1


_STATE = "doc_id long, text string, n_words long, spans array<struct<first: long, last: long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, the end excluded), items (ids that occur, sorted as strings).

    One row for each row of ``docs``; a null text has no words. Items without words, or with
    null text, match nothing; an item with a null id still marks its words but is not listed.
    """
    state = text_columns(docs, id_col, text_col, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first: bigint, last: bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block, last in _blocks(benchmark, item_col, item_text_col):

        def work(batches: Iterator[pa.RecordBatch], block=block, last=last) -> Iterator[pa.RecordBatch]:
            found = searchers(block, window_words)
            for b in batches:
                counts, spans, items = [], [], []
                for text, before, known in zip(utf8(b.column("text")), b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                    words = words_of(text)
                    mask, new = hits(words, found)
                    for s in before:
                        mask[s["first"] : s["last"]] = True
                    counts.append(len(words))
                    spans.append([{"first": x, "last": y} for x, y in spans_of(mask)])
                    items.append(sorted({*new, *known}))
                text = pa.nulls(b.num_rows, pa.string()) if last else b.column("text")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        state = map_slices(state, work, _STATE)
        if not last:  # so that no plan holds more than one block
            state = durable(state)
    return state.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``find`` as counts and a digest of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs. A null text has no words, so its row stays."""
    for block, last in _blocks(benchmark, "item_id", "text"):

        def decide(texts: list[bytes], found: list[list[WuManber]] = [], block=block) -> list[bool]:  # noqa: B006  one table a worker
            if not found:
                found.append(searchers(block, window_words))
            return [next((True for s in found[0] for _ in s.search(words)), False) is False for words in map(words_of, texts)]

        docs = keep_rows(docs, decide, text_col)
        if not last:
            docs = durable(docs)
    return docs


#: The same rows in SQL, by brute force over all windows.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM p),
g AS (SELECT rid, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
    FROM (SELECT rid, w, m, unnest(generate_series(1, CAST(len(w) - m + 1 AS BIGINT))) AS k FROM d, ms WHERE len(w) >= m)),
h AS (SELECT g.rid, g.k, g.m, p.item_id FROM g JOIN p ON p.m = g.m AND p.g = g.g),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(k, CAST(k + m - 1 AS BIGINT))) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN t ON t.rid = d.rid
"""
