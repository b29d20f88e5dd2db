"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Two tokenizations of a text are cut into groups wherever both have a token border at the same byte;
all pairs of tokens of a group are links. The cuts are found by lockstep merging: a NumPy state
vector holds a pointer into A's and one into B's tokens for every document of a batch, and each step
compares all pairs of token ends at once, advances the pointers whose token ends first (both where
they end together, which is a cut and emits the group), and drops the documents that have ended.
A long document enters the vector as several lanes, each from one common border to another, so that
no lane is much longer than the rest.

A pair's weight is the number of documents that hold it linked. Documents are worked off in blocks of
some ``BLOCK`` bytes of text, which number their distinct pairs; a block sends each of its pairs once,
with the number of its documents, to be summed up by Spark and sent back to the block. So a pair that
stands in all documents costs one row for each block. Per document there are stored only the numbers of
its distinct pairs and how often each is linked. What is broadcast is the highest count for each token of A:
as many rows as that vocabulary has, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import map_slices, shared_folder, text_columns, utf8

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of text in a block, and of texts that are merged at once (a longer text is a block by itself).
BLOCK, BATCH = 1 << 24, 1 << 20
#: About so many tokens of A in a lane.
LANE = 256
#: Groups of more links than this are expanded by their distinct tokens.
WIDE = 4096
#: Pairs of a block in a row.
PAIRS = 1 << 13


class Tokens:
    """Both tokenizers: ids of a text, the bytes of each id, and the strings that ids are hashed by."""

    def __init__(self, a_name: str, b_name: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(f"{a_name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b_name}.model"))
        self.a_length = np.zeros(max(ranks.values()) + 1, np.int64)
        for said, rank in ranks.items():
            self.a_length[rank] = len(said)
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.b_length = np.fromiter(map(len, self.b_bytes), np.int64)
        self.a_size, self.b_size = len(self.a_length), len(self.b_bytes)
        self.said = [f"{k}{mark}" for mark in ",|;" for k in range(max(self.a_size, self.b_size))]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of " " + text by A and of the text by B; none where the tokens' bytes are not those of " " + text.

        A's are made from its rank file, which gives the ids of its JSON file with special tokens read as
        plain text; it loses no byte, so its length is enough to compare.
        """
        none = np.zeros(0, np.int64)
        out = []
        said = [t.decode("utf-8", "replace") for t in texts]
        for text, raw, b in zip(said, texts, self.b.encode(said, num_threads=1), strict=True):
            spaced = b" " + raw
            if raw and b"".join(map(self.b_bytes.__getitem__, b)) == spaced:
                a = np.array(self.a.encode_ordinary(" " + text), np.int64)
                if int(self.a_length[a].sum()) == len(spaced):
                    out.append((a, np.array(b, np.int64)))
                    continue
            out.append((none, none))
        return out


def _piece_bytes(piece: str) -> bytes:
    m = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()


@cache
def tokenizers(a_name: str, b_name: str) -> Tokens:
    return Tokens(a_name, b_name)


def _lanes(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, lane: int) -> np.ndarray:
    """Ends (bytes) of lanes: every document's end, and the first common borders after each ``lane`` tokens of A."""
    at = np.arange(lane - 1, len(a_ends), lane)
    out = [starts[1:]]
    while len(at):
        x = a_ends[at]
        y = b_ends[np.searchsorted(b_ends, x)]
        out.append(x[x == y])
        at = np.searchsorted(a_ends, y[x != y])
    return np.unique(np.concatenate(out))


def merge(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, lane: int = LANE) -> np.ndarray:
    """The groups of a batch: rows (first A token, last + 1, first B token, last + 1), in text order.

    a_ends, b_ends: byte ends of the tokens of all documents, one after the other; starts: where each document with tokens
    begins, and where the last one ends. All documents' bytes are covered by both.
    """
    stop = _lanes(a_ends, b_ends, starts, lane)
    if not len(stop):
        return np.zeros((0, 4), np.int64)
    begin = np.concatenate(([starts[0]], stop[:-1]))
    a, b = np.searchsorted(a_ends, begin, "right"), np.searchsorted(b_ends, begin, "right")
    first_a, first_b = a.copy(), b.copy()
    cuts = []
    while len(stop):
        x, y = a_ends[a], b_ends[b]
        a, b = a + (x <= y), b + (y <= x)
        cut = np.flatnonzero(x == y)
        cuts.append(np.stack((first_a[cut], a[cut], first_b[cut], b[cut])))
        first_a[cut], first_b[cut] = a[cut], b[cut]
        ended = x[cut] == stop[cut]
        if ended.any():
            go = np.ones(len(stop), bool)
            go[cut[ended]] = False
            a, b, first_a, first_b, stop = a[go], b[go], first_a[go], first_b[go], stop[go]
    found = np.concatenate(cuts, axis=1).T
    return found[np.argsort(found[:, 0])]


def _links(groups: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pair (A id * b_size + B id) and how many links: rows of a document and pair may repeat."""
    wide = (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]) > WIDE
    some, of = groups[~wide], doc[~wide]
    n_b = some[:, 3] - some[:, 2]
    n = (some[:, 1] - some[:, 0]) * n_b
    row = np.repeat(np.arange(len(some)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.divmod(k, n_b[row])
    docs, pairs, times = [of[row]], [a[some[row, 0] + i] * b_size + b[some[row, 2] + j]], [np.ones(len(row), np.int64)]
    for (a0, a1, b0, b1), d in zip(groups[wide].tolist(), doc[wide].tolist(), strict=True):
        x, x_n = np.unique(a[a0:a1], return_counts=True)
        y, y_n = np.unique(b[b0:b1], return_counts=True)
        pairs.append((x[:, None] * b_size + y).ravel())
        times.append((x_n[:, None] * y_n).ravel())
        docs.append(np.full(len(pairs[-1]), d))
    return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)


class Aligned:
    """A batch of documents, aligned: sizes and hashes of each, and its distinct pairs."""

    def __init__(self, encoded: list[tuple[np.ndarray, np.ndarray]], tokens: Tokens) -> None:
        self.n_a, self.n_b = (np.array([len(x[k]) for x in encoded], np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in encoded]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(tokens.a_length[a]), np.cumsum(tokens.b_length[b])
        last_a, last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        full = np.flatnonzero(self.n_a)
        starts = np.concatenate(([0], a_ends[last_a[full] - 1])) if len(full) else np.zeros(1, np.int64)
        groups = merge(a_ends, b_ends, starts)
        doc = np.searchsorted(last_a, groups[:, 0], "right")
        self.n_groups = np.bincount(doc, minlength=len(encoded))
        self.n_links = np.zeros(len(encoded), np.int64)
        np.add.at(self.n_links, doc, (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]))
        self.sha256 = self._hashes(groups, a, b, last_a, last_b, tokens)
        of, pair, times = _links(groups, doc, a, b, tokens.b_size)
        key = of * (tokens.a_size * tokens.b_size) + pair
        if (times == 1).all():
            key, self.times = np.unique(key, return_counts=True)
        else:
            key, where = np.unique(key, return_inverse=True)
            self.times = np.zeros(len(key), np.int64)
            np.add.at(self.times, where, times)
        of, self.pairs = np.divmod(key, tokens.a_size * tokens.b_size)
        self.last = np.cumsum(np.bincount(of, minlength=len(encoded)))

    def _hashes(self, groups: np.ndarray, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, tokens: Tokens) -> list[str]:
        """SHA-256 of each document's groups as text: ids joined by commas, A's and B's by a bar, groups by semicolons."""
        n = max(tokens.a_size, tokens.b_size)
        said = np.empty(len(a) + len(b), np.int64)
        a_mark, b_mark = a.copy(), b.copy()
        a_mark[groups[:, 1] - 1] += n
        b_mark[groups[:, 3] - 1] += 2 * n
        said[np.arange(len(a)) + np.repeat(groups[:, 2], groups[:, 1] - groups[:, 0])] = a_mark
        said[np.arange(len(b)) + np.repeat(groups[:, 1], groups[:, 3] - groups[:, 2])] = b_mark
        out, at = [], 0
        for end in (last_a + last_b).tolist():
            text = "".join(map(tokens.said.__getitem__, said[at:end].tolist()))[:-1]
            out.append(hashlib.sha256(text.encode()).hexdigest() if end > at else "")
            at = end
        return out


_STORED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, first int, pairs array<long>, docs array<int>"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """Rows of documents (places: numbers of their pairs in the block; times: links of each) and of the pairs of each block (docs: documents with each)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(a_name, b_name)
        number = TaskContext.get().partitionId() << 32
        ids: list[list[int | None]] = []
        held: list[Aligned] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            """The block held so far."""
            nonlocal size, number
            every = np.concatenate([x.pairs for x in held])
            pairs, place, n_docs = np.unique(every, return_inverse=True, return_counts=True)
            place, at = place.astype("<u4"), 0
            for doc_ids, x in zip(ids, held, strict=True):
                borders = [0, *x.last.tolist()]
                mine, times = place[at : at + len(x.pairs)], x.times.astype("<u4")
                at += len(x.pairs)
                cut = [(mine[p:q].tobytes(), times[p:q].tobytes()) for p, q in zip(borders, borders[1:], strict=False)]
                columns = [pa.array([number] * len(doc_ids)), pa.array(doc_ids), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(x.sha256), pa.array([p for p, _ in cut]), pa.array([t for _, t in cut])]
                yield _filled(columns, None)
            for first in range(0, len(pairs), PAIRS):
                yield _filled([pa.array([number])], (first, pairs[first : first + PAIRS], n_docs[first : first + PAIRS]))
            ids.clear()
            held.clear()
            size, number = 0, number + 1

        def add(rows: list[tuple[int | None, bytes]]) -> None:
            nonlocal size
            ids.append([d for d, _ in rows])
            held.append(Aligned(tokens.encode([t for _, t in rows]), tokens))
            size += sum(len(t) for _, t in rows)

        rows, n = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                if rows and n + len(text) > batch:
                    add(rows)
                    rows, n = [], 0
                    if size >= block:
                        yield from out()
                rows.append((doc_id, text))
                n += len(text)
        if rows:
            add(rows)
        if held:
            yield from out()

    return map_slices(text_columns(docs, id_col, text_col), work, _STORED)


def _filled(columns: list[pa.Array], pairs: tuple[int, np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """A batch of the stored schema: rows of documents, or one row of pairs."""
    kinds = [*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [part.split()[0] for part in _STORED.split(", ")]
    n = len(columns[0])
    columns = [c.cast(k) for c, k in zip(columns, kinds, strict=False)]
    columns += [pa.nulls(n, k) for k in kinds[len(columns) :]]
    if pairs is not None:
        columns[9:] = [pa.array([pairs[0]], pa.int32()), pa.array([pairs[1]], pa.list_(pa.int64())), pa.array([pairs[2].astype(np.int32)], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n: the documents that hold each pair, of all blocks."""
    return blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """a_id, b_id, n, best: each linked pair of token ids, its number of documents, and whether no other pair of this A id has more."""
    return _counted(_store(aligned(docs, id_col, text_col, a_name, b_name, block, batch)), a_name, b_name).select("a_id", "b_id", "n", "best")


def _counted(stored: DataFrame, a_name: str, b_name: str) -> DataFrame:
    b_size = tokenizers(a_name, b_name).b_size
    counts = pair_counts(stored.filter("pairs is not null")).withColumn("a_id", F.expr(f"pair div {b_size}L"))
    # A row for each id of A at most: of a size that the vocabulary bounds.
    most = F.broadcast(counts.groupBy("a_id").agg(F.max("n").alias("most")))
    return counts.join(most, "a_id").select("pair", "a_id", F.expr(f"pair % {b_size}L").alias("b_id"), "n", (F.col("n") == F.col("most")).alias("best"))


def _store(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there, column by column."""
    folder = f"{shared_folder(df.sparkSession)}/alignment-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    hash. Every row counts as a document, also one whose id repeats. An empty table gives no rows.
    """
    stored = _store(aligned(docs, id_col, text_col, a_name, b_name, block, batch))
    sent = stored.filter("pairs is not null").select("block", "first", F.posexplode(F.col("pairs")).alias("k", "pair")).select("block", (F.col("first") + F.col("k")).alias("place"), "pair")
    values = sent.join(_counted(stored, a_name, b_name), "pair").select("block", "place", (F.col("n") * 2 + F.col("best").cast("long")).alias("value"))
    rows = stored.filter("pairs is null").drop("first", "pairs", "docs")
    both = values.unionByName(rows, allowMissingColumns=True).withColumn("kind", F.when(F.col("place").isNull(), 1).otherwise(0))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, np.zeros(0, np.int64)
        for b in batches:
            block = b.column("block").to_numpy()
            cuts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)).tolist(), len(block)] if len(block) else []
            for p, q in zip(cuts, cuts[1:], strict=False):
                part = b.slice(p, q - p)
                if block[p] != now:
                    now, value = block[p], np.zeros(0, np.int64)
                of_pairs = int((part.column("kind").to_numpy() == 0).sum())
                if of_pairs:
                    place = part.column("place").slice(0, of_pairs).to_numpy()
                    if (top := int(place.max()) + 1) > len(value):
                        value = np.concatenate((value, np.zeros(max(top, 2 * len(value)) - len(value), np.int64)))
                    value[place] = part.column("value").slice(0, of_pairs).to_numpy()
                part = part.slice(of_pairs)
                if not part.num_rows:
                    continue
                best, total = [], []
                for places, times in zip(part.column("places").to_pylist(), part.column("times").to_pylist(), strict=True):
                    v, t = value[np.frombuffer(places, "<u4")], np.frombuffer(times, "<u4").astype(np.int64)
                    best.append(int((t * (v & 1)).sum()))
                    total.append(int((t * (v >> 1)).sum()))
                made = {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in names], names)

    dealt = both.repartition("block").sortWithinPartitions("block", "kind").select("block", "kind", "place", "value", *[c for c in names if c not in ("n_best", "count_sum")], "places", "times")
    return dealt.mapInArrow(work, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
