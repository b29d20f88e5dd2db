"""Mixture-controlled packing: deficit round-robin over source queues, solved in closed form.

Every source is a queue of its documents' tokens in one line. A round fills one window: queue q
earns its target share of the window's tokens as credit, and sends one slot of ``slot`` tokens
whenever its credit covers it; what is left is carried to the next round. So after r rounds q
has sent min(its slots, floor(r * share / slot)) slots, the round of any slot is known from its number in its
queue alone, and its place is its rank by (round, queue, number): one sort of the slots, without their tokens, by
ranges. The deficits carried over windows, and over the borders of partitions, are exactly those of the sequential algorithm.
When a queue runs dry its credit goes unused and the windows fill from the others, whose shares
to one another stay the same. What a queue has beyond its last full slot is appended after all
slots, queue by queue, so only the very last sequence can be short.

Unless weights are given, a source's target is in proportion to a power (0.7) of its tokens, so small
sources have more than their share of the windows until they run dry.

The number of tokens before a document in its queue comes from token counts by task and queue, summed up in
order. Every source has a queue of its own, however small and however many there are: neither names nor totals
of sources go to the driver or to all tasks, and a slot costs the same whatever their number. Tokens are made once and kept in a checkpoint.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm._common import durable, map_slices, text_columns, utf8

SEQUENCE = 1024
SLOT = 128
END_ID = 0
VOCABULARY = "byte_bpe_50k"
#: Target shares are in proportion to this power of a source's tokens, unless weights are given.
MIXTURE_POWER = 0.7
#: Fixed-point credit: a window's tokens are shared out in units of this fraction of a token.
CREDIT = 1 << 20
#: The round of what goes after all rounds.
AFTER_ALL = 1 << 62


def encoder(vocabulary: str = VOCABULARY):
    """A function from texts to lists of ids, those that the tokenizer of that name gives with add_special_tokens=False.

    The tokenizer finds its added tokens in the text first, and so does this: a text that holds
    one is cut there and the token gets its own id. The ids are made by tiktoken from the rank
    file of the same vocabulary, which gives the ids of the JSON file in about a fifth of the time.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return made.encode(text, allowed_special="all")
        return made.encode_ordinary(text)

    return encode


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """row (a number of its own), task, source, before (tokens of this source earlier in the task), doc_id, ids (little-endian unsigned 16-bit, with the end id)."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen, row = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int), 0
        end = np.array([end_id], "<u2").tobytes()
        for b in batches:
            before, ids = [], []
            for text, s in zip(utf8(b.column("text")), b.column("source").to_pylist(), strict=True):
                ids.append(np.array(encode(text.decode("utf-8", "replace")), "<u2").tobytes() + end)
                before.append(seen[s])
                seen[s] += len(ids[-1]) // 2
            rows = np.arange(row, row + b.num_rows) + (task << 40)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([task] * b.num_rows, pa.int32()), b.column("source"), pa.array(before, pa.int64()), b.column("doc_id"), pa.array(ids, pa.binary())], ["row", "task", "source", "before", "doc_id", "ids"])

    return map_slices(text_columns(docs, id_col, text_col, source.alias("source")), work, "row long, task int, source string, before long, doc_id long, ids binary")


def queues(counts: DataFrame, weights: dict[str, float] | None = None, window: int = SEQUENCE) -> DataFrame:
    """source, total, credit: the credit (in fractions of a token) that each queue earns a round, of counts (source, n)."""
    totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
    share = F.pow(F.col("total").cast("double"), F.lit(MIXTURE_POWER))
    if weights:  # sources without a weight have the least share together, by their tokens
        spark = counts.sparkSession
        totals = totals.join(spark.createDataFrame(list(weights.items()), "source string, weight double"), "source", "left")
        told = totals.agg(F.min("weight").alias("least"), F.sum(F.when(F.col("weight").isNull(), F.col("total"))).alias("rest")).first()
        least, rest = max(told.least if told.least is not None else 1.0, 1e-9), max(told.rest or 0, 1)
        share = F.coalesce("weight", F.lit(least) * F.col("total") / F.lit(rest))
    shared = totals.select("source", "total", share.alias("share"))
    whole = shared.agg(F.sum("share")).first()[0]
    return shared.select("source", "total", F.greatest(F.lit(1), F.round(F.col("share") / F.lit(whole or 1.0) * F.lit(window * CREDIT))).cast("long").alias("credit"))


def turns(runs: DataFrame, slot: int = SLOT) -> DataFrame:
    """row, source, round, slot, start, length: the pieces of each run of a queue, one for each slot it reaches into.

    runs: row, source, at (tokens before it in its queue), n, total, credit. Slot k goes in the first round r with floor((r + 1) * credit / need) > k,
    where need is a slot's tokens in credit; what is beyond the last full slot goes after all rounds.
    """
    k = F.col("k")
    edge = F.floor(F.col("total") / slot).cast("long")  # number of full slots
    cut = runs.withColumn("k", F.explode(F.sequence(F.expr(f"at div {slot}"), F.expr(f"(at + n - 1) div {slot}"))))
    begin = F.greatest(F.col("at"), k * slot)
    end = F.least(F.col("at") + F.col("n"), (k + 1) * slot)
    turn = F.expr(f"(k + 1) div credit * {slot * CREDIT}L + ((k + 1) % credit * {slot * CREDIT}L + credit - 1) div credit - 1")
    return cut.select("row", "source", F.when(k < edge, turn).otherwise(F.lit(AFTER_ALL)).alias("round"), k.alias("slot"), (begin - F.col("at")).alias("start"), (end - begin).alias("length"))


def places(pieces: DataFrame) -> DataFrame:
    """row, start, length, place: where each piece goes, which is the tokens before it by (round, source, slot).

    Pieces are dealt out by ranges of that order, added up where they lie, and each range starts from the sum of those before it: a number
    for each partition. Pieces of a run that follow each other there are one.
    """
    order = ["round", "source", "slot", "row"]
    sorted_ = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "start", "length")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            row, start, length = (c.to_numpy() for c in b.columns)
            if not len(row):
                continue
            end = before + np.cumsum(length)
            joins = (row[1:] == row[:-1]) & (start[1:] == start[:-1] + length[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~joins)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), part), pa.int32()), *(pa.array(x, pa.int64()) for x in (row[first], start[first], np.add.reduceat(length, first), end[first] - length[first]))], ["part", "row", "start", "length", "local"])
            before = int(end[-1])

    # Kept, because a partition's borders are drawn from a sample: sums and places must see the same ones.
    local = durable(sorted_.mapInArrow(work, "part int, row long, start long, length long, local long"))
    sums = sorted((r.part, r.n) for r in local.groupBy("part").agg(F.sum("length").alias("n")).collect())
    bases = np.cumsum([n for _, n in sums], dtype=np.int64) - np.array([n for _, n in sums], np.int64)
    offsets = local.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, bases.tolist(), strict=True)], "part int, base long")
    return local.join(F.broadcast(offsets), "part").select("row", "start", "length", (F.col("base") + F.col("local")).alias("place"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, slot: int = SLOT, window: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``weights`` are target shares by source; without them they are in proportion to a power of a source's tokens. Every id of every row of ``docs`` is in one
    piece, whatever the weights. A null or empty text is the end id alone; a null source is a
    source of its own name (the empty string). An empty table gives no rows.
    """
    if window % slot:
        raise ValueError("slots must divide the window")
    made = durable(tokens(docs, id_col, text_col, source_col, vocabulary))
    runs = made.select("row", "task", "source", "before", F.expr("octet_length(ids) div 2").alias("n"))
    counts = durable(runs.groupBy("task", "source").agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("base", before).drop("n").join(queues(counts, weights, window), "source")
    at = runs.join(bases, ["task", "source"]).select("row", "source", (F.col("base") + F.col("before")).alias("at"), "n", "total", "credit")
    listed = places(turns(at, slot)).groupBy("row").agg(F.collect_list(F.struct("start", "length", "place")).alias("pieces"))
    placed = made.select("row", "doc_id", "ids").join(listed, "row").select("doc_id", "ids", F.sort_array("pieces").alias("pieces"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, ids, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = np.frombuffer(ids, "<u2").astype("<u4")
                for first, n, place in _whole(pieces, window):
                    piece = whole[first : first + n]
                    rows.append((doc_id, first, n, piece.tolist(), zlib.crc32(piece.tobytes()), len(whole), place // window, place % window))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_slices(placed, work, "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _whole(pieces: list[dict], window: int) -> list[tuple[int, int, int]]:
    """(start, length, place) of a document's pieces: those that touch are one, and none crosses a window."""
    out: list[tuple[int, int, int]] = []
    for p in pieces:
        start, n, place = p["start"], p["length"], p["place"]
        while n:
            step = min(n, window - place % window)
            if out and out[-1][0] + out[-1][1] == start and out[-1][2] + out[-1][1] == place and place % window:
                out[-1] = (out[-1][0], out[-1][1] + step, out[-1][2])
            else:
                out.append((start, step, place))
            start, n, place = start + step, n - step, place + step
    return out


def digest(packed: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed.drop("ids")
