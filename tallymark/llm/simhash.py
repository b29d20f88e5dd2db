"""Near-duplicates by SimHash, with pigeonring filtering of the candidates.

Fingerprint: 64 bits, bit j set if it is set in more than half of the XXH64 values (seed 42)
of a document's word shingles. Two documents are linked if their fingerprints differ in at
most four bits; the groups are the connected components of the links.

Candidates: the 64 bits form a ring of five segments (13, 13, 13, 13, 12 bits). If two
fingerprints differ in at most four bits, some segment starts a chain in which one segment
differs in 0 bits, two in at most 1, three in at most 2 and four in at most 3: the budget is
4/5 of a bit for each segment, so its floor. The first two links of the chain become an
equi-join: one side is indexed under (start, segment, next segment), the other looks up that
key and those with one bit of the next segment changed. The rest of the chain and then the
full distance are conditions of that join, so only true links leave it.

Large buckets: a key with more fingerprints than ``bucket_limit`` is not compared pair by
pair. Its members share the first segment, so any two of them within four bits have a point
within two bits of both that differs from them outside that segment only. Every member is
listed under all its points of that kind; those at one point are within four bits of one
another, and linking each to the smallest gives the same components in linear work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm._common import connected, durable, fresh, map_slices, text_columns, utf8

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENT = 13
SEGMENTS = 5
#: Above this a bucket's pairs (half its square) cost more than the points of its members.
BUCKET_LIMIT = 2048
#: Tasks over which the rows of one fingerprint are dealt.
SALTS = 256
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text (UTF-8), 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    last = ends[-n:] if len(words) >= shingle_words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    pairs = list(zip(starts[:n].tolist(), last.tolist(), strict=True))
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs[at : at + BLOCK]], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); one row for each row of ``docs``. Null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, shingle_words) for x in utf8(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_slices(text_columns(docs, id_col, text_col), work, "doc_id long, fp long")


def _ring(found: DataFrame) -> DataFrame:
    """fp, start, key: the index rows, five for each fingerprint."""
    segment = "(shiftrightunsigned(fp, {0}) & 8191L)"
    here, after = segment.format("13 * start"), segment.format("13 * ((start + 1) % 5)")
    return found.select("fp", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("start")).select("fp", "start", F.expr(f"shiftleft(CAST(start AS BIGINT), 26) | shiftleft({here}, 13) | {after}").alias("key"))


def _probes(index: DataFrame) -> DataFrame:
    """The index rows, with those one bit away in the second segment."""
    width = "IF(start = 3, 12, 13)"
    return index.select("fp", "start", F.explode(F.expr(f"transform(sequence(-1, {width} - 1), i -> IF(i < 0, key, key ^ shiftleft(1L, i)))")).alias("key"))


def links(found: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``found.fp`` whose components are those of all links."""
    index = _ring(found)
    crowded = durable(index.groupBy("key").count().filter(F.col("count") > bucket_limit).select("key"))
    any_crowded = not crowded.isEmpty()
    probes = _probes(index)
    small = index.join(crowded, "key", "left_anti") if any_crowded else index
    xor = "(p.fp ^ q.fp)"
    turned = f"(shiftrightunsigned({xor}, 13 * p.start) | shiftleft({xor}, IF(p.start = 0, 0, 64 - 13 * p.start)))"

    def within(segments: int, most: int) -> str:
        """The first ``segments`` of the chain from ``start``; the fifth segment has one bit less."""
        has_last = f"p.start + {segments} > 4"
        return f"bit_count({turned} & IF({has_last}, {(1 << (SEGMENT * segments - 1)) - 1}L, {(1 << (SEGMENT * segments)) - 1}L)) <= {most}"

    near = F.expr(f"p.key = q.key AND p.fp < q.fp AND {within(3, 2)} AND {within(4, 3)} AND bit_count({xor}) <= {MAX_BITS}")
    out = probes.alias("p").join(small.alias("q"), near).select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"))
    if any_crowded:
        members = probes.unionByName(index).join(crowded, "key", "left_semi").distinct()
        points = F.array(*[F.array(*[F.lit(m) for m in _masks(start)]) for start in range(SEGMENTS)])
        listed = members.withColumn("mask", F.explode(points[F.col("start")])).select("fp", "key", F.expr("fp ^ mask").alias("point"))
        least = listed.groupBy("key", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").drop("most")
        out = out.unionByName(listed.join(least, ["key", "point"]).filter("a <> fp").select("a", F.col("fp").alias("b")))
    return out.distinct()


def _masks(start: int) -> list[int]:
    """All changes of at most two bits outside segment ``start``, as signed longs."""
    free = [1 << j for j in range(64) if j // SEGMENT != start]
    return [m - (1 << 64) if m >> 63 else m for m in (0, *free, *(x | y for x, y in combinations(free, 2)))]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    A null text or one without words has fingerprint 0 and links like any other. Repeated rows
    give repeated rows. A null doc_id stays null and gets the component of its fingerprint,
    which is null only if no document reachable has an id.
    """
    prints = durable(fingerprints(docs, id_col, text_col).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    # A fingerprint of very many copies is dealt over SALTS tasks: its rows meet only in sums and minima.
    dealt = prints.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    found = durable(dealt.groupBy("fp").agg(F.min("least").alias("least")))
    roots = connected(links(found.select("fp"), bucket_limit))
    tied = found.join(roots, F.col("fp") == F.col("node"))
    smallest = tied.groupBy("root").agg(F.min("least").alias("first"))
    tied = tied.select("fp", "root").join(smallest, "root").select("fp", "first")
    named = found.join(tied, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    named = dealt.select("fp", "salt").join(named, "fp")
    return prints.join(named, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id.

    Rows of the smallest id of a component that have one text stay once, the one whose other
    columns come first as JSON; with different texts all of them stay. Rows with a null id
    cannot be told apart by it and stay, repeated ones as often as they are there.
    """
    later = fresh(docs, "later")
    ids = groups(docs, id_col, text_col, bucket_limit).filter("doc_id <> component_id").select(F.col("doc_id").alias(later)).distinct()
    named = docs.filter(F.col(f"`{id_col}`").isNotNull())
    first = named.join(ids, F.col(f"`{id_col}`").cast("long") == F.col(later), "left_anti")
    return _once(first, [id_col, text_col]).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys: the one whose other columns come first as JSON."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.dropDuplicates(keys)
    rest, name = F.struct(*[F.col(f"`{c}`") for c in others]), fresh(rows, "rest")
    chosen = rows.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.min_by(rest, F.to_json(rest)).alias(name))
    return chosen.select(*[F.col(f"`{c}`") if c in keys else F.col(f"{name}.`{c}`").alias(c) for c in rows.columns])
