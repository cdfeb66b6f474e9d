"""Packing token pieces into sequences: best-fit decreasing over a segment tree of remaining capacities.

A document's ids are its text's ids and an end id; a null or empty text has the end id alone. Documents of more than
one window are first cut into full windows, and only the rest is packed. Equal lengths are interchangeable, so the
plan is made once from the exact counts of the at most ``capacity`` lengths, and each piece finds its place by its
rank among the pieces of its length. Repeated rows are packed as often as they occur. An empty table gives an empty
result; texts of any length are read whole, and columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, strings
from .tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 0
#: Pieces of one length that one task ranks, about.
RANKED = 50_000


class CapacityTree:
    """Segment tree over 0..capacity with the number of open windows at each remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length that has an open window."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts of lengths, as runs (length, first rank, items, first sequence, items in each, offset).

    The windows at one remaining capacity are kept as ranges of sequence numbers, so the work follows the number of
    different lengths and capacities and not the number of pieces. The items are placed exactly as one by one: an item
    goes to the tightest window, and the next of its length into the same one for as long as it fits.
    """
    tree, open_at, runs, sequences = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, windows: int, each: int, remaining: int) -> None:
            nonlocal left, rank
            runs.append((length, rank, windows * each, first, each, capacity - remaining))
            rank += windows * each
            left -= windows * each
            rest = remaining - each * length
            if rest:
                open_at.setdefault(rest, deque()).append((first, windows))
                tree.add(rest, windows)

        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, windows = capacity, sequences, -(-left // (capacity // length))
                sequences += windows
            else:
                first, windows = open_at[remaining].popleft()
                tree.add(remaining, -windows)
            most = remaining // length
            full = min(windows, left // most)
            if full:
                put(first, full, most, remaining)
            used = full
            if left and full < windows:
                put(first + full, 1, left, remaining)
                used += 1
            if used < windows:
                open_at.setdefault(remaining, deque()).appendleft((first + used, windows - used))
                tree.add(remaining, windows - used)
    return runs


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every document's pieces: full windows, then the rest. With ids also the ids themselves, little-endian 32-bit."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows: list[list] = [[], [], [], [], [], []]
            end = np.array([END_ID], "<u4").tobytes()
            for k, raw in enumerate(encoder(path).encode(strings(batch, "text"))):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    for column, value in zip(rows, (k, start, len(part) // 4, zlib.crc32(part), n, part if ids else None)):
                        column.append(value)
            out = {"doc_id": keys.take(pa.array(rows[0], pa.int64()))}
            out |= {name: pa.array(rows[i], pa.int64()) for i, name in enumerate(("start", "length", "ids_crc32", "doc_tokens"), 1)}
            if ids:
                out["ids"] = pa.array(rows[5], pa.binary())
            yield pa.record_batch(out)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; within a sequence the pieces lie without gaps from 0."""
    spark = docs.sparkSession
    cutted = cut(pieces(docs, path, capacity, ids), "pieces")
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    chunks = max(1, max(counts.values(), default=0) // RANKED + 1)
    dealt = cutted.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    per = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(per, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("base"))
    # a run for each length and remaining capacity that met it: bounded by the capacity, whatever the number of pieces
    places = spark.createDataFrame(runs, "run_length long, first_rank long, items long, first_sequence long, each long, used long")
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items")))
    k = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("used") + F.pmod(k, F.col("each")) * F.col("length")).alias("offset"),
        *(["ids"] if ids else []),
    )
