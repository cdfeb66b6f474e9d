"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else, in the same text or another.

Shards are cut by content, so that equal strings meet in one: each window of LENGTH bytes has the least hash of its
K-byte strings as key, and consecutive windows that take it from the same place are one stretch. Stretches go to the
shard of their key. Equal stretches of a key are counted as one class first, which takes exact copies, however many,
out of the way; a key with one class of one stretch repeats nothing. For the other keys the classes' bytes are sorted:
a suffix array for each shard, by Larsson-Sadakane refinement from 8 bytes up to LENGTH, and Kasai's common prefixes
of neighbours tell which windows occur again. A key whose classes are larger than a shard is split into runs: shards
of its own, each with its sorted windows, merged by searching the digests of windows that several runs share.

Texts are UTF-8 bytes; null is empty. Texts shorter than LENGTH lose nothing, longer ones are read whole. Repeated rows
lose what they share. An empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mix, powers, utf8

LENGTH = 200
K = 48
#: Windows of a text that are hashed at once; a stretch ends there at the latest.
AT_ONCE = 1 << 18
#: Bytes of a shard whose suffixes are sorted at once.
SHARD_BYTES = 2 << 20
_POSITION = np.uint64((1 << 20) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: of a block's end and the next block's beginning (van Herk)."""
    n = len(x)
    blocks = -(-n // w)
    y = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(blocks, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def stretches(text: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each stretch."""
    keys, starts, counts = [], [], []
    for at in range(0, len(text) - length + 1, AT_ONCE):
        a = np.frombuffer(text[at : at + AT_ONCE + length - 1], np.uint8)
        p = powers(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=sums[1:])
        n = len(a) - k + 1
        h = sums[k:] - sums[:n]
        h *= p[len(a) - n + 1 : len(a) + 1][::-1]
        h *= np.uint64(pow(_INVERSE, len(a), 1 << 64))  # the power that a piece's strings share must not tell pieces apart
        h = mix(h)
        low = _sliding_min((h & ~_POSITION) | np.arange(n, dtype=np.uint64), length - k + 1)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        keys.append(h[(low[first] & _POSITION).astype(np.int64)])
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(low))))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of values and, for each place, the first place in the order of its equals."""
    order = np.argsort(values, kind="stable")
    new = np.append(True, values[order[1:]] != values[order[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    rank = np.empty(len(values), np.int64)
    rank[order] = head
    return order, rank


def suffix_array(a: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the bytes a in order of their first depth bytes, and each suffix's rank; equal ranks, equal bytes.

    Larsson and Sadakane's refinement: ranks by the first h bytes, taken at a place and h further on, order by 2h bytes;
    only groups that still hold several suffixes are sorted again, each within its own places.
    """
    n = len(a)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = a
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order, rank = _ranks(word)
    h = 8
    while h < depth:
        step = min(h, depth - h)
        # places in the order whose group has several members
        sorted_rank = rank[order]
        several = np.flatnonzero(np.bincount(sorted_rank, minlength=n)[sorted_rank] > 1)
        if not len(several):
            break
        own = order[several]
        group = sorted_rank[several]
        further = own + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        key = group * (n + 1) + second
        by = np.argsort(key, kind="stable")
        own, key, group = own[by], key[by], group[by]
        order[several] = own
        new = np.append(True, key[1:] != key[:-1])
        rank[own] = np.maximum.accumulate(np.where(new, several, 0))
        h += step
    return order, rank


def common_prefixes(a: np.ndarray, order: np.ndarray, rank: np.ndarray, first: np.ndarray, sizes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Kasai's common prefix of each suffix of an ordered selection with the one before it, up to depth.

    A suffix's prefix is at most one shorter than that of the suffix before it in the text, if the latter's neighbour
    moves on to a suffix of the selection too and the two differ within depth; else it is counted anew. Equal ranks
    are equal prefixes of depth bytes. The segments of a (beginning at first, sizes suffixes each) are walked side by
    side, so each step is one of arrays.
    """
    n = len(a)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    chosen = np.zeros(n + 1, bool)
    chosen[order] = True
    padded = np.concatenate([a, np.zeros(depth, np.uint8)])
    out = np.zeros(n, np.int64)
    length = np.zeros(len(first), np.int64)
    live = np.argsort(-sizes, kind="stable")
    for step in range(int(sizes.max(initial=0))):
        live = live[: np.searchsorted(-sizes[live], -step)]
        place = first[live] + step
        other = before[place]
        tied = (other >= 0) & (rank[place] == rank[other])
        run = np.where(tied, depth, np.maximum(length[live] - 1, 0))
        todo = np.flatnonzero(~tied & (other >= 0))
        while len(todo):
            # eight bytes at a time, then the place of the first difference
            x, y = place[todo] + run[todo], other[todo] + run[todo]
            inside = (x < n) & (y < n)
            same = np.zeros((len(todo), 8), bool)
            xs, ys = np.minimum(x, n + depth - 8), np.minimum(y, n + depth - 8)
            for j in range(8):
                same[:, j] = padded[xs + j] == padded[ys + j]
            got = np.where(same.all(1), 8, same.argmin(1)) * inside
            run[todo] = np.minimum(run[todo] + got, depth)
            todo = todo[(got == 8) & (run[todo] < depth)]
        run[other < 0] = 0
        out[place] = run
        length[live] = np.where((run < depth) & (other >= 0) & chosen[other + 1], run, 0)
    return out


def repeated_windows(pieces: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its first windows occur again in any piece."""
    sizes = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    a = np.frombuffer(b"".join(pieces), np.uint8)
    order, rank = suffix_array(a, length)
    # suffixes that don't start a window have no part in it: the rest are neighbours in order
    starts = np.zeros(len(a), bool)
    for f, w in zip(first, windows):
        starts[f : f + w] = True
    own = order[starts[order]]
    lcp = common_prefixes(a, own, rank, first, np.array(windows), length)
    again = lcp >= length
    again[own[:-1]] |= lcp[own[1:]] >= length
    return [again[f : f + w] for f, w in zip(first, windows)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _described(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                ids, keys, starts, counts, digests = [], [], [], [], []
                for i, t in enumerate(utf8(piece)):
                    if len(t) < length:
                        continue
                    k, s, n = stretches(t, length)
                    ids.append(np.full(len(k), i))
                    keys.append(k.view(np.int64)), starts.append(s), counts.append(n)
                    digests += [hashlib.blake2b(t[i:j], digest_size=8).digest() for i, j in zip(s.tolist(), (s + n + length - 1).tolist())]
                if ids:
                    yield pa.record_batch({
                        "key": np.concatenate(keys), "digest": np.frombuffer(b"".join(digests), np.int64), "rid": piece.column(0).take(pa.array(np.concatenate(ids))),
                        "start": np.concatenate(starts).astype(np.int32), "n": np.concatenate(counts).astype(np.int32),
                    })

    return rows.mapInArrow(run, "key long, digest long, rid binary, start int, n int")


def _sorted_shards(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        # keys are whole in a shard unless they are split on purpose: sort as many as fit at once
        pdf = pdf.sort_values("key", kind="stable")
        sizes = pdf["bytes"].str.len().to_numpy()
        keys = pdf["key"].to_numpy()
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        begin, total = 0, 0
        stops = []
        for a, b in zip(edge, np.append(edge[1:], len(pdf))):
            size = sizes[a:b].sum()
            if total and total + size > SHARD_BYTES:
                stops.append((begin, a))
                begin, total = a, 0
            total += size
        stops.append((begin, len(pdf)))
        for a, b in stops:
            part = pdf.iloc[a:b]
            flags = repeated_windows([bytes(x) for x in part["bytes"]], part["n"].tolist(), length)
            for rid, start, f in zip(part["rid"], part["start"], flags):
                for s, n in zip(*_spans(f)):
                    out.append((rid, start + s, n))
        return pd.DataFrame(out, columns=["rid", "start", "n"]).astype({"start": "int32", "n": "int32"})

    return run


def _window_digests(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, start, n, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rid", "start", "n", "bytes"))):
                yield pa.record_batch({
                    "rid": pa.array([rid] * n, pa.binary()), "start": pa.array(np.arange(start, start + n, dtype=np.int32)),
                    "w": pa.array([hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in range(n)], pa.binary()),
                })

    return rows.select("rid", "start", "n", "bytes").mapInArrow(run, "rid binary, start int, w binary")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, start, n: windows (n from start on) that occur again, a written table. rows: rid, text."""
    every = cut(_described(rows, length), "stretches")
    classes = cut(
        every.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.first("rid").alias("rid"), F.first("start").alias("start"), F.first("n").alias("n")),
        "classes",
    )
    # keys of several classes, at least one of which has no copy
    keys = classes.groupBy("key").agg(F.count("*").alias("c"), F.min("copies").alias("least"), F.sum(F.col("n") + length - 1).alias("size")).where("c > 1 and least = 1").select("key", "size")
    mixed = cut(classes.join(keys, "key"), "mixed")
    total = mixed.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    shards = max(1, int(total // SHARD_BYTES) + 1)
    places = mixed.groupBy("rid").agg(F.collect_list(F.struct("key", "start", "n", "size")).alias("places"))
    # a rid stands for equal rows: one of them gives the bytes
    texts = rows.join(places, "rid").dropDuplicates(["rid"])
    bits = texts.select("rid", "text", F.explode("places").alias("p")).select(
        "rid", "p.key", "p.start", "p.n", "p.size", F.substring(F.encode(F.col("text"), "UTF-8"), F.col("p.start") + 1, F.col("p.n") + length - 1).alias("bytes")
    )
    bits = cut(bits, "bytes")
    usual, hot = bits.where(F.col("size") <= 4 * SHARD_BYTES), bits.where(F.col("size") > 4 * SHARD_BYTES)
    found = usual.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(_sorted_shards(length), "rid binary, start int, n int")
    # runs of a key that is larger than a shard: what each run repeats by itself, and the windows that runs share
    split = hot.withColumn("run", F.pmod(F.xxhash64("rid", "start"), F.floor(F.col("size") / SHARD_BYTES) + 1))
    found = found.unionAll(split.groupBy("key", "run").applyInPandas(_sorted_shards(length), "rid binary, start int, n int"))
    windows = _window_digests(hot, length)
    shared = windows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    found = found.unionAll(windows.join(shared, "w", "left_semi").select("rid", "start", F.lit(1).alias("n")))
    copied = every.join(classes.where("copies > 1").select("key", "digest"), ["key", "digest"], "left_semi").select("rid", "start", "n")
    out = cut(found.unionAll(copied).distinct(), "spans")
    discard(every, classes, mixed, bits)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with keep also the bytes that stay."""
    # 128 bits: rows that share them have equal texts
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").withColumn("rid", F.unhex(F.md5(row.cast("binary"))))
    per = repeated_spans(rows.select("rid", "text"), length).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, spans in zip(utf8(batch), batch.column(2).to_pylist()):
                edge = np.zeros(len(t) + 1, np.int64)
                if spans:
                    s = np.array([x["start"] for x in spans])
                    n = np.array([x["n"] for x in spans])
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + n + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if spans else t
                rows.append((len(t), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch({"doc_id": batch.column(0)} | {c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(names)})

    key = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(per, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
