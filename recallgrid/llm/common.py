"""Shared pieces: table access, lineage cuts in the shared folder, byte-level word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_pow = np.ones(1, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, never enter a plan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one in local mode, as in tests, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recallgrid-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Spark deletes a job's shuffle files when the job ends, not when the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs whose shuffle files nothing will read again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/recallgrid/{label}-{uuid.uuid4().hex}"
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of cuts that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def groups_of(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to most or little above, so that work arrays stay bounded."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _MULT, np.uint64))])
    return _pow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain): spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(piece, np.uint8)
    ws = _space[a]
    edge = np.empty(len(a) + 1, bool)
    edge[0], edge[-1] = not ws[0], not ws[-1]
    np.not_equal(ws[1:], ws[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    p = powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=sums[1:])
    h = (sums[end] - sums[start]) * p[len(a) - start]
    # P^len(a) is common to a piece only, so bring every word to the same power
    return _rescale(h, len(a)), start


_inverse = pow(_MULT, -1, 1 << 64)


def _rescale(h: np.ndarray, n: int) -> np.ndarray:
    return mix(h * np.uint64(pow(_inverse, n, 1 << 64)))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte start of every run of bytes other than ASCII white space, in order; equal words, equal hashes anywhere."""
    if len(text) <= 2 * PIECE:
        return _hash_piece(text) if text else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes, starts, at = [], [], 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and not _space[text[to]]:
            to += 1
        h, s = _hash_piece(text[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; with fewer words, the whole sequence as one; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_MULT) + words[j : n - k + 1 + j])
    return out


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as (node, component = smallest node), a written table; nodes without edges are absent.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node hands its larger
    neighbours, then its smaller ones, to the smallest. Minima are combined before the shuffle, so a hub with a
    third of all edges costs its tasks one row each; the join back is one that AQE can split.
    Each round ends in a written table, and the rounds go on until the edge set no longer changes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    before, now = None, ()
    while now != before:
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = cut(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        discard(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
    out = cut(nodes.distinct(), "components")
    discard(e)
    return out
