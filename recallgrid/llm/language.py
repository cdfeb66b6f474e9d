"""Language identification: multinomial naive Bayes over hashed character n-grams.

Nulls and texts without a letter get ``und`` with score 0, as does every text where nothing could be learned, an empty
label table included. Ties go to the alphabetically first language. Texts of any length are read whole; repeated rows
are predicted alike and all stay. An empty table gives an empty result. Other columns are kept; those that have the
result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of

#: Labelled rows per language that the model is fitted on (in expectation; by a hash of the row, all if there are fewer).
MAX_TRAIN_DOCS = 10_000
BITS = 16
ORDERS = (1, 2, 3)
#: Most bytes of a broadcast matrix: more languages are scored in several passes, with the same result.
MATRIX_BYTES = 256 << 20
UNKNOWN = "und"
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to lower case, 32 for all that is no letter."""
    global _table
    if _table is None:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _table = out
    return _table


def ngram_buckets(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that starts at each position (2**bits where it would leave its text),
    the texts' first positions, and whether a text has a letter."""
    raw = "\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    c = _letters()[np.frombuffer(raw, np.uint32)]
    letter = np.maximum.reduceat(c != 32, first)
    last = first + lengths - 1
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        part = c[n - 1 :] * np.uint32(0x9E3779B1)
        h = (h[: len(part)] * np.uint32(0x85EBCA77)) ^ (part + (part >> np.uint32(15)))
        idx = ((h * np.uint32(0xC2B2AE3D) + np.uint32(n)) >> np.uint32(32 - bits)).astype(np.int64)
        bad = (last[:, None] - np.arange(n)[None, :]).ravel()
        bad = bad[(bad >= 0) & (bad < len(idx))]
        idx[bad] = 1 << bits
        # an n-gram that is longer than its text reaches back over the text's start
        out.append(idx)
    return out, first, letter


def _counter(languages: list[str], bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), (1 << bits) + 1), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for i, j in groups_of([len(x) for x in texts]):
                for lang in set(langs[i:j]):
                    own = [t for t, x in zip(texts[i:j], langs[i:j]) if x == lang]
                    for idx in ngram_buckets(own, bits)[0]:
                        counts[place[lang]] += np.bincount(idx, minlength=(1 << bits) + 1)
        for k in range(len(languages)):
            b = np.flatnonzero(counts[k, :-1])
            if len(b):
                yield pa.record_batch({"k": pa.array(np.full(len(b), k), pa.int32()), "bucket": pa.array(b, pa.int32()), "n": pa.array(counts[k, b], pa.int64())})

    return run


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Languages, and the log-probability matrix (languages x buckets) with the priors in parts of MATRIX_BYTES, from rows that have both columns."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    bits = BITS
    model = {"languages": languages, "bits": bits, "parts": []}
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / sizes[k]))])
    took = rows.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    expected = sum(min(max_docs, n) for n in sizes.values())
    took = took.select("lang", "text").repartition(max(1, min(64, expected // 4000)))
    counted = took.mapInArrow(_counter(languages, bits), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    n = np.array([sizes[x] for x in languages], float)
    prior = np.log(n / n.sum())
    wide = 1 << bits
    each = max(1, MATRIX_BYTES // (8 * (wide + 1)))
    counted = cut(counted, "counts") if len(languages) > each else counted
    for first in range(0, len(languages), each):
        own = prior[first : first + each]
        got = counted.where(F.col("k").between(first, first + len(own) - 1)).toPandas()
        counts = np.zeros((len(own), wide))
        counts[got["k"] - first, got["bucket"]] = got["n"]
        logp = np.zeros((len(own), wide + 1))
        logp[:, :-1] = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * wide))
        model["parts"].append({"first": first, "logp": logp, "prior": own})
    return model


#: Until a part is scored: the best language's place, its log-likelihood, and the logarithm of the sum over all languages.
START = (-1, -np.inf, -np.inf)


def score_part(texts: list[str], part: dict, bits: int, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Update the state of each text, in place, by a part's languages; returns which texts have a letter."""
    place, best, total = state
    known = np.zeros(len(texts), bool)
    for i, j in groups_of([len(x) for x in texts]):
        orders, first, known[i:j] = ngram_buckets(texts[i:j], bits)
        own = np.tile(part["prior"], (j - i, 1))
        for idx in orders:
            at = np.minimum(first, len(idx) - 1)
            for k, logp in enumerate(part["logp"]):
                own[:, k] += np.where(first < len(idx), np.add.reduceat(logp[idx], at), 0)
        top = own.argmax(1)
        value = own[np.arange(j - i), top]
        better = value > best[i:j]
        place[i:j] = np.where(better, part["first"] + top, place[i:j])
        best[i:j] = np.where(better, value, best[i:j])
        total[i:j] = np.logaddexp(total[i:j], value + np.log(np.exp(own - value[:, None]).sum(1)))
    return known


def predict(docs: DataFrame, model: dict, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction for each whole text; only the text is looked at. A part of the model is broadcast: at most MATRIX_BYTES."""
    spark = docs.sparkSession
    languages, bits, parts = model["languages"], model["bits"], model["parts"]
    docs = docs.drop(*names)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    at, n = docs.columns.index(text), len(docs.columns)
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    state_ddl = ", ".join([*kept, f"`{mark}0` long, `{mark}1` double, `{mark}2` double"])
    ddl = ", ".join([*kept, f"`{names[0]}` string", f"`{names[1]}` double"])
    if not parts:
        return docs.select("*", F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    for number, part in enumerate(parts):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [x or "" for x in batch.column(at).to_pylist()]
                if number:
                    state = tuple(batch.column(n + i).to_numpy().copy() for i in range(3))
                else:
                    state = tuple(np.full(len(texts), x) for x in START)
                known = score_part(texts, sent.value, bits, state)
                if number + 1 < len(parts):
                    more, titles = [pa.array(x) for x in state], [f"{mark}{i}" for i in range(3)]
                else:
                    prob = np.where(known, np.minimum(np.exp(state[1] - state[2]), 1.0), 0.0)
                    more = [pa.array([languages[k] if ok else UNKNOWN for k, ok in zip(state[0], known)], pa.string()), pa.array(prob, pa.float64())]
                    titles = list(names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *more], names=[*batch.schema.names[:n], *titles])

        last = number + 1 == len(parts)
        docs = docs.mapInArrow(run, ddl if last else state_ddl)
        if not last:
            docs = cut(docs, "scored")
    return docs


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that nothing is learned from: crc32 of the id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
