"""Benchmark decontamination by latent semantic retrieval.

Document frequencies of hashed words are counted over all documents. The benchmark items' TF-IDF rows are factored by
a distributed randomised SVD (Halko, Martinsson and Tropp 2011), and every block of ``BLOCK`` words of every document is
projected onto its right singular vectors. Products with an item add up over blocks, so an item is held against
passages of as many blocks as any stretch of its length and a half needs to lie whole in one, a passage from each block.
Candidates are verified on words: the longest common subsequence of the item and a stretch must hold ``EXACT`` of the
item's words, or ``PARAPHRASE`` of them while the text around the passage holds the item's answer, its last sentence.

No passage that verification would convict is lost by the retrieval: a block has a weight for each of its words, however
often it holds it, so where a passage has m of an item's words, their product is at least the sum of the m least squared
IDFs of the item, which is the threshold, less a bound of what the projection drops. A benchmark is searched in parts of ``RANK`` items, so that little is dropped; as nothing that convicts
is lost, the result is the same whatever the parts. Null, empty and blank texts match nothing; an empty table of
documents or items gives an empty result. Texts of any length are read whole. One row per document row and item, so
repeated rows have one each; of several passages with an item the first that convicts is told. Columns other than
doc_id, text and the item's key are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, utf8, word_hashes

BITS = 16
BLOCK = 32
RANK = 256
POWER_STEPS = 2
EXACT = 0.8
PARAPHRASE = 0.6
#: Bound of the rounding in single precision, as a share of a passage's summed weights.
ROUNDING = 1e-4
_keep = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(text.lower().translate(_keep))[0]


def words_of_all(texts: list[bytes], together: int = 1 << 15) -> list[np.ndarray]:
    """words_of each text; texts are hashed together until they have that many bytes, so that short ones cost no calls each."""
    out = []
    for i, j in groups_of([len(t) for t in texts], together):
        h, start = word_hashes(b" ".join(texts[i:j]).lower().translate(_keep))
        to = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[i:j]])).tolist()
        out += [h[a:b] for a, b in zip([0, *to], to)]
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each word bucket, and documents: 2**BITS numbers, summed by Spark, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            texts = utf8(batch, "text")
            n += len(texts)
            for i, j in groups_of([len(t) for t in texts], 1 << 18):
                many = words_of_all(texts[i:j])
                doc = np.repeat(np.arange(len(many)), [len(h) for h in many])
                df += np.bincount(np.unique(doc << BITS | _bucket(np.concatenate(many))) & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(df)
        yield pa.record_batch({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(df[at], n), pa.int64())})

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    own = got["bucket"] >= 0
    df[got["bucket"][own]] = got["n"][own]
    return df, int(got["n"][~own].sum())


def _rows(items: list[np.ndarray], idf: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(items), width))
    for i, h in enumerate(items):
        b = _bucket(h)
        np.add.at(out[i], place[b], idf[b])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def randomised_svd(benchmark: DataFrame, idf: np.ndarray, place: np.ndarray, width: int, rank: int, n: int) -> np.ndarray:
    """Right singular vectors (width x rank) of the items' TF-IDF rows.

    Each step multiplies by A'A where the rows lie: partitions add up width x rank numbers, which Spark sums by tree.
    """
    rank = max(1, min(rank, n, width))
    wide = min(width, rank + 16)
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((width, wide)))[0]
    spark = benchmark.sparkSession
    for _ in range(POWER_STEPS + 1):
        sent = spark.sparkContext.broadcast((q, idf, place))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, idf, place = sent.value
            y = np.zeros_like(q)
            for batch in batches:
                a = _rows([h for t in utf8(batch, "text") if len(h := words_of(t))], idf, place, len(q))
                y += a.T @ (a @ q)
            at = np.flatnonzero(y.any(1))
            yield pa.record_batch({"i": pa.array(at, pa.int32()), "row": pa.array(list(y[at]), pa.list_(pa.float64()))})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros((width, wide))
            for batch in batches:
                if batch.num_rows:
                    np.add.at(y, batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()))
            at = np.flatnonzero(y.any(1))
            yield pa.record_batch({"i": pa.array(at, pa.int32()), "row": pa.array(list(y[at]), pa.list_(pa.float64()))})

        parts = benchmark.select("text").mapInArrow(run, "i int, row array<double>")
        got = parts.repartition(4, "i").mapInArrow(add, "i int, row array<double>").collect()
        y = np.zeros((width, wide))
        for r in got:
            y[r["i"]] = r["row"]
        q = np.linalg.qr(y)[0]
    return q


def lcs(item: list, text: list) -> int:
    """Length of the longest common subsequence; bit-parallel by item."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _answer(text: str) -> str:
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x.strip()]
    return parts[-1] if len(parts) > 1 else ""


def _need(item: list, answer: list) -> int:
    """Fewest of an item's words that can convict."""
    return max(1, int(np.ceil((PARAPHRASE if answer else EXACT) * len(item) - 1e-9)))


def _reach(item: list) -> int:
    return len(item) + len(item) // 2


class Matcher:
    def __init__(self, idf: np.ndarray, place: np.ndarray, q: np.ndarray, ids: list, texts: list[str]) -> None:
        self.idf, self.place, self.ids = idf, place, ids
        self.items = [words_of(t.encode()).tolist() for t in texts]
        self.answers = [words_of(_answer(t).encode()).tolist() for t in texts]
        self.counts = [Counter(h) for h in self.items]
        self.sets = [frozenset(h) for h in self.items]
        self.document, self.passages = None, {}
        self.need = [_need(h, a) for h, a in zip(self.items, self.answers)]
        #: blocks of a passage, so that a stretch that begins anywhere in its first block lies in it whole
        self.wide = np.array([-(-(_reach(h) + BLOCK - 1) // BLOCK) for h in self.items])
        own = [np.array(h, np.uint64) for h in self.items]
        rows = _rows(own, idf, place, len(q))
        # the singular vectors of the rows within the range that was found, without the oversampling
        u, d, w = np.linalg.svd(rows @ q, full_matrices=False)
        keep = d > 1e-9
        v, self.latent = q @ w[keep].T, (u[:, keep] * d[keep]).astype(np.float32)
        self.lost = np.linalg.norm(rows - (rows @ v) @ v.T, axis=1) + ROUNDING
        weights = [idf[_bucket(h)] for h in own]
        norms = [np.linalg.norm(np.bincount(place[_bucket(h)], x)) for h, x in zip(own, weights)]
        self.least = np.array([np.sort(x**2)[:m].sum() / n for x, m, n in zip(weights, self.need, norms)])
        # a word's weight and row of the singular vectors in one; the last row is for words of no item
        at = np.flatnonzero(place >= 0)
        self.weight = np.append(idf[at[np.argsort(place[at])]], 0.0)
        self.v = (np.append(v, np.zeros((1, v.shape[1])), axis=0) * self.weight[:, None]).astype(np.float32)

    def candidates(self, many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For documents' words: (document, first word of the passage, item) of each candidate, by passage."""
        lens = np.array([len(h) for h in many])
        blocks = -(-lens // BLOCK)
        doc = np.repeat(np.arange(len(many)), blocks)
        base = np.concatenate([[0], np.cumsum(blocks)])
        begin = BLOCK * (np.arange(len(doc)) - base[doc])
        inside = begin[:, None] + np.arange(BLOCK) < lens[doc][:, None]
        own = np.full((len(doc), BLOCK), -1)
        own[inside] = self.place[_bucket(np.concatenate(many))]
        # a block has each of its words once, and words of no item have no part in the projection
        own.sort(axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
        z, weight = np.zeros((len(doc), self.v.shape[1]), np.float32), self.weight[own].sum(1)
        for column in own.T:
            z += self.v[column]
        sims = np.zeros((len(doc) + 1, len(self.ids)))
        np.cumsum(z @ self.latent.T, axis=0, dtype=np.float64, out=sims[1:])
        weight = np.concatenate([[0], np.cumsum(weight)])
        found = []
        for wide in np.unique(self.wide):
            items = np.flatnonzero(self.wide == wide)
            part = sims[:, items]
            end = np.minimum(np.arange(len(doc)) + wide, base[doc + 1])
            slack = (weight[end] - weight[:-1])[:, None] * self.lost[items]
            hit, it = np.nonzero(part[end] - part[:-1] + slack >= self.least[items] * (1 - 1e-6))
            found.append((hit, items[it]))
        hit, it = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((it, hit))
        hit, it = hit[order], it[order]
        return doc[hit], begin[hit], it

    def _set_of(self, words: np.ndarray, begin: int, end: int) -> set:
        """A passage's words, kept as long as calls are for the same document."""
        if self.document is not words:
            self.document, self.passages = words, {}
        if (begin, end) not in self.passages:
            self.passages[begin, end] = set(words[begin:end].tolist())
        return self.passages[begin, end]

    def verify(self, words: np.ndarray, begin: int, item: int) -> float | None:
        """Share of the item's words in the longest common subsequence with a stretch around a passage, if that convicts."""
        own, answer, need = self.items[item], self.answers[item], self.need[item]
        counts, end = self.counts[item], begin + BLOCK * int(self.wide[item])
        # different words in common are quick to count; the item's repeated words count as found
        if len(self.sets[item] & self._set_of(words, begin, end)) + len(own) - len(counts) < need or _shared(counts, words[begin:end].tolist()) < need:
            return None
        near = words[max(0, begin - len(own)) : end + len(own)].tolist()
        # the subsequence must lie in a stretch of the item's length and a half, which can begin at a word of the item
        best, reach = 0, _reach(own)
        for i, w in enumerate(near):
            if w in counts and _shared(counts, stretch := near[i : i + reach]) >= max(need, best + 1):
                best = max(best, lcs(own, stretch))
                if best == len(own):
                    break
        share = best / len(own)
        if share >= EXACT:
            return share
        if share >= PARAPHRASE and answer and lcs(answer, near) == len(answer):
            return share
        return None


def _shared(counts: Counter, words: list) -> int:
    """Words in common, each as often as both have it."""
    return sum(min(n, counts[w]) for w, n in Counter(w for w in words if w in counts).items())


def matchers(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> list[Matcher]:
    """One matcher for each part of the benchmark of RANK items, so that the projection loses nothing of them."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    items = benchmark.select(key, "text").where("text is not null").distinct().orderBy(key, "text").collect()
    items = [r for r in items if len(words_of(r["text"].encode()))]
    out = []
    for i in range(0, len(items), RANK):
        part = items[i : i + RANK]
        used = np.unique(np.concatenate([_bucket(words_of(r["text"].encode())) for r in part]))
        place = np.full(1 << BITS, -1, np.int64)
        place[used] = np.arange(len(used))
        rows = benchmark.sparkSession.createDataFrame([(r["text"],) for r in part], "text string")
        q = randomised_svd(rows, idf, place, len(used), RANK, len(part))
        out.append(Matcher(idf, place, q, [r[key] for r in part], [r["text"] for r in part]))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """doc_id, item_id, the share of the item's words that were found in order, and the first word of the passage."""
    spark = docs.sparkSession
    found = []
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[key].dataType
    ddl = f"doc_id {kind}, item_id {item.simpleString()}, share double, passage long"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item)
    for m in matchers(docs, benchmark, key):
        sent = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches:
                texts = utf8(batch, "text")
                rows: dict = {}
                for i, j in groups_of([len(t) for t in texts], 1 << 18):
                    many = [(k, h) for k, h in enumerate(words_of_all(texts[i:j]), i) if len(h)]
                    if not many:
                        continue
                    for d, begin, it in zip(*m.candidates([h for _, h in many])):
                        k, h = many[d]
                        if (k, it) not in rows and (share := m.verify(h, int(begin), int(it))) is not None:
                            rows[k, it] = (share, int(begin))
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())),
                    "item_id": pa.array([m.ids[it] for _, it in rows], arrow_item),
                    "share": pa.array([x[0] for x in rows.values()], pa.float64()),
                    "passage": pa.array([x[1] for x in rows.values()], pa.int64()),
                })

        found.append(docs.select("doc_id", "text").mapInArrow(run, ddl))
    if not found:
        return docs.select("doc_id").where("false").select("doc_id", F.lit(None).cast(item).alias("item_id"), F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("passage"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out
