"""Exact, vector, pattern and text retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import text, vectors

#: Query vectors (as doubles) that are sent to the executors at once; more are searched in several passes.
SENT_BYTES = 64 << 20


def exact_lookup(entries: DataFrame, probes: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """Every probe with its value, confidence 1 and no next layer, or confidence 0 and layer 2 next. The last entry of a key counts."""
    if order:
        entries = entries.groupBy(key).agg(F.max_by(value, order).alias(value))
    else:
        entries = entries.groupBy(key).agg(F.min(value).alias(value))
    hit = probes.join(entries.withColumn("_hit", F.lit(True)), key, "left")
    found = F.coalesce("_hit", F.lit(False))
    return hit.withColumn("found", found).withColumn("confidence", F.when(found, 1.0).otherwise(0.0)).withColumn("next_layer", F.when(~found, 2)).drop("_hit")


def similarity_topk(store: DataFrame, query: list[float], k: int = 10, key: str = "memory_id", vector: str = "embedding", exclude_zero_query: bool = True) -> DataFrame:
    """The k nearest rows to one vector by confidence (cosine + 1) / 2, ranked, ties by key; a zero query has none."""
    if exclude_zero_query and not any(query):
        return store.select(key).withColumns({"similarity": F.lit(0.0), "confidence": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    cos = F.round(vectors.cosine(F.col(vector), q), 6)
    top = store.select(key, cos.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
    return top.select(key, "similarity", vectors.rounded(vectors.confidence(F.col("similarity"))).alias("confidence"), F.row_number().over(Window.orderBy(F.desc("similarity"), key)).alias("rank"))


def _blocks(queries: DataFrame, query_key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and vectors, SENT_BYTES at a time; the driver holds one block."""

    def block(rows: list) -> tuple[list, np.ndarray]:
        m = np.zeros((len(rows), max(len(v) for _, v in rows)))
        for j, (_, v) in enumerate(rows):
            m[j, : len(v)] = v
        return [q for q, _ in rows], m

    rows, size = [], 0
    for q, v in queries.select(query_key, vector).orderBy(query_key).toLocalIterator():
        rows.append((q, v))
        size += 8 * max(1, len(v))
        if size >= SENT_BYTES:
            yield block(rows)
            rows, size = [], 0
    if rows:
        yield block(rows)


def _matrix(column: pa.ListArray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's vectors, cut or filled with 0 to a width, and the norms of the whole ones; null as empty."""
    lens = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out, own = np.zeros((len(lens), wide)), place < wide
    out[row[own], place[own]] = flat[own]
    return out, np.sqrt(np.bincount(row, flat * flat, minlength=len(lens)))


def similarity_batch(store: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None, key: str = "memory_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows for each query: blocks of vectors times blocks of queries; each batch hands on its own k best only.

    The query set is the caller's bounded one; it is sent in blocks of SENT_BYTES. Scores have 6 decimals, ties go by key.
    """
    out = None
    for ids, m in _blocks(queries, query_key, vector):
        sent = store.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            qn = np.linalg.norm(q, axis=1)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    v, n = _matrix(part.column(1), q.shape[1])
                    size = np.outer(qn, n)
                    sims = np.round(np.where(size > 1e-12, (q @ v.T) / np.maximum(size, 1e-300), 0.0), 6) + 0.0
                    a, b, c = [], [], []
                    for i in np.flatnonzero(qn > 0):
                        # all rows that tie with the k-th are sorted, so that keys decide
                        near = np.arange(len(keys)) if len(keys) <= k else np.flatnonzero(~(sims[i] < -np.partition(-sims[i], k - 1)[k - 1]))
                        order = near[np.lexsort((keys[near], -sims[i][near]))[:k]]
                        if least is not None:
                            order = order[sims[i][order] >= least]
                        a += [ids[i]] * len(order)
                        b += keys[order].tolist()
                        c += sims[i][order].tolist()
                    yield pa.record_batch({"q": pa.array(a, pa.int64()), "k": pa.array(b, pa.int64()), "s": pa.array(c, pa.float64())})

        found = store.select(F.col(key).cast("long"), vector).mapInArrow(run, f"{query_key} long, {key} long, similarity double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return queries.select(F.col(query_key)).limit(0).select(query_key, F.lit(0).cast("long").alias(key), F.lit(0.0).alias("similarity"), F.lit(0.0).alias("confidence"), F.lit(0).alias("rank"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("confidence", vectors.rounded(vectors.confidence(F.col("similarity"))))


def has_confident_match(results: DataFrame, threshold: float = 0.7, query_key: str = "query_id") -> DataFrame:
    return results.groupBy(query_key).agg(F.max(F.col("similarity") > threshold).alias("confident"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"))


def text_similarity(store: DataFrame, queries: DataFrame, k: int = 10, dim: int = text.DIM) -> DataFrame:
    """Texts of both sides embedded, each different one once, then similarity_batch. store: memory_id, content; queries: query_id, content."""

    def embedded(rows: DataFrame, key: str) -> DataFrame:
        one = Window.partitionBy("content")
        rows = rows.select(key, "content", F.min(key).over(one).alias("_one"))
        vectors_ = text.embed_semantic(rows.where(F.col(key) == F.col("_one")), key, "content", dim)
        return rows.join(vectors_.withColumnRenamed(key, "_one"), "_one").select(key, "embedding")

    return similarity_batch(embedded(store, "memory_id"), embedded(queries, "query_id"), k)


def pattern_search(patterns: DataFrame, query: list[float], k: int, least: float = 0.0, key: str = "id") -> DataFrame:
    """Patterns by raw cosine of at least ``least``; zero vectors are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    cos = F.round(vectors.cosine(F.col("embedding"), q), 6)
    return patterns.where(vectors.norm(F.col("embedding")) > 0).select(key, cos.alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(k)


def pattern_list(patterns: DataFrame, least_activation: int = 0, limit: int = 100, key: str = "id") -> DataFrame:
    return patterns.where(F.col("activation_count") >= least_activation).orderBy(F.desc("activation_count"), key).limit(limit)


def pattern_compose(patterns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p_id, q_id, embedding): both patterns' elementwise product, normalised."""
    p = patterns.select(F.col("id").alias("p_id"), F.col("embedding").alias("p"))
    q = patterns.select(F.col("id").alias("q_id"), F.col("embedding").alias("q"))
    return pairs.join(p, "p_id").join(q, "q_id").select("p_id", "q_id", vectors.compose(F.col("p"), F.col("q")).alias("embedding"))


def pattern_touch(patterns: DataFrame, activations: DataFrame) -> DataFrame:
    """Activation counts and last steps from events (id, delta, step) over the stored ones."""
    seen = activations.groupBy("id").agg(F.sum("delta").alias("d"), F.max("step").alias("s"))
    return patterns.join(seen, "id", "left").withColumn("activation_count", F.col("activation_count") + F.coalesce("d", F.lit(0))).withColumn("last_used_step", F.greatest("last_used_step", "s")).drop("d", "s")


def text_search(store: DataFrame, query: str, k: int = 10, key: str = "id") -> DataFrame:
    """Rows by the share of the query's words that they contain."""
    return store.select(key, F.round(text.token_share(F.col("content"), query), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def newest_containing(store: DataFrame, query: str, limit: int = 5, key: str = "id") -> DataFrame:
    """Rows that contain the whole query in any case, newest first; 100 at most."""
    return store.where(text.contains_query(F.col("content"), query)).orderBy(F.desc("created_at"), key).limit(min(limit, 100))


def discover(new: DataFrame, existing: DataFrame, least: float = 0.1, key: str = "id") -> DataFrame:
    """Associations from each new row to other rows by shared tags.

    Rows with the same tags are one class, and classes are compared, not rows: a tag that a third of all rows have costs
    what its classes do, and the join that gives the result puts nothing together again.
    """
    own = lambda df: df.select(F.col(key), F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).alias("class"))
    a, b = own(new), own(existing)
    tagged = lambda df, name: df.select(F.col("class").alias(name)).distinct().select(name, F.explode(name).alias("tag"))
    common = tagged(a, "ca").join(tagged(b, "cb"), "tag").groupBy("ca", "cb").agg(F.count("*").alias("common"))
    weight = F.round(F.col("common") / (F.size("ca") + F.size("cb") - F.col("common")), 6)
    pairs = common.withColumn("weight", weight).where(F.col("weight") >= least)
    out = a.select(F.col(key).alias("from_id"), F.col("class").alias("ca")).join(pairs, "ca").join(b.select(F.col(key).alias("to_id"), F.col("class").alias("cb")), "cb").where("from_id <> to_id")
    return out.select(text.association_id(F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id", F.lit("semantic").alias("type"), "weight", F.format_string("Common tags: %d", "common").alias("reason"))


def touch(memories: DataFrame, accesses: DataFrame, key: str = "memory_id") -> DataFrame:
    """Access counts and times from an access log over the stored ones."""
    seen = accesses.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    return memories.join(seen, key, "left").withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "t")).drop("n", "t")


def get_memories(memories: DataFrame, wanted: DataFrame, as_of: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The wanted ids' rows, found or not, with the access that this is counted, and all memories with it.

    wanted: id, one row for each request; an id that is asked for several times is accessed as often.
    """
    asked = wanted.groupBy(key).agg(F.count("*").alias("_n"))
    now = F.lit(as_of).cast("timestamp")
    hit = F.col("_n").isNotNull()
    after = memories.join(asked, key, "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.when(hit, F.greatest("last_accessed", now)).otherwise(F.col("last_accessed")))
    got = asked.select(key).join(after.where(hit).drop("_n").withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return got, after.drop("_n")


def list_memories(memories: DataFrame, limit: int | None = None, key: str = "id") -> DataFrame:
    """The first rows by id: 100, or as many as asked for if that is 1 to 1000."""
    return memories.orderBy(key).limit(limit if limit is not None and 0 < limit <= 1000 else 100)
