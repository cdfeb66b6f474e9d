"""Writing a memory to every family and asking all of them, as plans over one canonical table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families in the order in which a memory is written, and those without which it isn't stored.
WRITE_ORDER, NEEDED = (3, 1, 2, 4, 5), (3, 1)
#: Families that keep associations.
ASSOCIATION_LAYERS = (3, 4)

Writer = Callable[[DataFrame], DataFrame]


def views(memories: DataFrame) -> dict[int, DataFrame]:
    """What each family keeps of memories (pool, id, content, tags, embedding, ts_us): keys, vectors, nodes, accesses, patterns."""
    return {
        1: memories.select("pool", F.col("content").alias("key"), F.col("id").alias("value")),
        2: memories.where("embedding is not null").select("pool", F.col("id").alias("memory_id"), "embedding"),
        3: memories.where("id <> 0").dropDuplicates(["pool", "id"]).select("pool", "id", "content", "tags"),
        4: memories.select("pool", F.col("id").alias("memory_id"), "ts_us", F.lit("write").alias("access_type")),
        5: memories.where("embedding is not null").select("pool", "id", F.substring("content", 1, 50).alias("name"), F.lit("Transformational").alias("category"), "embedding"),
    }


def store_everywhere(memories: DataFrame, writers: dict[int, Writer]) -> tuple[dict[int, DataFrame], dict[int, Exception]]:
    """Each family's rows as its writer gives them back; a family that fails doesn't keep the others from being written."""
    if not writers:
        raise ValueError("no family to write to")
    done, failed, own = {}, {}, views(memories)
    for n in [n for n in WRITE_ORDER if n in writers]:
        try:
            done[n] = writers[n](own[n])
        except Exception as e:
            failed[n] = e
    return done, failed


def associate_everywhere(edges: DataFrame, writers: dict[int, Writer]) -> tuple[dict[int, DataFrame], dict[int, Exception]]:
    """Associations to the families that keep them."""
    done, failed = {}, {}
    for n in [n for n in ASSOCIATION_LAYERS if n in writers]:
        try:
            done[n] = writers[n](edges)
        except Exception as e:
            failed[n] = e
    return done, failed


def write_outcomes(written: DataFrame) -> DataFrame:
    """One row for each memory from (id, layer, success): stored if the needed families have it, with confidence 0.9."""
    ok = F.col("success")
    per = written.groupBy("id").agg(*[F.max(ok & (F.col("layer") == n)).alias(f"l{n}") for n in NEEDED], F.count_if(ok).alias("layers"))
    stored = per.withColumn("success", F.col("l3") & F.col("l1"))
    return stored.select("id", "success", "layers", F.when(F.col("success"), "stored").otherwise("failed").alias("decision"), F.when(F.col("success"), 0.9).otherwise(0.0).alias("confidence"))


def query_outcomes(queries: DataFrame, exact: DataFrame, answers: dict[int, DataFrame]) -> DataFrame:
    """Each query's decision: an exact match (confidence 1), which the similar ones aren't asked behind, or a similarity search (0.7).

    exact: query_id, memory_id; answers: families 2 to 5 as (query_id, memory_id). Counts are of the families that were asked.
    """
    out = queries.select("query_id").join(exact.groupBy("query_id").agg(F.count("*").alias("l1")), "query_id", "left")
    hit = F.col("l1").isNotNull()
    for n, rows in sorted(answers.items()):
        out = out.join(rows.groupBy("query_id").agg(F.count("*").alias(f"l{n}")), "query_id", "left")
    n = {f"l{n}": F.coalesce(f"l{n}", F.lit(0)) for n in answers}
    if "l2" in n:
        n["l2"] = F.when(hit, 0).otherwise(n["l2"])
    return out.select("query_id", F.when(hit, "exact_match").otherwise("similarity_search").alias("decision"), F.when(hit, 1.0).otherwise(0.7).alias("confidence"), *[c.cast("long").alias(k) for k, c in n.items()])
