"""Routing a batch of queries across retrieval families and merging their ranked results.

Queries: query_id, content, has_embedding, start_ids, assoc_types, tags, min_weight, max_depth, params (a map).
A layer is a function from the queries it is given to rows (query_id, memory_id, confidence).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Layer = Callable[[DataFrame], DataFrame]
TEMPORAL = ("temporal_context", "predict_next", "context_window")


def classify(queries: DataFrame) -> DataFrame:
    """route, its confidence and layers, by the first rule that holds: exact, similarity, association, temporal, all."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    embedded = F.coalesce("has_embedding", F.lit(False))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    temporal = F.coalesce(F.arrays_overlap(F.map_keys("params"), F.array(*[F.lit(t) for t in TEMPORAL])), F.lit(False))
    association = ((n("assoc_types") > 0) | (n("tags") > 0) | ((n("start_ids") > 0) & (F.col("max_depth") > 1))) & ~temporal
    exact = (size > 0) & (size < 100) & (F.col("min_weight") >= 0.9) & ~embedded & (n("assoc_types") == 0)
    similar = (embedded | (size > 20)) & (F.col("min_weight") < 0.9) & (n("assoc_types") == 0) & ~association

    def pick(*choices: Column) -> Column:
        out = F.when(exact, choices[0])
        for rule, c in zip((similar, association, temporal), choices[1:]):
            out = out.when(rule, c)
        return out.otherwise(choices[-1])

    lit = F.lit
    layers = pick(F.array(lit(1)), F.array(lit(1), lit(2)), F.when(embedded, F.array(lit(2), lit(3))).otherwise(F.array(lit(3))), F.array(lit(3), lit(4)), F.array(lit(1), lit(2), lit(3), lit(4)))
    return queries.withColumn("route", pick(lit("exact"), lit("similarity"), lit("association"), lit("temporal"), lit("all"))).withColumn("route_confidence", pick(lit(0.95), lit(0.85), lit(0.8), lit(0.75), lit(0.5))).withColumn("layers", layers)


def _tagged(layer: int, rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "memory_id", F.col("confidence").cast("double").alias("confidence"), F.lit(layer).alias("layer"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "memory_id", "layer"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_best(rows: DataFrame) -> DataFrame:
    """The best row of each (query, memory)."""
    w = Window.partitionBy("query_id", "memory_id").orderBy(F.desc("confidence"), "layer")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def parallel(queries: DataFrame, layers: dict[int, Layer], k: int = 10, failures: list[tuple[int, Exception]] | None = None) -> DataFrame:
    """All layers at once, one row for each memory. With a list for failures, a layer that can't be planned is left out and noted there."""
    parts = []
    for n, f in sorted(layers.items()):
        try:
            parts.append(_tagged(n, f(queries)))
        except Exception as e:
            if failures is None:
                raise
            failures.append((n, e))
    if not parts:
        raise RuntimeError("no layer answers") from (failures[-1][1] if failures else None)
    return top(distinct_best(_union(parts)), k)


def sequential(queries: DataFrame, layers: dict[int, Layer], k: int = 10, stop_at: float = 1.0) -> DataFrame:
    """Layers in turn; a query that the first layer answers with stop_at goes no further. Memories may repeat."""
    parts, open_ = [], queries
    for i, (n, f) in enumerate(sorted(layers.items())):
        got = _tagged(n, f(open_))
        parts.append(got)
        if i == 0:
            open_ = open_.join(got.where(F.col("confidence") >= stop_at).select("query_id").distinct(), "query_id", "left_anti")
    return top(_union(parts), k)


def adaptive(queries: DataFrame, layers: dict[int, Layer], k: int = 10) -> DataFrame:
    """Each layer sees the queries that are routed to it; without a registered layer a query goes to all."""
    routed = classify(queries)
    known = F.array(*[F.lit(n) for n in sorted(layers)])
    routed = routed.withColumn("layers", F.when(F.size(F.array_intersect("layers", known)) > 0, F.col("layers")).otherwise(known))
    parts = [_tagged(n, f(routed.where(F.array_contains("layers", n)).select(*queries.columns))) for n, f in sorted(layers.items())]
    return top(distinct_best(_union(parts)), k)


def custom(queries: DataFrame, layers: dict[int, Layer], order: list[int], k: int = 10) -> DataFrame:
    """Layers in a given order; a query stops when it has k results."""
    parts, open_ = [], queries
    for n in order:
        got = _tagged(n, layers[n](open_))
        parts.append(got)
        full = _union(parts).groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        open_ = open_.join(full, "query_id", "left_anti")
    return top(_union(parts), k)


def boosted(queries: DataFrame, layers: dict[int, Layer], k: int = 10, certain: float = 0.95, factor: float = 1.2) -> DataFrame:
    """Stops behind a first layer that is surer than ``certain``; the fourth layer's confidence counts more, 1 at most."""
    out = sequential(queries, layers, 1 << 30, certain + 1e-9).drop("rank")
    weight = F.when(F.col("layer") == 4, F.least(F.col("confidence") * factor, F.lit(1.0))).otherwise(F.col("confidence"))
    return top(distinct_best(out.withColumn("confidence", weight)), k)


def fallback(parts: list[DataFrame], k: int = 10) -> DataFrame:
    """For each query the rows of the first part that has any, newest first. parts: (query_id, memory_id, created_at)."""
    rows = _union([p.select("query_id", "memory_id", "created_at", F.lit(i).alias("priority")) for i, p in enumerate(parts)])
    first = F.min("priority").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_f", first).where("priority = _f").drop("_f")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "memory_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def simple_route(queries: DataFrame) -> DataFrame:
    """queries with the strategy: sequential for contents under 50 bytes, parallel for longer ones with an embedding, else sequential."""
    short = F.octet_length(F.coalesce("content", F.lit(""))) < 50
    return queries.withColumn("strategy", F.when(~short & F.coalesce("has_embedding", F.lit(False)), "parallel").otherwise("sequential"))


# fixed values: explicit operations and what they ask for (message, operation, layer)
OPERATIONS = {
    "add_memory": ("memory_add", "add", "layer1"), "memory_add": ("memory_add", "add", "layer1"),
    "get_memory": ("memory_get", "get", "layer3"), "memory_get": ("memory_get", "get", "layer3"),
    "search": ("search_associative", "search", "layer3"), "associative_search": ("search_associative", "search", "layer3"),
    "add_association": ("association_add", "add", "layer3"), "association_add": ("association_add", "add", "layer3"),
    "health_check": ("health_check", "health", "all"), "health": ("health_check", "health", "all"),
    "performance": ("performance", "metrics", "all"), "metrics": ("performance", "metrics", "all"),
}


def infer_operation(message: Column) -> Column:
    """What a JSON object asks for, as (message, operation, layer): its explicit operation, else by the keys that it has, whatever their values.

    An explicit operation is a text, in any case; one that isn't known, and a message that is no object, ask for nothing (null).
    """
    answer = lambda m, o, layer: F.struct(F.lit(m).alias("message"), F.lit(o).alias("operation"), F.lit(layer).alias("layer"))
    keys = F.json_object_keys(message)
    has = lambda *names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    given = F.try_variant_get(F.try_parse_json(message), "$.operation", "variant")
    explicit = F.schema_of_variant(given) == "STRING"
    known = F.create_map(*[x for name, a in OPERATIONS.items() for x in (F.lit(name), answer(*a))])
    return (
        F.when(keys.isNull(), F.lit(None))
        .when(F.coalesce(explicit, F.lit(False)), F.try_element_at(known, F.lower(F.get_json_object(message, "$.operation"))))
        .when(has("memory", "content"), answer("memory_add", "add", "layer1"))
        .when(has("search", "query"), answer("search_associative", "search", "layer3"))
        .when(has("association") | (has("from_memory_id") & has("to_memory_id")), answer("association_add", "add", "layer3"))
        .when(has("health", "status"), answer("health_check", "health", "all"))
        .otherwise(answer("memory_add", "add", "layer3"))
    )
