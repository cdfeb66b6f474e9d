"""Weighted directed graph search and upkeep. Edges: from_id, to_id, type, weight; searches start from (query_id, start_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.shared import running_total

#: Deepest search that is allowed; deeper ones are refused.
MAX_DEPTH = 10


def _levels(max_depth: int) -> range:
    if max_depth > MAX_DEPTH:
        raise ValueError(f"a search goes {MAX_DEPTH} levels deep at most, not {max_depth}")
    return range(max_depth)


def usable_edges(edges: DataFrame, nodes: DataFrame | None = None, least: float = 0.1, types: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Edges by weight, type and the target's tags; empty lists don't filter."""
    out = edges.where(F.col("weight") >= least)
    if types:
        out = out.where(F.col("type").isin(types))
    if tags:
        wanted = nodes.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))).select(F.col("id").alias("to_id"))
        out = out.join(wanted, "to_id", "left_semi")
    return out.select("from_id", "to_id", "weight")


def latest_edges(edges: DataFrame, order: str) -> DataFrame:
    """One traversable edge for each (from, to): the last one."""
    w = Window.partitionBy("from_id", "to_id").orderBy(F.desc(order))
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """The nodes' edges out of them, or with "in" those into them."""
    end = {"out": "from_id", "in": "to_id"}[direction]
    return edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")


def _begin(starts: DataFrame) -> DataFrame:
    return starts.select("query_id", "start_id", F.col("start_id").alias("node"), F.lit(1.0).alias("weight"), F.lit(0).alias("depth"), F.array("start_id").alias("path"))


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """Depth-first semantics: a row for each simple path, its weight the product of its edges' weights."""
    level, out = _begin(starts), None
    for _ in _levels(max_depth):
        step = level.join(edges.select(F.col("from_id").alias("node"), F.col("to_id"), F.col("weight").alias("w")), "node").where(~F.array_contains("path", F.col("to_id")))
        level = step.select("query_id", "start_id", F.col("to_id").alias("node"), (F.col("weight") * F.col("w")).alias("weight"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("to_id")).alias("path"))
        out = level if out is None else out.unionAll(level)
    return out


def _group(per_source: bool) -> list[str]:
    return ["query_id", "start_id"] if per_source else ["query_id"]


def breadth_first(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_results: int | None = None, per_source: bool = True, cut=None) -> DataFrame:
    """First visits level by level. Within a level nodes are found in order of their parent's turn, then of their id.

    The first ``max_results`` found stay, then ``rank`` orders them by weight. cut: called on each level, to end its
    lineage; with one, a level's nodes are numbered in parts.
    """
    by = _group(per_source)
    alone, cut = cut is None, cut or (lambda df: df)

    def turns(df: DataFrame) -> DataFrame:
        if alone:
            return df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "node")))
        numbered = running_total(df.withColumnRenamed("turn", "_before"), by, ["_before", "node"], F.lit(1), "turn", cut)
        return cut(numbered.drop("_before"))

    level = _begin(starts).withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("start_id")))
    visited, out = level.select(*by, "node").distinct(), None
    for _ in _levels(max_depth):
        step = level.join(edges.select(F.col("from_id").alias("node"), F.col("to_id"), F.col("weight").alias("w")), "node")
        step = step.select("query_id", "start_id", F.col("to_id").alias("node"), (F.col("weight") * F.col("w")).alias("weight"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("to_id")).alias("path"), "turn")
        step = step.join(visited, [*by, "node"], "left_anti")
        first = F.row_number().over(Window.partitionBy(*by, "node").orderBy("turn"))
        new = step.withColumn("_r", first).where("_r = 1").drop("_r")
        level = turns(new)
        visited = cut(visited.unionByName(level.select(*by, "node")))
        out = level if out is None else out.unionByName(level)
    # a node's place is its turn behind all of the levels before its own
    sizes = out.groupBy(*by, "depth").agg(F.max("turn").alias("_n"))
    base = sizes.select(*by, "depth", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    found = out.join(base, [*by, "depth"]).withColumn("found", (F.col("turn") + F.col("_base")).cast("int")).drop("turn", "_base")
    if max_results is not None:
        found = found.where(F.col("found") <= max_results)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("weight", 6)), "node")))


def best_first(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_results: int = 10, cost: bool = False, cut=lambda df: df) -> DataFrame:
    """Each node as a queue by priority first takes it, within max_depth edges: by greatest product of weights, or with cost by least sum of 1 - weight.

    A node keeps the path by which it is taken first, and its neighbours go on from there: a worse but shorter path to
    it doesn't carry them further. Labels (value, depth) are derived anew from those of the round before until they stay
    the same; one row for each node and round, so work follows nodes and edges, not paths. Of equal values the shorter
    path is taken, then the one by the smaller parent.
    """
    _levels(max_depth)
    sign = 1 if cost else -1
    own = starts.select("query_id", F.col("start_id").alias("node")).distinct()
    begin = own.select("query_id", "node", F.lit(0.0 if cost else -1.0).alias("key"), F.lit(0).alias("depth"))
    label, before, now = cut(begin), None, ()
    while now != before:
        before = now
        step = label.where(F.col("depth") < max_depth).join(edges.select(F.col("from_id").alias("node"), F.col("to_id"), F.col("weight").alias("w")), "node")
        key = F.col("key") + (1 - F.col("w")) if cost else F.col("key") * F.col("w")
        found = step.groupBy("query_id", "to_id").agg(F.min(F.struct(F.round(key, 12).alias("key"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))).alias("x"))
        found = found.select("query_id", F.col("to_id").alias("node"), "x.key", "x.depth").join(own, ["query_id", "node"], "left_anti")
        label = cut(begin.unionByName(found))
        now = tuple(label.agg(F.count("*"), F.sum(F.xxhash64("query_id", "node", "key", "depth").cast("decimal(38,0)"))).first())
    top = label.join(own, ["query_id", "node"], "left_anti").select("query_id", "node", F.round(sign * F.col("key"), 6).alias("value"), "depth")
    order = F.asc("value") if cost else F.desc("value")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "node"))).where(F.col("rank") <= max_results)


def search_summary(results: DataFrame, starts: DataFrame) -> DataFrame:
    """For each query the results, the nodes that were looked at (the starts and what was found) and the paths; 0 found where nothing was."""
    found = results.groupBy("query_id").agg(F.count("*").alias("n"))
    begun = starts.groupBy("query_id").agg(F.countDistinct("start_id").alias("s"))
    n = F.coalesce("n", F.lit(0))
    return begun.join(found, "query_id", "left").select("query_id", n.alias("total_found"), (n + F.col("s")).alias("nodes_explored"), n.alias("paths_found"))


def search(edges: DataFrame, starts: DataFrame, max_depth: int, max_results: int, sources: int, mode: str = "auto", cut=None) -> DataFrame:
    """By shape of the query: one start and at most two levels, several starts and at most three, or deeper; or by mode."""
    if mode == "depth_first":
        paths = simple_paths(edges, starts, max_depth)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 6)), "path"))
        return paths.withColumn("rank", rank).where(F.col("rank") <= max_results)
    if mode == "best_first" or mode == "auto" and max_depth > 3:
        return best_first(edges, starts, max_depth, max_results, cost=mode == "auto", cut=cut or (lambda df: df))
    if mode == "auto" and sources > 1:
        per = breadth_first(edges, starts, max_depth, max_results // sources + 10, True, cut)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 6)), "node", "start_id"))
        return per.withColumn("rank", rank).where(F.col("rank") <= max_results)
    return breadth_first(edges, starts, max_depth, max_results, False, cut)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average and greatest degree, density."""
    n = nodes.agg(F.count("*").alias("nodes"))
    d = degrees(edges).agg(F.sum(F.col("out_degree")).alias("edges"), F.max(F.col("out_degree") + F.col("in_degree")).alias("max_degree"))
    both = n.join(d, F.lit(True))
    e, k = F.coalesce("edges", F.lit(0)), F.col("nodes")
    return both.select("nodes", e.alias("edges"), F.round(F.when(k > 0, 2 * e / k).otherwise(0.0), 6).alias("avg_degree"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"), F.round(F.when(k > 1, e / (k * (k - 1))).otherwise(0.0), 9).alias("density"))


def components(nodes: DataFrame, edges: DataFrame, cut) -> DataFrame:
    """Weakly connected components as (id, component = smallest id): minima move along edges and jump to their own minimum.

    Rounds go on until nothing changes; jumps keep them few. cut(df) must end the lineage in files that all executors share.
    """
    both = cut(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionAll(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).where("a <> b").distinct())
    label, done = cut(nodes.select("id").distinct().withColumn("c", F.col("id"))), False
    while not done:
        low = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        new = label.join(low, "id", "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("before"))
        jump = new.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(new.join(jump, "c", "left").select("id", F.least("c", "cc").alias("c"), "before"))
        done = new.where("c <> before").isEmpty()
        label = new.select("id", "c")
    return label.select("id", F.col("c").alias("component"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends stored, ids that are not 0, a weight in [0, 1]; one for each id where edges have ids."""
    ok = edges.where("from_id <> 0 and to_id <> 0 and weight between 0 and 1")
    for end in ("from_id", "to_id"):
        ok = ok.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return ok.dropDuplicates(["id"]) if "id" in ok.columns else ok


def violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").unionByName(edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_anti")).distinct()


def cap_out_edges(edges: DataFrame, most: int, score: Column) -> DataFrame:
    """The best ``most`` out-edges of each node."""
    w = Window.partitionBy("from_id").orderBy(F.desc("_s"), "to_id")
    return edges.withColumn("_s", score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "_s")


def decay(edges: DataFrame, rate: float = 0.01, ticks: int = 1) -> DataFrame:
    return edges.withColumn("weight", F.col("weight") * F.pow(F.lit(1 - rate), F.lit(ticks)))


def expire_edges(edges: DataFrame, as_of: str | Column, hours: int = 24) -> DataFrame:
    return edges.where(F.col("last_used") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))


def linked_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    return nodes.join(degrees(edges).select("id"), "id", "left_semi")


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the gone nodes and whatever touches them."""
    left = edges
    for end in ("from_id", "to_id"):
        left = left.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left


def close_connection(nodes: DataFrame, edges: DataFrame, connection: str) -> tuple[DataFrame, DataFrame]:
    """Without the connection's edges, and without those of its nodes that then have none."""
    left = edges.where(~F.col("connection_id").eqNullSafe(connection))
    own = nodes.where(F.col("connection_id").eqNullSafe(connection))
    gone = own.join(degrees(left).select("id"), "id", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left


def garbage(nodes: DataFrame, edges: DataFrame, as_of: str | Column, days: int = 30, least: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Without memories that were never used before the cutoff, and without weak edges."""
    old = F.col("last_accessed") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    kept, left = drop_nodes(nodes, edges, nodes.where(old & (F.col("access_count") == 0)))
    return kept, left.where(F.col("weight") >= least)
