"""Sequence models of access logs: n-grams, transitions, adjacent repeats, interval model, and predictions from them.

Accesses: pool, seq, memory_id, ts_us, access_type. Every window runs within a pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores

LOOK_BACK = 50


def _order() -> Window:
    return Window.partitionBy("pool").orderBy("seq")


def ngrams(accesses: DataFrame, longest: int = 5) -> DataFrame:
    """pool, n, ngram, count, last_seen, first_seq, and the share of its order's total as confidence."""
    last = F.collect_list("memory_id").over(_order().rowsBetween(-(longest - 1), 0))
    rows = accesses.select("pool", "seq", "ts_us", last.alias("last")).where(F.size("last") >= 2)
    ends = F.transform(F.sequence(F.lit(2), F.size("last")), lambda n: F.struct(n.alias("n"), F.slice("last", F.size("last") - n + 1, n).alias("ngram")))
    every = rows.select("pool", "seq", "ts_us", F.explode(ends).alias("x")).select("pool", "seq", "ts_us", "x.n", "x.ngram")
    counted = every.groupBy("pool", "n", "ngram").agg(F.count("*").alias("count"), F.max("ts_us").alias("last_seen"), F.min("seq").alias("first_seq"))
    total = F.sum("count").over(Window.partitionBy("pool", "n"))
    return counted.withColumn("confidence", F.col("count") / total)


def admitted(grams: DataFrame, cap: int = 100) -> DataFrame:
    """The first ``cap`` n-grams of each order by first appearance."""
    w = Window.partitionBy("pool", "n").orderBy("first_seq")
    return grams.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def gram_history(accesses: DataFrame, n: int, intervals: int = 100, contexts: int = 50) -> DataFrame:
    """The last intervals between an n-gram's appearances, and the contexts of its last ones; both in order. accesses may have user_context."""
    gram = F.collect_list("memory_id").over(_order().rowsBetween(-(n - 1), 0))
    context = F.col("user_context") if "user_context" in accesses.columns else F.lit(None).cast("string")
    rows = accesses.select("pool", "seq", "ts_us", context.alias("context"), gram.alias("ngram")).where(F.size("ngram") == n)
    own = Window.partitionBy("pool", "ngram")
    before = F.lag("ts_us").over(own.orderBy("seq"))
    rows = rows.withColumn("dt", F.when(before.isNotNull(), F.greatest(F.col("ts_us") - before, F.lit(0))))
    rows = rows.withColumn("back", F.row_number().over(own.orderBy(F.desc("seq")))).withColumn("cback", F.count("context").over(own.orderBy(F.desc("seq"))))
    kept = lambda value, most: F.transform(F.array_sort(F.collect_list(F.when(most, F.struct("seq", value)))), lambda x: x[value])
    # the first appearance has a context but no interval
    return rows.groupBy("pool", "ngram").agg(
        F.count("*").alias("count"), F.max_by("dt", "seq").alias("last_interval_us"),
        kept("dt", F.col("dt").isNotNull() & (F.col("back") <= intervals)).alias("intervals"), kept("context", F.col("context").isNotNull() & (F.col("cback") <= contexts)).alias("contexts"),
    )


def transitions(accesses: DataFrame) -> DataFrame:
    """pool, from_id, to_id, count, probability over the row, and the halving average of the intervals in order.

    Halving in whole numbers, (0 + x1) / 2, then (that + x2) / 2 and so on, is the whole part of the sum of x / 2 ** (k + 1)
    over intervals that k others follow. Sums of 64 intervals each are combined before the shuffle, and carried from the
    oldest to the newest.
    """
    w = _order()
    step = accesses.select("pool", "seq", F.lag("memory_id").over(w).alias("from_id"), F.col("memory_id").alias("to_id"), F.greatest(F.col("ts_us") - F.lag("ts_us").over(w), F.lit(0)).alias("dt")).where("from_id is not null")
    k = F.row_number().over(Window.partitionBy("pool", "from_id", "to_id").orderBy(F.desc("seq"))) - 1
    scale = F.element_at(F.array(*[F.lit(str(1 << (63 - i))).cast("decimal(20,0)") for i in range(64)]), F.pmod("k", F.lit(64)) + 1)
    sums = step.withColumn("k", k).groupBy("pool", "from_id", "to_id", F.floor(F.col("k") / 64).alias("chunk")).agg(F.count("*").alias("n"), F.sum((F.col("dt").cast("decimal(18,0)") * scale).cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    counted = sums.groupBy("pool", "from_id", "to_id").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("chunk", "s")), asc=False).alias("chunks"))
    total = F.sum("count").over(Window.partitionBy("pool", "from_id"))
    fold = F.expr(f"aggregate(chunks, 0L, (a, x) -> cast((cast(a as decimal(38,0)) + x.s) div {1 << 64}BD as bigint))")
    return counted.select("pool", "from_id", "to_id", "count", (F.col("count") / total).alias("probability"), fold.alias("average_interval"))


def repeats(accesses: DataFrame, longest: int = 5) -> DataFrame:
    """Adjacent repeats of 3 .. longest accesses and how often a rescan of the last 50 after each access meets them.

    A repeat of length L at p is met at every access from p + 2L - 1 to the smaller of p + 49 and the last, so its share is
    the size of that range. Average interval and variance come from the first copy that is found.
    """
    rows = accesses.select("pool", "seq", "memory_id", "ts_us", "access_type")
    place = rows.withColumn("p", F.row_number().over(_order()) - 1).withColumn("last", F.count("*").over(Window.partitionBy("pool")) - 1)
    most = min(8, longest)
    ahead = _order().rowsBetween(0, 2 * most - 1)
    wide = place.select("pool", "p", "last", F.collect_list("memory_id").over(ahead).alias("ids"), F.collect_list(F.coalesce("access_type", F.lit(""))).over(ahead).alias("types"), F.collect_list("ts_us").over(ahead).alias("times"))

    def copy(n: int) -> Column:
        """A repeat of n accesses that begins here, or null."""
        share = F.greatest(F.least(F.col("p") + LOOK_BACK - 1, F.col("last")) - (F.col("p") + 2 * n - 1) + 1, F.lit(0))
        twice = (F.size("ids") >= 2 * n) & (F.slice("ids", 1, n) == F.slice("ids", n + 1, n))
        return F.when(twice, F.struct(F.slice("ids", 1, n).alias("sequence"), F.slice("types", 1, n).alias("access_types"), F.slice("times", 1, n).alias("times"), share.alias("share"), F.lit(n).alias("length")))

    every = wide.select("pool", "p", F.explode(F.array(*[copy(n) for n in range(3, most + 1)])).alias("x")).where("x.share > 0").select("pool", "p", "x.*")
    agg = every.groupBy("pool", "sequence", "access_types", "length").agg(F.sum("share").alias("occurrences"), F.min_by("times", "p").alias("times"))
    gaps = F.transform(F.sequence(F.lit(2), F.col("length")), lambda i: F.greatest(F.element_at("times", i) - F.element_at("times", i - 1), F.lit(0)))
    agg = agg.withColumn("gaps", gaps)
    mean = F.expr("aggregate(gaps, 0L, (a, x) -> a + x) div size(gaps)")
    agg = agg.withColumn("average_interval_us", mean)
    var = F.expr("aggregate(gaps, 0D, (a, x) -> a + pow(x - average_interval_us, 2)) / size(gaps)")
    return agg.select("pool", "sequence", "access_types", "length", "occurrences", (F.col("occurrences") / (F.col("occurrences") + 1)).alias("confidence"), "average_interval_us", var.alias("interval_variance"))


def interval_model(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pool").agg(F.avg("average_interval_us").alias("mean"), F.var_pop("average_interval_us").alias("variance"), F.count("*").alias("patterns"))


def recent(accesses: DataFrame, n: int = 10) -> DataFrame:
    """The last n accesses of each pool as one context."""
    w = Window.partitionBy("pool").orderBy(F.desc("seq"))
    last = accesses.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy("pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "memory_id"))), lambda x: x["memory_id"]).alias("recent"), F.max("ts_us").alias("now_us"))


def _prediction(kind: str, confidence: Column, order: Column, evidence: Column) -> list[Column]:
    return ["pool", F.col("memory_id"), confidence.alias("confidence"), F.lit(kind).alias("prediction_type"), order.alias("turn"), evidence.alias("evidence")]


def predict_ngram(grams: DataFrame, contexts: DataFrame, least: float = 0.1) -> DataFrame:
    """Last elements of n-grams that begin with the context's end."""
    g = grams.withColumn("prefix", F.slice("ngram", F.lit(1), F.col("n") - 1)).withColumn("memory_id", F.element_at("ngram", -1))
    c = contexts.select("pool", "recent", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("n")).where(F.size("recent") >= F.col("n") - 1)
    c = c.withColumn("prefix", F.slice("recent", -(F.col("n") - 1), F.col("n") - 1)).drop("recent")
    hit = g.join(c, ["pool", "n", "prefix"]).where(F.col("confidence") >= least)
    return hit.select(*_prediction("ngram", F.col("confidence"), F.lit(10) - F.col("n"), F.format_string("ngram-%d", "n")))


def predict_markov(moves: DataFrame, contexts: DataFrame, least: float = 0.1) -> DataFrame:
    c = contexts.select("pool", F.element_at("recent", -1).alias("from_id"))
    hit = moves.join(c, ["pool", "from_id"]).where(F.col("probability") >= least).withColumn("memory_id", F.col("to_id"))
    return hit.select(*_prediction("markov", F.col("probability"), F.lit(20), F.lit("transition")))


def predict_completion(patterns: DataFrame, contexts: DataFrame, least: float = 0.1) -> DataFrame:
    """The next element of repeats of which the context is a proper beginning, at 0.8 of their confidence."""
    hit = patterns.join(contexts, "pool").where((F.size("recent") < F.col("length")) & (F.slice("sequence", F.lit(1), F.size("recent")) == F.col("recent")))
    hit = hit.withColumn("memory_id", F.element_at("sequence", F.size("recent") + 1)).withColumn("c", F.col("confidence") * 0.8).where(F.col("c") >= least)
    return hit.select(*_prediction("completion", F.col("c"), F.lit(30), F.lit("pattern")))


def predict_statistical(moves: DataFrame, patterns: DataFrame, contexts: DataFrame, least: float = 0.1) -> DataFrame:
    """Repeats by their interval's probability, and transitions at 0.9."""
    model = interval_model(patterns)
    timed = patterns.join(contexts, "pool").join(model.select("pool", "mean", "variance"), "pool")
    timed = timed.withColumn("at", scores.position_in_pattern(F.col("recent"), F.col("sequence"))).where((F.col("at") > 0) & (F.col("at") < F.col("length")))
    p = scores.interval_probability(F.col("average_interval_us").cast("double"), F.col("mean"), F.col("variance"))
    timed = timed.withColumn("p", p).where(F.col("p") > least).withColumn("memory_id", F.element_at("sequence", F.col("at").cast("int") + 1))
    a = timed.select(*_prediction("statistical", 0.6 * F.col("p") + 0.4 * F.col("confidence"), F.lit(40), F.lit("timing")))
    c = contexts.select("pool", F.element_at("recent", -1).alias("from_id"))
    b = moves.join(c, ["pool", "from_id"]).where(F.col("probability") >= least).withColumn("memory_id", F.col("to_id"))
    return a.unionAll(b.select(*_prediction("statistical", 0.9 * F.col("probability"), F.lit(41), F.lit("transition"))))


def merge_predictions(predictions: DataFrame, least: float = 0.1) -> DataFrame:
    """One row for each memory: confidences halved together in order of turn, the first one's type, all evidence.

    The first evidence counts twice, as the first prediction is merged with itself.
    """
    rows = predictions.groupBy("pool", "memory_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.round("confidence", 12).alias("confidence"), "prediction_type", "evidence"))).alias("l"))
    fold = F.aggregate("l", F.col("l")[0]["confidence"], lambda a, x: (a + x["confidence"]) / 2)
    evidence = F.concat(F.array(F.col("l")[0]["evidence"]), F.transform("l", lambda x: x["evidence"]))
    out = rows.select("pool", "memory_id", F.round(fold, 6).alias("confidence"), F.col("l")[0]["prediction_type"].alias("prediction_type"), evidence.alias("contributing_evidence")).where(F.col("confidence") >= least)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("confidence"), "memory_id")))


def fit(accesses: DataFrame, longest: int = 5) -> dict[str, DataFrame]:
    return {"ngrams": ngrams(accesses, longest), "transitions": transitions(accesses), "repeats": repeats(accesses, longest)}


def predict(model: dict[str, DataFrame], contexts: DataFrame, least: float = 0.1) -> DataFrame:
    parts = predict_ngram(model["ngrams"], contexts, least)
    parts = parts.unionAll(predict_markov(model["transitions"], contexts, least)).unionAll(predict_completion(model["repeats"], contexts, least))
    return merge_predictions(parts.unionAll(predict_statistical(model["transitions"], model["repeats"], contexts, least)), least)


def next_occurrence(now_us: Column, average_us: Column, position: Column, length: Column) -> Column:
    """When a pattern's next element is due."""
    return F.when(position < length, now_us + average_us).otherwise(now_us + average_us * length)


def best_hits(results: DataFrame, threshold: float, top: int = 5) -> DataFrame:
    """Each query's best hits above a threshold, as accesses in order of queries: the input of co_access."""
    rank = F.row_number().over(Window.partitionBy("pool", "query_id").orderBy(F.desc("similarity"), "memory_id"))
    kept = results.where(F.col("similarity") > threshold).withColumn("_r", rank).where(F.col("_r") <= top)
    return kept.select("pool", "query_id", "memory_id", (F.col("query_id") * top + F.col("_r")).alias("seq"))


def co_access_by_query(hits: DataFrame, window: int = 10, top: int = 5) -> DataFrame:
    """Counts of (earlier, later) memories: each query's hits, ``top`` at most, with the last ``window`` hits before that query."""
    place = F.row_number().over(Window.partitionBy("pool").orderBy("seq"))
    rows = hits.withColumn("_p", place).withColumn("_first", F.min("_p").over(Window.partitionBy("pool", "query_id")))
    # up to top - 1 hits of its own query lie between
    back = Window.partitionBy("pool").orderBy("_p").rowsBetween(-(window + top), -1)
    rows = rows.withColumn("_before", F.collect_list(F.struct("_p", "memory_id")).over(back))
    near = F.filter("_before", lambda x: (x["_p"] < F.col("_first")) & (x["_p"] >= F.col("_first") - window))
    pairs = rows.select("pool", "memory_id", F.explode(near).alias("x")).select("pool", F.col("x.memory_id").alias("a"), F.col("memory_id").alias("b")).where("a <> b")
    return pairs.groupBy("pool", "a", "b").agg(F.count("*").alias("n"))


def co_access(hits: DataFrame, window: int = 10) -> DataFrame:
    """Counts of (earlier, later) memories among each query's hits and the last ``window`` ones before it. hits: pool, seq, memory_id."""
    w = Window.partitionBy("pool").orderBy("seq").rowsBetween(-window, -1)
    pairs = hits.withColumn("before", F.collect_list("memory_id").over(w)).select("pool", F.explode("before").alias("a"), F.col("memory_id").alias("b")).where("a <> b")
    return pairs.groupBy("pool", "a", "b").agg(F.count("*").alias("n"))


def pattern_strength(patterns: DataFrame, memory_id: int) -> DataFrame:
    return patterns.groupBy("pool").agg(F.avg(F.array_contains("sequence", memory_id).cast("double")).alias("strength"), F.avg("confidence").alias("avg_confidence"))


def get_patterns(patterns: DataFrame, kind: str | None = None, least: float = 0.1) -> DataFrame:
    """Patterns of a kind, or of all kinds, that are confident enough."""
    out = patterns.where(F.col("confidence") >= least)
    return out if kind is None else out.where(F.col("pattern_type") == kind)


def access_history(accesses: DataFrame, memory_id: int | None = None) -> DataFrame:
    """A memory's accesses; all of them without a memory or with 0."""
    return accesses.where(F.col("memory_id") == memory_id) if memory_id else accesses


def resolve_contents(stored: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each context's texts as memory ids in order, unknown texts dropped; the last writer of a text in a pool counts.

    stored: pool, seq, content, memory_id; contexts: pool, context_id, position, content.
    """
    known = stored.groupBy("pool", "content").agg(F.max_by("memory_id", "seq").alias("memory_id"))
    hit = contexts.join(known, ["pool", "content"]).groupBy("pool", "context_id")
    return hit.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "memory_id"))), lambda x: x["memory_id"]).alias("recent"))


def with_content(predictions: DataFrame, stored: DataFrame) -> DataFrame:
    """Predictions with their memory's text, or memory_<id> where none is stored; of several texts the last written."""
    own = stored.groupBy("pool", "memory_id").agg(F.max_by("content", "seq").alias("content"))
    return predictions.join(own, ["pool", "memory_id"], "left").withColumn("content", F.coalesce("content", F.concat(F.lit("memory_"), F.col("memory_id").cast("string"))))


def learn(accesses: DataFrame, new: DataFrame) -> DataFrame:
    """The log with further accesses behind it, reads unless they say otherwise. new: pool, memory_id, ts_us and an order, turn."""
    last = accesses.groupBy("pool").agg(F.max("seq").alias("_last"))
    kind = F.coalesce(F.col("access_type"), F.lit("read")) if "access_type" in new.columns else F.lit("read")
    place = F.row_number().over(Window.partitionBy("pool").orderBy("turn"))
    more = new.join(last, "pool", "left").select("pool", (F.coalesce("_last", F.lit(0)) + place).alias("seq"), "memory_id", "ts_us", kind.alias("access_type"))
    return accesses.select("pool", "seq", "memory_id", "ts_us", "access_type").unionByName(more)


def forget(accesses: DataFrame, pools: list) -> DataFrame:
    """The log without what these pools have learned."""
    return accesses.where(~F.col("pool").isin(pools))


def context_state(accesses: DataFrame, patterns: DataFrame, accuracy: DataFrame, learning_rate: float = 0.1) -> DataFrame:
    """Each pool's active patterns, accesses in the window, running accuracy and learning rate. accuracy: pool, ema."""
    n = patterns.groupBy("pool").agg(F.count("*").alias("active_patterns"))
    out = accesses.groupBy("pool").agg(F.count("*").alias("context_window_size")).join(n, "pool", "left").join(accuracy, "pool", "left")
    return out.select("pool", F.coalesce("active_patterns", F.lit(0)).alias("active_patterns"), "context_window_size", F.coalesce("ema", F.lit(0.0)).alias("prediction_accuracy"), F.lit(learning_rate).alias("learning_rate"))


def predictor_health(pools: DataFrame, patterns: DataFrame) -> DataFrame:
    """healthy with a mean confidence over 0.3, starting without patterns, else degraded."""
    per = patterns.groupBy("pool").agg(F.avg("confidence").alias("avg_confidence"), F.count("*").alias("patterns"))
    n, c = F.coalesce("patterns", F.lit(0)), F.coalesce("avg_confidence", F.lit(0.0))
    status = F.when(c > 0.3, "healthy").when(n == 0, "starting").otherwise("degraded")
    return pools.join(per, "pool", "left").select("pool", n.alias("patterns"), c.alias("avg_confidence"), status.alias("status"))


def context_features(accesses: DataFrame, memory_id: int) -> DataFrame:
    """Each pool's accesses, how long they took, and a memory's share of them."""
    n = F.count("*")
    return accesses.groupBy("pool").agg(n.alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("duration_us"), F.round(F.count_if(F.col("memory_id") == memory_id) / n, 6).alias("view_share"))
