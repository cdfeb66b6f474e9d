"""Latency, rate and health measures over samples, and features of activity signals."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.shared import running_total, written


def percentiles(samples: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), cut: Callable = written) -> DataFrame:
    """The sorted sample's element at floor(n * share) for each group; values are counted first, and a group's values are ranked in parts."""
    counted = samples.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running_total(counted, [group], [value], F.col("c"), "upto", cut)
    n = ranked.groupBy(F.col(group).alias("_g")).agg(F.sum("c").alias("n"))
    ranked = ranked.join(n, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    at = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value))).alias(f"p{str(q)[2:].ljust(2, '0')}") for q in shares]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *at)


def throughput(events: DataFrame, ts: str = "ts", every: str = "1 second") -> DataFrame:
    return events.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def moving_average(samples: DataFrame, group: str, order: list[str], value: str, keep: float = 0.8) -> DataFrame:
    """Exponential average of each group's values in order, the first value its seed.

    The fold is a weighted sum: a value that k others follow weighs (1 - keep) * keep ** k, the seed keep ** k; so sums
    are combined before the shuffle, and no group is brought together.
    """
    back = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])) - 1
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    rows = samples.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"), back.alias("_k"), first.alias("_first"))
    weight = F.when(F.col("_first"), 1.0).otherwise(1 - keep) * F.pow(F.lit(keep), F.col("_k"))
    return rows.groupBy(group).agg(F.round(F.sum(F.col("_v") * weight), 6).alias("ema"))


def hit_rate(probes: DataFrame, found: str = "found") -> DataFrame:
    n = F.count("*")
    return probes.agg(n.alias("probes"), F.count_if(F.col(found)).alias("hits"), F.round(F.when(n > 0, F.count_if(F.col(found)) / n).otherwise(0.0), 6).alias("hit_rate"))


def bloom_error(bits_set, bits, hashes):
    """Estimated false-positive rate of a filter from its fill."""
    return F.pow(bits_set / bits, hashes)


def prediction_accuracy(outcomes: DataFrame, pool: str = "pool", order: str = "seq") -> DataFrame:
    """Running accuracy that each outcome (1 or 0) moves by 5 %."""
    return moving_average(outcomes, pool, [order], "hit", 0.95)


def compare_runs(before: DataFrame, after: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(name, value) of two runs: improved, regressed or unchanged."""
    both = before.select("name", F.col("value").alias("before")).join(after.select("name", F.col("value").alias("after")), "name")
    change = (F.col("after") - F.col("before")) / F.col("before")
    return both.withColumn("change", F.round(change, 6)).withColumn("verdict", F.when(F.col("change") > tolerance, "regressed").when(F.col("change") < -tolerance, "improved").otherwise("unchanged"))


def rate_limited(requests: DataFrame, most: int = 100, seconds: int = 60) -> DataFrame:
    """Requests (event_id, client, t) with the admitted ones of their client in the window before them, and whether that refuses them.

    Refused requests don't count, so each decision needs those before it: a client's requests are walked in order of
    (t, event_id), as a stream of batches of which at most ``most`` times are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, admitted = object(), deque()
        for batch in batches:
            seen = []
            for c, t in zip(batch["client"].tolist(), batch["t"].tolist()):
                if c != client:
                    client, admitted = c, deque()
                while admitted and admitted[0] < t - seconds:
                    admitted.popleft()
                seen.append(len(admitted))
                if len(admitted) < most:
                    admitted.append(t)
            yield batch.assign(in_window=seen, limited=[n >= most for n in seen])

    rows = requests.select("event_id", "client", "t").repartition("client").sortWithinPartitions("client", "t", "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", in_window long, limited boolean")


def last_errors(events: DataFrame, group: str, order: list[str], failed: str, n: int = 100) -> DataFrame:
    """Each group's last n failures, newest first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return events.where(F.col(failed)).withColumn("rank", rank).where(F.col("rank") <= n)


def signal_features(frames: DataFrame, frame_ms: float = 1.0) -> DataFrame:
    """One row over (t, unit, value), where a unit without a row in a frame has 0 there.

    Entropy of the units' shares in a frame, averaged over frames; stability 1 / (1 + the units' mean variance); local
    maxima, and the oscillation in Hz from the frames between them; bursts that ended; units a millisecond between the
    first and the last unit's peak (infinite where all peak at once). Everything is summed per frame or unit first.
    """
    by_t = frames.groupBy("t").agg(F.sum("value").alias("total"), F.sum(F.when(F.col("value") > 0, F.col("value") * F.log2("value"))).alias("vlogv"))
    w = Window.orderBy("t")  # one row a frame
    peak = (F.col("total") > F.coalesce(F.lag("total").over(w), F.lit(float("-inf")))) & (F.col("total") > F.coalesce(F.lead("total").over(w), F.lit(float("-inf")))) & (F.col("total") > 0.1)
    top = by_t.agg(F.max("total").alias("top"), F.count("*").alias("frames"))
    marked = by_t.join(F.broadcast(top), F.lit(True)).withColumn("i", F.row_number().over(w)).withColumn("peak", peak).withColumn("high", F.col("total") > 0.3 * F.col("top"))
    ended = F.lag("high").over(w) & ~F.col("high")
    # -sum p log p = log total - sum(v log v) / total
    spread = F.when(F.col("total") > 0, F.log2("total") - F.coalesce("vlogv", F.lit(0.0)) / F.col("total")).otherwise(0.0)
    n_peaks, apart = F.count_if("peak"), F.max(F.when(F.col("peak"), F.col("i"))) - F.min(F.when(F.col("peak"), F.col("i")))
    hertz = F.when((F.max("frames") >= 4) & (n_peaks > 1), 1000.0 * (n_peaks - 1) / (apart * frame_ms)).otherwise(0.0)
    times = marked.withColumn("ended", ended).agg(
        F.max("frames").alias("frames"), n_peaks.alias("maxima"), F.count_if("ended").alias("bursts"), F.round(F.avg("total"), 6).alias("mean_total"),
        F.round(F.avg(spread), 6).alias("entropy"), F.round(hertz, 6).alias("oscillation_hz"),
    )
    place = marked.select("t", "i")
    units = frames.join(place, "t").groupBy("unit").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.max("value").alias("most"), F.max_by(F.struct((-F.col("i")).alias("i")), F.struct("value", -F.col("i"))).alias("at"))
    units = units.join(F.broadcast(top.select("frames")), F.lit(True))
    variance = F.col("q") / F.col("frames") - F.pow(F.col("s") / F.col("frames"), 2)
    live = F.when(F.col("most") > 0, -F.col("at.i"))
    late = (F.max(live) - F.min(live)) * frame_ms
    speed = F.when(F.count(live) < 2, 0.0).when(late > 0, F.count("*") / late).otherwise(float("inf"))
    return times.join(units.agg(F.round(1 / (1 + F.avg(variance)), 6).alias("stability"), F.round(speed, 6).alias("propagation_speed")), F.lit(True))


def autocorrelation(frames: DataFrame, lags: int = 10) -> DataFrame:
    """(lag, r) of the frames' totals."""
    by_t = frames.groupBy("t").agg(F.sum("value").alias("x"))
    m = by_t.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    own = by_t.join(F.broadcast(m), F.lit(True)).withColumn("k", F.row_number().over(Window.orderBy("t"))).withColumn("d", F.col("x") - F.col("m"))
    pairs = own.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "k", "d", "v", "n")
    other = own.select(F.col("k").alias("k2"), F.col("d").alias("d2"))
    return pairs.join(other, F.col("k") + F.col("lag") == F.col("k2")).groupBy("lag").agg(F.round(F.sum(F.col("d") * F.col("d2")) / F.max("n") / F.max("v"), 6).alias("r"))


def synchrony(frames: DataFrame) -> DataFrame:
    """Mean cosine over pairs of units, from sums: of unit vectors u, (|sum u|^2 - units) / (units * (units - 1))."""
    size = frames.groupBy("unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size")).where("size > 0")
    u = frames.join(size, "unit").select("t", (F.col("value") / F.col("size")).alias("u"))
    square = u.groupBy("t").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = size.agg(F.count("*").alias("n"))
    return square.join(n, F.lit(True)).select("n", F.round(F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 6).alias("synchrony"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(name, labels, value) as exposition lines."""
    tags = F.concat_ws(",", F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), tags, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
