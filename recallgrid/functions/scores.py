"""Scores, hashes and models over plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_key(*columns: str) -> Column:
    """A stable key of a query's fields."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def checksum(payload: Column) -> Column:
    """CRC-32 of a payload's bytes, unsigned."""
    return F.crc32(payload.cast("binary"))


def retention(age_seconds: Column, accesses: Column, most_accesses: Column, markov: Column) -> Column:
    """recency * frequency * (1 + markov)."""
    recency = 1 / (1 + age_seconds / 3600.0)
    frequency = F.log(1.0 + accesses) / F.log(1.0 + F.greatest(most_accesses, F.lit(1)))
    return recency * frequency * (1 + markov)


def edge_retention(weight: Column, age_hours: Column) -> Column:
    return weight - 0.1 * age_hours / 24


def health_score(success: Column, millis: Column, healthy: Column) -> Column:
    return F.when(healthy, 0.7 * success + 0.3 * (1 - F.least(millis / 1000.0, F.lit(1.0)))).otherwise(F.lit(0.0))


def overall_health(healthy: Column) -> Column:
    """As an aggregate."""
    up, n = F.count_if(healthy), F.count("*")
    return F.when(up == n, "healthy").when(up > 0, "degraded").otherwise("unhealthy")


def interval_probability(dt: Column, mean: Column, variance: Column, model: str = "normal") -> Column:
    """Density of an interval, 1 at most; with zero variance 1 for the normal model."""
    sd = F.sqrt(variance)
    if model == "normal":
        p = F.exp(-0.5 * F.pow((dt - mean) / sd, 2)) / (sd * F.sqrt(2 * F.pi()))
        return F.when(variance <= 0, F.lit(1.0)).otherwise(F.least(p, F.lit(1.0)))
    if model == "exponential":
        p = F.exp(-dt / mean) / mean
    elif model == "gamma":  # of shape 2
        scale = mean / 2
        p = dt / (scale * scale) * F.exp(-dt / scale)
    elif model == "weibull":  # of shape 2
        p = 2 * dt / (mean * mean) * F.exp(-F.pow(dt / mean, 2))
    else:
        raise ValueError(model)
    return F.when(mean > 0, F.least(p, F.lit(1.0))).otherwise(F.lit(0.0))


def position_in_pattern(recent: Column, pattern: Column) -> Column:
    """Length of the longest end of recent that begins pattern."""
    n = F.least(F.size(recent), F.size(pattern))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & (F.slice(recent, -k, k) == F.slice(pattern, F.lit(1), k)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def constraints_hold(constraints: Column, context: Column) -> Column:
    """Each constraint's name is in the context and its value contains the expression; without constraints true."""
    return F.forall(constraints, lambda c: F.coalesce(F.contains(F.try_element_at(context, c["name"]), c["expression"]), F.lit(False)))


def halving_fold(values: Column) -> Column:
    """((0 + x1) / 2 + x2) / 2 ... in whole numbers, over an ordered array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.floor((a + x) / 2).cast("long"))


def ema_fold(values: Column, keep: float) -> Column:
    """Exponential moving average over an ordered array; the first value seeds it."""
    seed = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), seed, lambda a, x: keep * a + (1 - keep) * x)
