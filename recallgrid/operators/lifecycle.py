"""Capacity, age and retention of stored rows; every time-dependent rule takes an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores


def within_ttl(df: DataFrame, as_of: str | Column, seconds: int = 3600, ts: str = "last_accessed") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {seconds} seconds"))


def keep_recent(df: DataFrame, capacity: int, pool: str = "pool", ts: str = "last_access", key: str = "key") -> DataFrame:
    """The ``capacity`` most recently used rows of each pool."""
    w = Window.partitionBy(pool).orderBy(F.desc(ts), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def keep_best(df: DataFrame, capacity: int, as_of: str | Column, pool: str = "pool") -> DataFrame:
    """The ``capacity`` rows of each pool with the best retention score; of equal ones the later inserted stay."""
    most = F.max("access_count").over(Window.partitionBy(pool))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_accessed")
    scored = df.withColumn("_s", F.round(scores.retention(age, F.col("access_count"), most, F.coalesce("markov", F.lit(0.0))), 9))
    w = Window.partitionBy(pool).orderBy(F.desc("_s"), F.desc("inserted"))
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r", "_s")


def last_rows(df: DataFrame, n: int, pool: str = "pool", order: str = "seq") -> DataFrame:
    """A sliding window of each pool's last n rows."""
    w = Window.partitionBy(pool).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def frequent(df: DataFrame, least: int, count: str = "count") -> DataFrame:
    return df.where(F.col(count) >= least)


def unused(df: DataFrame, as_of: str | Column, days: int) -> DataFrame:
    return df.where((F.col("last_accessed") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")) & (F.col("access_count") == 0))


def memory_estimate(df: DataFrame, *by: str) -> DataFrame:
    """Bytes of vectors (4 a place) and contents, and entries."""
    size = F.coalesce(4 * F.size("embedding"), F.lit(0)) + F.coalesce(F.octet_length("content"), F.lit(0))
    return df.groupBy(*by).agg(F.sum(size).alias("bytes"), F.count("*").alias("entries"))
