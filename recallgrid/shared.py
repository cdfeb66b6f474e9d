"""Ending a lineage in files that all executors share, and running totals that no single task has to add up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one in local mode, as in tests, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recallgrid-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/recallgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, by: list[str], order: list[Column | str], amount: Column, name: str, cut=written) -> DataFrame:
    """df with the sum of amount over its group's rows up to each, in order; equal rows in any order.

    Rows are dealt by ranges of (by, order), so a large group's parts are added up side by side, and each part begins
    with the sum of the parts before it. cut must end the lineage: the ranges are sampled once.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    dealt = cut(df.withColumn("_amount", amount).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_other"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    own = F.sum("_amount").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_part") == F.col("_other")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = dealt.withColumn(name, own).join(base, same).withColumn(name, F.col(name) + F.col("_base"))
    return out.drop("_amount", "_part", "_other", "_base", *[f"_{c}" for c in by])
