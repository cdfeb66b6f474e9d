"""The star schema's tables as entities of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed numbers of the event types as memory ids.
EVENT_IDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", "label")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an access log: pool is the user, seq the place in (ts, event_id)."""
    e = read(spark, sf_dir, "events").where("user_id is not null")
    ids = F.create_map(*[F.lit(x) for kv in EVENT_IDS.items() for x in kv])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("pool"), F.row_number().over(w).cast("long").alias("seq"), ids[F.col("event_type")].cast("long").alias("memory_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.lit("read").alias("access_type"), "ts", "event_id", "value")


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order; weight n / (n + 1) of their count."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = li.select(F.lag("l_partkey").over(w).alias("from_id"), F.col("l_partkey").alias("to_id")).where("from_id is not null and from_id <> to_id")
    n = pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    return n.select("from_id", "to_id", F.lit("temporal").alias("type"), (F.col("n") / (F.col("n") + 1)).alias("weight"), "n")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(F.lit("signup"), F.lit("add"), F.lit("view"), F.lit("update"), F.lit("error"), F.lit("remove"), F.lit("purchase"), F.lit("cleanup"))[F.col("event_type")]
    return e.where("event_type <> 'click'").select(F.col("event_id").alias("seq"), kind.alias("entry_type"), F.col("user_id").alias("memory_id"), F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("connection_id"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("content"))
