"""Event logs as JSON lines, Parquet snapshots with a pointer, and recovery of state from both."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import scores

#: A log entry: its place in the log, kind (add, update, remove, cleanup), id, owner and payload.
LOG_SCHEMA = "seq long, entry_type string, memory_id long, connection_id string, content string, embedding array<float>, strength double, access_count long, ts timestamp"


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that could not be read."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad")


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_snapshot(df: DataFrame, root: str, name: str | None = None) -> str:
    """A new version beside the old ones, then a new pointer beside the old ones: readers take the latest whole pointer, so never half a snapshot."""
    spark = df.sparkSession
    at = time.time_ns()
    name = name or f"v{at}"
    df.write.mode("errorifexists").parquet(f"{root}/{name}")
    n = spark.read.parquet(f"{root}/{name}").count()
    spark.createDataFrame([(name, n, at)], POINTER).coalesce(1).write.mode("append").json(f"{root}/_pointers")
    return name


#: A pointer to a snapshot: its name, its rows and when it was written, in ns.
POINTER = "version string, entries long, written long"


def snapshot_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The latest snapshot's name, rows and time."""
    return spark.read.schema(POINTER).json(f"{root}/_pointers").where("version is not null").orderBy(F.desc("written")).limit(1)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{snapshot_metadata(spark, root).first()['version']}")


def prune_snapshots(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Delete the snapshots behind the newest ``keep`` (1 at least); returns their names. Pointers stay, they are a line each."""
    names = spark.read.schema(POINTER).json(f"{root}/_pointers").where("version is not null").orderBy(F.desc("written")).select("version").collect()
    gone = [r["version"] for r in names[max(1, keep) :]]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


#: Categories of patterns; fixed values. Any other one is the default.
CATEGORIES, DEFAULT_CATEGORY = ("Temporal", "Spatial", "Transformational", "Relational"), "Transformational"


def patterns_from_snapshot(rows: DataFrame) -> DataFrame:
    """Stored patterns as patterns: sure, of a known category, with their steps from their times."""
    known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(DEFAULT_CATEGORY)
    return rows.select("id", "name", known.alias("category"), "embedding", "activation_count", F.lit(1.0).alias("confidence"), F.col("created_ms").alias("first_seen_step"), F.col("last_used_ms").alias("last_used_step"))


def to_wire(rows: DataFrame, *columns: str) -> DataFrame:
    """(payload, crc): each row as a JSON object with the checksum of its bytes."""
    payload = rows.select(F.to_json(F.struct(*columns)).alias("payload"))
    return payload.withColumn("crc", scores.checksum(F.col("payload")))


def from_wire(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of messages whose checksum holds, and the messages whose doesn't or that are no such object."""
    parsed = messages.withColumn("r", F.from_json("payload", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.coalesce((scores.checksum(F.col("payload")) == F.col("crc")) & F.col("r._bad").isNull(), F.lit(False))
    return parsed.where(good).select("r.*").drop("_bad"), parsed.where(~good).select("payload", "crc")


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Ten memories and eight associations to try the engine on."""
    topics = ["graphs hold edges", "edges join nodes", "vectors have norms", "norms scale cosines", "logs keep events", "events make patterns", "patterns predict events", "caches forget entries", "snapshots restore logs", "queries rank memories"]
    memories = spark.createDataFrame([(i, t, t.split()) for i, t in enumerate(topics, 1)], "id long, content string, tags array<string>")
    edges = spark.createDataFrame([(f"assoc_{a}_{b}", a, b, "semantic", round(1 - 0.1 * k, 1)) for k, (a, b) in enumerate([(1, 2), (3, 4), (5, 6), (6, 7), (9, 5), (10, 1), (10, 3), (8, 10)])], "id string, from_id long, to_id long, type string, weight double")
    return memories, edges


def replay(log: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Live rows after a log in seq order, over a snapshot whose rows count as adds before it.

    The last add or remove of an id decides; an add falls to a later cleanup of its connection; the last update behind
    that add patches the payload. Windows run within one id; connections' cleanups are one row each.
    """
    fields = ["seq", "entry_type", "memory_id", "connection_id", "content"]
    rows = log.select(*fields)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("entry_type"), "memory_id", "connection_id", "content"))
    own = rows.where(F.col("entry_type").isin("add", "remove", "update"))
    state = own.where("entry_type <> 'update'").groupBy("memory_id").agg(F.max_by(F.struct(*fields), "seq").alias("s")).select("s.*").where("entry_type = 'add'")
    cleanups = rows.where("entry_type = 'cleanup'").groupBy("connection_id").agg(F.max("seq").alias("cleaned"))
    alive = state.join(cleanups, "connection_id", "left").where("cleaned is null or cleaned < seq")
    updates = own.where("entry_type = 'update'").select("memory_id", F.col("seq").alias("useq"), F.col("content").alias("ucontent"))
    behind = alive.select("memory_id", "seq").join(updates, "memory_id").where("useq > seq").groupBy("memory_id").agg(F.max_by("ucontent", "useq").alias("patched"), F.count("*").alias("updates"))
    return alive.join(behind, "memory_id", "left").select("memory_id", "connection_id", F.coalesce("patched", "content").alias("content"), F.col("seq").alias("added"), F.coalesce("updates", F.lit(0)).alias("updates"))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins by order; a change beats the base row."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def cleanup_connection(df: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows of connections that are not closed."""
    return df.join(closed.select("connection_id"), "connection_id", "left_anti")


def recover(spark: SparkSession, snapshot_root: str, log_path: str) -> DataFrame:
    return replay(read_log(spark, log_path)[0], read_snapshot(spark, snapshot_root))


def put_blobs(store: DataFrame | None, blobs: DataFrame) -> DataFrame:
    """(key, data BINARY) with the newest data of each key."""
    rows = blobs.select("key", "data", "ts")
    return rows if store is None else upsert(store, rows, "key", "ts")
