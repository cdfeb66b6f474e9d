"""Learning from an unbounded access log with Structured Streaming.

Accesses: pool, seq, memory_id, ts. Rows are taken in order of seq within a micro-batch and pool; intervals of late
rows count as 0. State is a few values for each pool, so it follows the number of pools, not of accesses.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "pool long, seq long, from_id long, to_id long, interval_us long"


def steps(accesses: DataFrame) -> DataFrame:
    """A stream of transitions from a stream of accesses: each access with its pool's one before, across micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows: list[tuple[Any, ...]] = []
        every = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, memory, us in zip(every["seq"].tolist(), every["memory_id"].tolist(), every["ts_us"].tolist()):
            if last is not None:
                rows.append((key[0], seq, last[0], memory, max(us - last[1], 0)))
            last = (memory, us)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["pool", "seq", "from_id", "to_id", "interval_us"])

    keyed = accesses.select("pool", "seq", "memory_id", F.unix_micros("ts").alias("ts_us"))
    return keyed.groupBy("pool").applyInPandasWithState(run, STEP, "memory_id long, ts_us long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(accesses: DataFrame, late: str = "10 minutes", wide: str = "5 minutes") -> DataFrame:
    """Accesses of each memory in tumbling windows, final once the watermark has passed."""
    return accesses.withWatermark("ts", late).groupBy(F.window("ts", wide), "pool", "memory_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "pool", "memory_id", "n")


def sessions(accesses: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return accesses.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "pool").agg(F.count("*").alias("n")).select("pool", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery | None:
    """Everything that is available now, as Parquet; or with an interval such as "1 second" a running query that writes that often."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None
