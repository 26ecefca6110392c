"""Structured Streaming: change streams into a store, counters by time, and running state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import Store


def read_changes(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def upsert(changes: DataFrame, store: Store, checkpoint: str, name: str = "changes") -> StreamingQuery:
    """Commit each micro-batch of records (ord, k, op, v) to the store, once: a batch that was committed before a failure is skipped when it comes again."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write(batch, (name, number))

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(events: DataFrame, time: str, by: str, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Events per tumbling window and kind; windows close when the watermark has passed them."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", f"{seconds} seconds").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def running_counts(events: DataFrame, by: str) -> DataFrame:
    """Per key the running number of events, kept as state from batch to batch: key, total."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        state.update((total,))
        yield pd.DataFrame({"key": [key[0]], "total": [total]})

    return events.select(F.col(by).cast("string").alias("key")).groupBy("key").applyInPandasWithState(update, "key string, total bigint", "total bigint", "update", GroupStateTimeout.NoTimeout)


def collect_stream(query: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all there is now, into Parquet files."""
    query.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
