"""Structured Streaming counterparts: windows with watermarks, deduplication, stream-static joins, stateful replay."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream of Parquet events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by event type and window; the same code on a stream and on a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def enrich(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream-static join."""
    return events.join(static, key, "left")


def stateful_replay(events: DataFrame) -> DataFrame:
    """(user_id, live, seq) after each batch: whether the last operation (op, event_id) of a user is an add. State is one row a key."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, live = state.get if state.exists else (-1, False)
        for b in batches:
            last = b.loc[b["event_id"].idxmax()]
            if int(last["event_id"]) > seq:
                seq, live = int(last["event_id"]), last["op"] == "add"
        state.update((seq, bool(live)))
        yield pd.DataFrame({"user_id": [key[0]], "live": [bool(live)], "seq": [seq]})

    grouped = events.select("user_id", "event_id", "op").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, live boolean, seq long", "seq long, live boolean", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all there is, then stop; the result as an in-memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
