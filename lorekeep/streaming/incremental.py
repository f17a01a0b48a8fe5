"""Incremental variants: windowed counts with late data, job states, and latest revisions, over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files below path as a stream; the schema comes from what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling or sliding windows; rows later than `late` are dropped."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark("ts", late)
    g = t.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark("ts", late)
    g = t.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else t.dropDuplicates(["event_id"])


def latest_revisions(events: DataFrame) -> DataFrame:
    """user_id, event_id, event_type, n: the last event of each user so far, by (ts, event_id), whatever the order of arrival."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event, kind, n = state.get if state.exists else (-1, -1, "", 0)
        for g in batches:
            n += len(g)
            g = g.assign(us=g["ts"].astype("datetime64[us]").astype("int64"))
            last = g.sort_values(["us", "event_id"]).iloc[-1]
            if (last["us"], last["event_id"]) > (at, event):
                at, event, kind = int(last["us"]), int(last["event_id"]), last["event_type"]
        state.update((at, event, kind, n))
        yield pd.DataFrame([(key[0], event, kind, n)], columns=["user_id", "event_id", "event_type", "n"])

    t = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return t.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, event_id long, event_type string, n long", "at long, event long, kind string, n long", "update", GroupStateTimeout.NoTimeout
    )
