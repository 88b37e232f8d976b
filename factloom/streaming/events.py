"""Structured Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes", files: int = 1) -> DataFrame:
    """A stream of Parquet files; event time as a timestamp, which watermarks ask for."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding_rates(events: DataFrame, length: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Events and their value by type in sliding windows."""
    return events.groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stalled_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user that a gap ends."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n_events"))


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each id once within the watermark, whatever is delivered again."""
    return events.dropDuplicatesWithinWatermark([key])


def appended(events: DataFrame, path: str, checkpoint: str):
    """Rows to Parquet, exactly once over restarts from the same checkpoint; ends when what there is has been read."""
    query = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def signature_stalls(polls: DataFrame, key: str, ts: str, signature: str, seconds: int) -> DataFrame:
    """``sessions.signature_stalls`` as polls come in: key, signature and since, told once for each stall.

    The state of a key is its signature, since when, and whether that was told.
    A stall is told by the first poll after it, or by a timer once the
    watermark has passed. ``polls`` has a watermark on ``ts``.
    """
    limit = seconds * 1000

    def step(name, batches, state):
        import pandas as pd

        found: list[tuple] = []
        held = list(state.get) if state.exists else None

        def tell():
            found.append((name[0], held[0], pd.Timestamp(held[1], unit="us")))
            held[2] = True

        if state.hasTimedOut:
            if not held[2]:
                tell()
        else:
            rows = pd.concat(list(batches)).dropna().sort_values(["ts", "signature"])
            for at, what in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["signature"], strict=True):
                if held is not None and not held[2] and at - held[1] > limit * 1000:
                    tell()
                if held is None or what != held[0]:
                    held = [what, int(at), False]
        if held is not None:
            state.update(tuple(held))
            due = held[1] // 1000 + limit
            if not held[2] and due >= state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
            elif not held[2]:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(found, columns=["key", "signature", "since"])

    rows = polls.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(signature).alias("signature")).filter(F.col("key").isNotNull())
    kind = dict(rows.dtypes)["key"]
    told = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, signature string, since timestamp", "signature string, since bigint, told boolean", "append", "EventTimeTimeout")
    return told.select(F.col("key").alias(key), F.col("signature").alias(signature), "since")
