"""Bars from ticks: one aggregation for batch and stream, and a stream with keyed upserts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.sources.bars import upsert_latest


def tick_bars(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV bars of tumbling windows by event type; ticks of no positive value do not count."""
    rows = events.filter(F.col("value") > 0)
    at = F.struct("ts", "event_id")
    return rows.groupBy(F.window("ts", width), F.col("event_type").alias("ticker")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("ticks")).select(F.col("window.start").alias("bar"), "ticker", "open", "high", "low", "close", "ticks")


def stream_bars(events: DataFrame, path: str, checkpoint: str, late: str = "2 hours", width: str = "1 hour"):
    """Start a stream of bars: late ticks within the watermark revise their bar; each batch is appended with its number.

    Read the table with current_bars, which keeps the last version of each bar.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("append").parquet(path)

    stream = tick_bars(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def current_bars(versions: DataFrame) -> DataFrame:
    return upsert_latest(versions, versions.filter("false"), ["bar", "ticker"], "version")
