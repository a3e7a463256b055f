"""The batch transforms run on micro-batches; state lives in snapshots, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunerline.operators import state
from tunerline.operators.incremental import merge_memo, upsert
from tunerline.operators.resolve import MEMO, resolve
from tunerline.sources import xmltv

RESOLUTIONS = "source_id string, stream_key string, normalized_key string, feed_hint string, is_event boolean, canonical_id string, method string, confidence double"


#: How long after its own time a programme may come again and still be known.
REMEMBERED = "14 days"


def ingest_guides(spark: SparkSession, inbox: str, table: str, checkpoint: str, remembered: str = REMEMBERED) -> StreamingQuery:
    """New guide files become programme rows; of each channel, start and title one row, however many files and runs it comes in.

    What has been seen is keyed state: it is kept until the latest start of all guides is more than remembered past a programme's, so its
    size follows the guides' time span and not the history. A programme that comes later than that is left out as too late.
    One without a valid start is taken to start when it comes. The state and its place in the inbox are in the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    rows = xmltv.read_stream(spark, inbox).withColumn("_at", F.coalesce("start", F.current_timestamp())).withWatermark("_at", remembered)
    rows = rows.dropDuplicatesWithinWatermark(["channel_ref", "start_raw", "title"]).drop("_at")
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolve_channels(channels: DataFrame, dims: dict[str, DataFrame], memo_root: str, out_root: str, checkpoint: str) -> StreamingQuery:
    """A stream of channel rows resolved batch by batch against the memo of earlier ones. dims: reference, index, aliases, stations."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        memo = state.read(spark, memo_root, MEMO)
        rows, fresh = resolve(batch, **dims, memo=memo)  # what it decides is written, and read by both that follow
        old = state.read(spark, out_root, RESOLUTIONS)
        state.write(upsert(old, rows.select(*old.columns), ["source_id", "stream_key"]), out_root)
        state.write(merge_memo(memo, fresh), memo_root)

    return channels.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_intervals(events: DataFrame) -> DataFrame:
    """Events by type in ten-minute windows, late ones up to ten minutes. An extension: the rest knows no event time."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
