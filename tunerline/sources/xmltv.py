"""Programme guides, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.functions.links import xmltv_time

SCHEMA = "_start string, _stop string, _channel string, title array<string>, `sub-title` array<string>, desc array<string>, category array<string>, `previously-shown` string"
#: Title and other text elements may carry attributes; their text is then in _VALUE. The text schema reads both.


def programmes(raw: DataFrame, *keys: str) -> DataFrame:
    """Programme rows of parsed elements (SCHEMA), with the columns keys of raw."""
    last = lambda c: F.nullif(F.btrim(F.try_element_at(F.col(c), F.lit(-1))), F.lit(""))
    out = raw.select(
        *keys, F.col("_channel").alias("channel_ref"), F.col("_start").alias("start_raw"), xmltv_time(F.col("_start")).alias("start"), xmltv_time(F.col("_stop")).alias("stop"), last("title").alias("title"), F.nullif(F.btrim(F.try_element_at(F.col("`sub-title`"), F.lit(-1))), F.lit("")).alias("sub_title"),
        last("desc").alias("description"), F.get(F.filter("category", lambda x: x != ""), F.lit(0)).alias("category"), F.col("`previously-shown`").isNotNull().alias("previously_shown"),
    )
    return out.where("start_raw is not null and channel_ref is not null and title is not null and stop is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Guide files: one row for each programme element with start, stop, channel and a title. Files are split by element."""
    return programmes(spark.read.format("xml").option("rowTag", "programme").option("nullValue", "\x00").schema(SCHEMA).load(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return programmes(spark.readStream.format("xml").option("rowTag", "programme").option("nullValue", "\x00").schema(SCHEMA).load(path))
