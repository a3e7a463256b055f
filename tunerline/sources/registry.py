"""Pluggable sources: what gives channels or programmes, by kind."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.functions.links import redact

CHANNELS = "source_id string, stream_key string, name string, tvg_id string, logo string, group_name string, url_template string, container_ext string, tv_archive boolean, tv_archive_hours int"
PROGRAMMES = "source_id string, channel_ref string, start timestamp, stop timestamp, title string, sub_title string, description string, category string, previously_shown boolean"
ATTEMPTS = "source_id string, kind string, error string"


class Source(Protocol):
    """A source of channels or programmes. rows() may be lazy, but what its landed files can't give is raised there, not later."""

    source_id: str
    kind: str

    def rows(self, spark: SparkSession) -> DataFrame: ...


class Frame:
    """A source over a DataFrame or a function that reads one: landed playlists, guides, or anything else with the columns."""

    def __init__(self, source_id: str, kind: str, read):
        self.source_id, self.kind, self._read = source_id, kind, read

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark) if callable(self._read) else self._read


def collect(spark: SparkSession, sources: list[Source], schema: str = CHANNELS) -> tuple[DataFrame, DataFrame]:
    """(rows, attempts): the rows of all sources that could be read, with their source_id and the schema's columns (null
    where a source has none), and for each source its kind and its error (credentials masked), null if there was none. One
    source that fails doesn't keep the others from being read."""
    empty = spark.createDataFrame([], schema)
    rows, attempts = empty, []
    for s in sources:
        error = None
        try:
            own = s.rows(spark)
            have = set(own.columns)
            own = own.select(*[F.lit(s.source_id).alias(f.name) if f.name == "source_id" else F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])
            rows = rows.unionByName(own)
        except Exception as e:  # whatever a plugged-in source raises is that source's failure
            error = str(e) or type(e).__name__
        attempts.append((s.source_id, s.kind, error))
    return rows, spark.createDataFrame(attempts, ATTEMPTS).withColumn("error", redact(F.col("error")))
