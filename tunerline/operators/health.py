"""Source health: one row for each source, failures kept apart, and the status over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.functions.links import redact

SOURCES = "source_id string, kind string, label string, healthy boolean, last_error string, updated_at timestamp"


def mark(sources: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """sources (SOURCES) after attempts (source_id, kind, error: null for success; one row for each source).

    Health, the error with its credentials masked, and the time come from the attempt; a known source keeps its label, a
    new one has none. Sources without an attempt stay as they are."""
    a = attempts.select("source_id", F.col("kind").alias("_kind"), redact(F.col("error")).alias("_error"), F.lit(True).alias("_tried"))
    tried = F.col("_tried").isNotNull()
    out = sources.join(a, "source_id", "full")
    return out.select("source_id", F.coalesce("_kind", "kind").alias("kind"), "label", F.when(tried, F.col("_error").isNull()).otherwise(F.col("healthy")).alias("healthy"), F.when(tried, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"), F.when(tried, now).otherwise(F.col("updated_at")).alias("updated_at"))


def succeeded(attempts: DataFrame) -> DataFrame:
    """source_id of the sources that could be read: only theirs may be replaced, the others keep their last good rows."""
    return attempts.where("error is null").select("source_id").distinct()


def status(sources: DataFrame, version: DataFrame) -> DataFrame:
    """One row: status (ok, or degraded if a source is unhealthy or there is no version), data_version, sources, unhealthy."""
    s = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(~F.col("healthy")).alias("unhealthy"))
    v = version.agg(F.max("version").alias("data_version"))
    return s.join(v, F.lit(True), "cross").select(F.when((F.col("unhealthy") > 0) | F.col("data_version").isNull(), "degraded").otherwise("ok").alias("status"), "data_version", "sources", "unhealthy")
