"""Counts, accuracy, audits and poll intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def method_counts(resolutions: DataFrame) -> DataFrame:
    return resolutions.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def stage_summary(resolutions: DataFrame) -> DataFrame:
    return resolutions.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_event").alias("events"), F.count_if(F.col("method") == "unresolved").alias("unresolved"))


def accuracy(resolutions: DataFrame, expected: DataFrame) -> DataFrame:
    """total, correct, accuracy (1 without rows). expected: keys of a resolution, expected_id, expect_event; for events the id doesn't count."""
    j = resolutions.join(expected, ["source_id", "stream_key"])
    ok = F.when(F.col("expect_event"), F.col("is_event")).otherwise(~F.col("is_event") & F.col("canonical_id").eqNullSafe(F.col("expected_id")))
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(1.0)))


def mismatches(resolutions: DataFrame, expected: DataFrame) -> DataFrame:
    j = resolutions.join(expected, ["source_id", "stream_key"])
    ok = F.when(F.col("expect_event"), F.col("is_event")).otherwise(~F.col("is_event") & F.col("canonical_id").eqNullSafe(F.col("expected_id")))
    return j.where(~ok)


def poll_seconds(events: DataFrame, now, by: list[str]) -> DataFrame:
    """by, seconds: 60 with a live event, 600 with one that starts within six hours, else 3600. events: state, start."""
    soon = (F.col("state") == "pre") & F.col("start").between(now, now + F.expr("interval 6 hours"))
    live = F.bool_or(F.col("state") == "in")
    return events.groupBy(*by).agg(F.when(F.coalesce(live, F.lit(False)), 60).when(F.coalesce(F.bool_or(soon), F.lit(False)), 600).otherwise(3600).alias("seconds"))


def path_audit(responses: DataFrame) -> DataFrame:
    """ok, failed, events: from responses (status, events array); a missing list counts no events."""
    good = F.col("status").isin(200, 304)
    return responses.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(F.col("events").isNotNull(), F.size("events"))), F.lit(0)).alias("events"))


def disable_failed(leagues: DataFrame, audit: DataFrame) -> DataFrame:
    """leagues (espn_path, …) with disabled and disabled_reason set for paths that failed (audit: espn_path, ok, error)."""
    bad = audit.where(~F.col("ok")).select("espn_path", F.coalesce("error", F.lit("verification failed")).alias("_why")).dropDuplicates(["espn_path"])
    j = leagues.join(bad, "espn_path", "left")
    return j.select(*[c for c in leagues.columns if c not in ("disabled", "disabled_reason")], (F.col("_why").isNotNull() | F.coalesce("disabled", F.lit(False))).alias("disabled"), F.coalesce("_why", "disabled_reason").alias("disabled_reason"))
