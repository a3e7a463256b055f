"""Dimension indexes and keyed lookups. Joins carry no hints: the planner broadcasts a side that its statistics, or the
run so far, show to be small, and shuffles it otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.functions.text import normalize
from tunerline.plans.seeds import ALIASES, STATIONS

def reference_index(reference: DataFrame) -> DataFrame:
    """name_key, ref_id, pos, alt_pos: each normalised name of the open channels with the first channel that bears it.

    reference: id, name, alt_names, closed, pos (input order). Empty keys are left out."""
    open_ = reference.where(~F.coalesce("closed", F.lit(False)))
    names = open_.select("id", "pos", F.posexplode(F.concat(F.array("name"), F.coalesce("alt_names", F.array().cast("array<string>")))).alias("alt_pos", "n"))
    keyed = names.select(normalize(F.col("n"))["normalized"].alias("name_key"), "id", "pos", "alt_pos").where("name_key <> ''")
    return keyed.groupBy("name_key").agg(F.min(F.struct("pos", "alt_pos", "id")).alias("m")).select("name_key", F.col("m.id").alias("ref_id"), F.col("m.pos").alias("pos"), F.col("m.alt_pos").alias("alt_pos"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """name_key, canonical: the last group and name of equal keys wins. aliases: canonical, names, pos."""
    names = aliases.select("canonical", "pos", F.posexplode("names").alias("name_pos", "n")).select(normalize(F.col("n"))["normalized"].alias("name_key"), "canonical", "pos", "name_pos")
    return names.groupBy("name_key").agg(F.max_by("canonical", F.struct("pos", "name_pos")).alias("canonical"))


def seed_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(ALIASES.items())], "canonical string, names array<string>, pos int")


def seed_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, i) for i, s in enumerate(STATIONS)], "callsign string, network string, city string, pos int")


def last_by_key(df: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """One row for each key: the last by position."""
    rest = [c for c in df.columns if c not in (*keys, pos)]
    return df.groupBy(*keys).agg(F.max(F.struct(pos, *rest)).alias("m")).select(*keys, "m.*")


def by_callsign(names: DataFrame, candidates: Column, stations: DataFrame) -> DataFrame:
    """key, callsign: for each row of names (key) the first candidate that is in the station table."""
    each = names.select("key", F.posexplode(candidates).alias("at", "callsign"))
    return each.join(stations.select("callsign").distinct(), "callsign").groupBy("key").agg(F.min_by("callsign", "at").alias("callsign"))
