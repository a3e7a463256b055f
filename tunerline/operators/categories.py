"""Category classification by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tunerline.functions.text import trim_ws

# Keywords by class; any of them anywhere in the name counts.
SPORTS = [
    "sport", "espn", "nfl", "nba", "wnba", "nhl", "mlb", "ncaa", "college football", "college basketball", "ufc", "mma", "boxing", "soccer", "football", "fifa", "uefa",
    "premier league", "la liga", "bundesliga", "serie a", "ligue 1", "racing", "nascar", "f1", "formula", "golf", "pga", "tennis", "atp", "wta", "rugby", "afl", "cricket",
    "darts", "snooker", "billiard", "pool", "wwe", "wrestling", "motogp", "olympic",
]
MAYBE = ["ppv", "pay per view", "pay-per-view", "24/7", "events", "game pass"]


def classify(name: Column) -> Column:
    key = F.lower(trim_ws(name))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(key, w))
    return F.when(has(SPORTS), "sports").when(has(MAYBE), "maybe-sports").otherwise("not-sports")


def classified(categories: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """categories (category_id, category_name) with classification; overrides (name, forced) by lower-case name win."""
    out = categories.withColumn("classification", classify(F.col("category_name")))
    if overrides is None:
        return out
    o = overrides.select(F.lower(trim_ws(F.col("name"))).alias("_k"), "forced")
    return out.withColumn("_k", F.lower(trim_ws(F.col("category_name")))).join(o, "_k", "left").withColumn("classification", F.coalesce("forced", "classification")).drop("_k", "forced")


def observed(classes: DataFrame, observation: Observation | str) -> DataFrame:
    """The same rows; when an action has read them, the counts of included and excluded categories are in the observation, or reach query listeners by its name."""
    included = F.col("classification") != "not-sports"
    return classes.observe(observation, F.count_if(included).alias("included"), F.count_if(~included).alias("excluded"))


def included_streams(streams: DataFrame, categories: DataFrame) -> DataFrame:
    """Streams of categories that aren't excluded, with the category's name (its id where it has none)."""
    c = classified(categories).where(F.col("classification") != "not-sports").select("category_id", "category_name")
    return streams.join(c, "category_id").withColumn("group_name", F.coalesce("category_name", F.col("category_id").cast("string"))).drop("category_name")
