"""Playlists as channel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunerline.functions.links import extension, redact, stream_key
from tunerline.functions.text import trim_ws
from tunerline.operators.scratch import settle

_PAIR = r'([a-zA-Z0-9_-]+)="([^"]*)"'


def attributes(line: Column) -> Column:
    """Map of key="value" pairs before the first comma; the last of equal keys wins."""
    head = F.substring_index(line, ",", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(head, F.lit(_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(head, F.lit(_PAIR), F.lit(2)).alias("v"))
    keys = F.array_distinct(F.regexp_extract_all(head, F.lit(_PAIR), F.lit(1)))
    return F.transform(F.array(pairs), lambda p: F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(p, lambda x: x["k"] == k), -1)["v"].alias("value")))))[0]


def parse(playlists: DataFrame) -> DataFrame:
    """playlists (source_id, content) -> source_id, pos, stream_key, name, tvg_id, logo, group_name, url (redacted), ext, attrs.

    A URL line counts if the line before it, blanks and other comments aside, is an #EXTINF. Within a playlist no row
    is shuffled: its lines are paired in place. The key comes from the raw URL, which isn't kept."""
    lines = F.filter(F.transform(F.split("content", "\r?\n"), trim_ws), _counts)
    entries = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(x.alias("url"), F.when(i > 0, F.get(ls, i - 1)).alias("info"))), lambda e: ~e["url"].startswith("#") & e["info"].startswith("#"))
    made = F.get(F.transform(F.array(lines), entries), F.lit(0))
    return _channels(playlists.select("source_id", F.posexplode_outer(made).alias("pos", "e")).where("pos is not null"))


def _counts(line: Column) -> Column:
    """A line that is an #EXTINF or a URL; blanks and other comments aren't."""
    return (line != "") & (~line.startswith("#") | line.startswith("#EXTINF:"))


def _channels(rows: DataFrame) -> DataFrame:
    """source_id, pos, e (url, info) -> the columns of parse."""
    a = attributes(F.col("e.info"))
    rows = rows.select("source_id", "pos", "e", a.alias("attrs"))
    get = lambda k: F.nullif(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    comma = F.locate(",", F.col("e.info"))
    shown = F.when(comma > 0, trim_ws(F.substr(F.col("e.info"), comma + 1)))
    return rows.select("source_id", "pos", stream_key(F.col("e.url")).alias("stream_key"), F.coalesce(F.nullif(shown, F.lit("")), get("tvg-name"), F.lit("Unknown")).alias("name"), get("tvg-id").alias("tvg_id"), get("tvg-logo").alias("logo"), get("group-title").alias("group_name"), redact(F.col("e.url")).alias("url"), extension(F.col("e.url")).alias("ext"), "attrs")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The columns of parse for the playlist files of a folder, however large: a file is read in splits, by as many tasks.

    Lines are paired within their split (spark.sql.files.maxPartitionBytes bounds it). A split's first line is paired
    with the last one that counts of the splits before it, which is handed on by a row for each split, as are the
    numbers of entries before it, which make pos run on."""
    source = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), source.alias("source_id"), F.monotonically_increasing_id().alias("seq"), trim_ws(F.col("value")).alias("line"))
    lines = settle(lines.where(_counts(F.col("line"))), "playlist-lines")  # numbered once
    split = Window.partitionBy("file", "at").orderBy("seq")
    last = lines.groupBy("file", "at").agg(F.max_by("line", "seq").alias("line"))
    carry = last.select("file", "at", F.lag("line").over(Window.partitionBy("file").orderBy("at")).alias("carry"))  # a row for each split that has lines
    rows = lines.withColumn("before", F.lag("line").over(split)).join(carry, ["file", "at"])
    rows = rows.withColumn("before", F.coalesce("before", "carry")).where(~F.col("line").startswith("#") & F.col("before").startswith("#"))
    rows = settle(rows.select("file", "at", "source_id", "seq", F.struct(F.col("line").alias("url"), F.col("before").alias("info")).alias("e")), "playlist-entries")
    number = rows.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    number = number.select("file", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    rows = rows.join(number, ["file", "at"]).withColumn("pos", (F.col("n") + F.row_number().over(split) - 1).cast("int"))
    return _channels(rows.select("source_id", "pos", "e"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Playlist files of a folder as (source_id, content); a file is a source."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("source_id"), F.col("value").alias("content"))
