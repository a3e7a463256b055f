"""Panel API documents: account probes, categories, streams, short guides, configured sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.functions.links import decode_base64, output_extension, stream_template, to_number
from tunerline.operators.categories import classified

ACCOUNT = "user_info struct<username:string,password:string,status:string,exp_date:string,max_connections:string,active_cons:string,allowed_output_formats:array<string>>, server_info struct<url:string,port:string,https_port:string,server_protocol:string,timezone:string>"
SHORT_EPG = "epg_listings array<struct<title:string,description:string,start:string,end:string>>"
CATEGORIES = "array<struct<category_id:string,category_name:string>>"
STREAMS = "array<struct<stream_id:string,name:string,stream_icon:string,epg_channel_id:string,category_id:string,tv_archive:int,tv_archive_duration:int>>"
ACCOUNTS = "array<struct<id:string,serverUrl:string,username:string,password:string,output:string>>"


def account_health(body: Column, now: Column) -> Column:
    """struct(healthy, reason, max_connections, active_connections) of a probe's JSON."""
    b = F.from_json(body, ACCOUNT)
    u, exp = b["user_info"], to_number(b["user_info"]["exp_date"])
    expired = F.coalesce(F.timestamp_seconds(exp) < now, F.lit(False))
    healthy = F.coalesce(u["status"] == "Active", F.lit(False)) & ~expired
    malformed = u.isNull() | b["server_info"].isNull()
    reason = F.when(malformed, "malformed account-check response (missing user_info/server_info)").when(~healthy, F.concat(F.lit("status="), F.coalesce(u["status"], F.lit("unknown")), F.when(expired, " (expired)").otherwise("")))
    return F.struct((~malformed & healthy).alias("healthy"), reason.alias("reason"), to_number(u["max_connections"]).alias("max_connections"), to_number(u["active_cons"]).alias("active_connections"))


def short_epg(rows: DataFrame, body: str = "body") -> DataFrame:
    """Listings with title, start and end, their text decoded from base64. All columns but body stay."""
    keep = [c for c in rows.columns if c != body]
    x = rows.select(*keep, F.explode_outer(F.from_json(body, SHORT_EPG)["epg_listings"]).alias("l"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return x.where(has(F.col("l.title")) & has(F.col("l.start")) & has(F.col("l.end"))).select(*keep, decode_base64(F.col("l.title")).alias("title"), decode_base64(F.col("l.description")).alias("description"), F.col("l.start").alias("start"), F.col("l.end").alias("end"))


def csv_sources(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """source_id, url: entries of a comma-separated list, numbered after blanks are dropped. All columns but the list stay."""
    keep = [c for c in rows.columns if c != column]
    items = F.filter(F.transform(F.split(column, ","), lambda x: F.btrim(x)), lambda x: x != "")
    return rows.select(*keep, F.posexplode_outer(items).alias("i", "url")).where("i is not null").select(*keep, F.concat(F.lit(prefix + "-"), F.col("i").cast("string")).alias("source_id"), "url")


def accounts(body: Column) -> Column:
    """Configured accounts of a JSON list, trailing slashes stripped; anything wrong gives an empty list."""
    a = F.from_json(body, ACCOUNTS, {"mode": "PERMISSIVE"})
    ok = F.forall(a, lambda x: x["id"].isNotNull() & x["serverUrl"].isNotNull() & x["username"].isNotNull() & x["password"].isNotNull())
    made = F.transform(a, lambda x: F.struct(x["id"].alias("id"), F.regexp_replace(x["serverUrl"], "/+$", "").alias("server_url"), x["username"].alias("username"), x["password"].alias("password"), x["output"].alias("output")))
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.array().cast("array<struct<id:string,server_url:string,username:string,password:string,output:string>>"))


def account_sources(configured: DataFrame, column: str = "accounts") -> DataFrame:
    """source_id, role (channels, guide), kind: each account (a row's array from accounts()) gives a channel and a guide source."""
    a = configured.select(F.explode(column).alias("a"))
    roles = F.array(F.struct(F.lit("channels").alias("role"), F.lit("xtream").alias("kind")), F.struct(F.lit("guide").alias("role"), F.lit("epg").alias("kind")))
    return a.select(F.col("a.id").alias("source_id"), F.explode(roles).alias("r")).select("source_id", "r.role", "r.kind")


def scan(probes: DataFrame, categories: DataFrame, streams: DataFrame, now: Column, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, attempts, counts) of panel accounts, from their landed responses.

    probes: source_id, output (wished container or null), body; categories: source_id, body; streams: source_id,
    category_id (asked for), body. Probe, categories, classification, streams of the included categories, rows: an account
    that isn't healthy gives no rows, whatever else has landed, and an error in attempts (source_id, kind, error). A
    stream's group is the name of its own category, else of the one asked for. counts: source_id, included, excluded
    categories of healthy accounts. Credentials stay placeholders in url_template."""
    probed = probes.select("source_id", "output", account_health(F.col("body"), now).alias("h"), F.from_json("body", ACCOUNT)["user_info"]["allowed_output_formats"].alias("formats"))
    attempts = probed.select("source_id", F.lit("xtream").alias("kind"), F.when(~F.col("h.healthy"), F.coalesce("h.reason", F.lit("unknown"))).alias("error"))
    healthy = probed.where("h.healthy").select("source_id", output_extension(F.col("output"), F.col("formats")).alias("container_ext"))
    named = categories.join(healthy.select("source_id"), "source_id", "left_semi").select("source_id", F.explode(F.from_json("body", CATEGORIES)).alias("c")).select("source_id", "c.*")
    named = classified(named, overrides).withColumn("included", F.col("classification") != "not-sports")
    counts = named.groupBy("source_id").agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    asked = named.where("included").select("source_id", "category_id", F.col("category_name").alias("asked_name"))
    found = streams.join(asked, ["source_id", "category_id"]).select("source_id", "asked_name", F.explode(F.from_json("body", STREAMS)).alias("s"))
    own = named.groupBy("source_id", "category_id").agg(F.max("category_name").alias("own_name"))
    found = found.withColumn("category_id", F.col("s.category_id")).join(own, ["source_id", "category_id"], "left").join(healthy, "source_id")
    rows = found.select(
        "source_id", F.col("s.stream_id").alias("stream_key"), F.col("s.name").alias("name"), F.nullif("s.epg_channel_id", F.lit("")).alias("tvg_id"), F.nullif("s.stream_icon", F.lit("")).alias("logo"), F.coalesce("own_name", "asked_name").alias("group_name"),
        stream_template(F.col("s.stream_id"), F.col("container_ext")).alias("url_template"), "container_ext", F.coalesce(F.col("s.tv_archive") == 1, F.lit(False)).alias("tv_archive"), F.col("s.tv_archive_duration").alias("tv_archive_hours"),
    )
    return rows, attempts, counts
