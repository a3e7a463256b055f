"""Reference data, scoreboards and dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.functions.links import fresh

SCHEMAS = {
    "channels": "id string, name string, alt_names array<string>, network string, owners array<string>, country string, subdivision string, categories array<string>, closed string",
    "feeds": "channel string, id string, name string, is_main boolean, broadcast_area array<string>, languages array<string>",
    "logos": "channel string, feed string, url string",
    "guides": "channel string, feed string, site string, site_id string, site_name string",
}
TEAMS = "sports array<struct<leagues:array<struct<teams:array<struct<team:struct<id:string,displayName:string,shortDisplayName:string,abbreviation:string,location:string,logos:array<struct<href:string>>>>>>>>>"
SCOREBOARD = "events array<struct<id:string,name:string,date:string,competitions:array<struct<id:string,status:struct<type:struct<state:string>>,competitors:array<struct<homeAway:string,team:struct<id:string,displayName:string,abbreviation:string>>>>>>>"


def read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One of the four JSON arrays of a snapshot; channels get closed as a boolean and pos, their place in the file."""
    df = spark.read.schema(SCHEMAS[kind]).json(f"{folder}/{kind}.json", multiLine=True)
    return df.withColumn("closed", F.col("closed").isNotNull() & (F.col("closed") != "")).withColumn("pos", F.monotonically_increasing_id()) if kind == "channels" else df


def choose_snapshot(snapshots: DataFrame, now, ttl_seconds: int = 86_400) -> DataFrame:
    """path, stale: the newest readable snapshot (path, fetched_at, readable); stale if it is past its time to live."""
    last = snapshots.where("readable").agg(F.max_by("path", "fetched_at").alias("path"), F.max("fetched_at").alias("fetched_at")).where("path is not null")
    return last.select("path", (~fresh(F.col("fetched_at"), now, ttl_seconds)).alias("stale"))


def refresh(spark: SparkSession, root: str, fetch, now, ttl_seconds: int = 86_400) -> tuple[str, bool]:
    """(path, stale) of the snapshot to read. The newest one under root (a folder for each, named by its time in seconds)
    if it is within its time to live; else fetch(path) lands a new one. If that fails the newest is served, marked stale;
    without any the error is raised. A folder without the mark that fetching ended doesn't count."""
    from tunerline.operators.state import _fs

    fs, top = _fs(spark, root)
    found = []
    for s in fs.listStatus(top) if fs.exists(top) else []:
        name = s.getPath().getName()
        if name.isdigit() and fs.exists(_fs(spark, f"{root}/{name}/_SUCCESS")[1]):
            found.append(int(name))
    last = max(found, default=None)
    if last is not None and now - last < ttl_seconds:
        return f"{root}/{last}", False
    path = f"{root}/{int(now)}"
    try:
        fetch(path)
        fs.create(_fs(spark, f"{path}/_SUCCESS")[1], True).close()
        return path, False
    except Exception:
        fs.delete(_fs(spark, path)[1], True)
        if last is None:
            raise
        return f"{root}/{last}", True


def conditional(stored: DataFrame, responses: DataFrame) -> DataFrame:
    """url, status, etag, body after conditional requests (responses: the same columns). 200 replaces body and tag, 304
    keeps the stored ones, any other status keeps them too and is noted; urls that weren't asked stay."""
    r = responses.select("url", F.col("status").alias("_s"), F.col("etag").alias("_e"), F.col("body").alias("_b"))
    fresh_ = F.coalesce(F.col("_s") == 200, F.lit(False))
    return stored.join(r, "url", "full").select("url", F.coalesce("_s", "status").alias("status"), F.when(fresh_, F.col("_e")).otherwise(F.col("etag")).alias("etag"), F.when(fresh_, F.col("_b")).otherwise(F.col("body")).alias("body"))


def teams(rows: DataFrame, body: str = "body") -> DataFrame:
    """team_id, name, short_name, abbreviation, location, logo of team documents. All columns but body stay."""
    keep = [c for c in rows.columns if c != body]
    t = rows.select(*keep, F.explode_outer(F.from_json(body, TEAMS)["sports"]).alias("s")).select(*keep, F.explode_outer("s.leagues").alias("l")).select(*keep, F.explode_outer("l.teams").alias("t")).where("t.team is not null")
    t = t.select(*keep, "t.team.*")
    return t.select(*keep, F.col("id").alias("team_id"), F.col("displayName").alias("name"), F.col("shortDisplayName").alias("short_name"), "abbreviation", "location", F.get(F.col("logos"), F.lit(0))["href"].alias("logo"))


def scoreboard(rows: DataFrame, body: str = "body") -> DataFrame:
    """event_id, name, start, state, home, away of scoreboard documents. All columns but body stay."""
    keep = [c for c in rows.columns if c != body]
    e = rows.select(*keep, F.explode_outer(F.from_json(body, SCOREBOARD)["events"]).alias("e")).where("e is not null")
    c = F.get(F.col("e.competitions"), F.lit(0))
    side = lambda s: F.get(F.filter(c["competitors"], lambda x: x["homeAway"] == s), F.lit(0))["team"]["displayName"]
    return e.select(*keep, F.col("e.id").alias("event_id"), F.col("e.name").alias("name"), F.try_to_timestamp("e.date").alias("start"), c["status"]["type"]["state"].alias("state"), side("home").alias("home"), side("away").alias("away"))


def read_dimension(path: str) -> dict:
    """A YAML or JSON dimension file (version 1), parsed on the driver."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if data.get("version") != 1:
        raise ValueError(f"{path}: version 1 is expected")
    return data


def aliases(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame([(a["canonical"], list(a["names"]), i) for i, a in enumerate(data["aliases"])], "canonical string, names array<string>, pos int")


def stations(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame([(s["callsign"], s["network"], s["city"], i) for i, s in enumerate(data["stations"])], "callsign string, network string, city string, pos int")


def leagues(spark: SparkSession, data: dict) -> DataFrame:
    """Leagues of all categories with their parent's id, disabled ones too."""
    rows = [(c["id"], x["espnPath"], x["displayName"], int(x["priority"]), bool(x.get("disabled", False)), x.get("disabledReason")) for c in data["categories"] for x in c["leagues"]]
    return spark.createDataFrame(rows, "category_id string, espn_path string, display_name string, priority int, disabled boolean, disabled_reason string")
