"""Sources over HTTP: the driver lands each document in a folder that the executors share, and Spark reads it there."""

from __future__ import annotations

import shutil
import urllib.error
import urllib.request
from typing import NamedTuple
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.operators import categories
from tunerline.operators.state import _fs
from tunerline.sources import m3u, panel, xmltv


class FetchError(OSError):
    """A status that is neither success nor, for a conditional request, not modified."""


class Unhealthy(ValueError):
    """A panel account that its probe shows to be unusable."""


class Landed(NamedTuple):
    status: int
    etag: str | None


class _Out:
    """A Hadoop output stream as a file."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data: bytes) -> None:
        self.stream.write(bytearray(data))


def _put(spark: SparkSession, part, target) -> None:
    """Rename over what is there, in one step of the file system: a crash leaves the old document or the new one."""
    context = spark.sparkContext
    kind = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = context._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(part), files.makeQualified(target), options)


def land(spark: SparkSession, url: str, path: str, headers: dict[str, str] | None = None, etag: str | None = None, timeout: float = 60) -> Landed:
    """Write a document's body to path, piece by piece and then at once in place. With an etag the request is conditional:
    304 leaves path as it is. Any other status but success raises, and path stays too. The URL isn't part of the message."""
    request = urllib.request.Request(url, headers=(headers or {}) | ({"If-None-Match": etag} if etag else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            fs, target = _fs(spark, path)
            _, part = _fs(spark, f"{path}.part")
            out = fs.create(part, True)
            try:
                shutil.copyfileobj(answer, _Out(out), 1 << 20)
            finally:
                out.close()
            _put(spark, part, target)
            return Landed(answer.status, answer.headers.get("ETag"))
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return Landed(304, etag)
        raise FetchError(f"request failed ({e.code})") from None


class Playlist:
    """A playlist by its URL."""

    kind = "m3u"

    def __init__(self, source_id: str, url: str, folder: str, headers: dict[str, str] | None = None):
        self.source_id, self.url, self.folder, self.headers = source_id, url, folder, headers

    def rows(self, spark: SparkSession) -> DataFrame:
        path = f"{self.folder}/{self.source_id}.m3u"
        land(spark, self.url, path, self.headers)
        rows = m3u.parse(m3u.read(spark, path))
        return rows.withColumnRenamed("url", "url_template").withColumnRenamed("ext", "container_ext")


class Guide:
    """A programme guide by its URL."""

    kind = "epg"

    def __init__(self, source_id: str, url: str, folder: str, headers: dict[str, str] | None = None):
        self.source_id, self.url, self.folder, self.headers = source_id, url, folder, headers

    def rows(self, spark: SparkSession) -> DataFrame:
        path = f"{self.folder}/{self.source_id}.xml"
        land(spark, self.url, path, self.headers)
        return xmltv.read(spark, path)


class Panel:
    """The channels of a panel account: probe, categories, then one request for each included category, in turn."""

    kind = "xtream"

    def __init__(self, account: dict, folder: str, overrides: DataFrame | None = None, headers: dict[str, str] | None = None):
        """account: id, server_url, username, password, output (may be missing)."""
        self.source_id, self.account, self.folder, self.overrides, self.headers = account["id"], account, f"{folder}/{account['id']}", overrides, headers

    def url(self, page: str = "player_api.php", **params: str) -> str:
        return f"{self.account['server_url'].rstrip('/')}/{page}?" + urlencode({"username": self.account["username"], "password": self.account["password"], **params})

    def _landed(self, spark: SparkSession, name: str, **params: str) -> DataFrame:
        path = f"{self.folder}/{name}.json"
        land(spark, self.url(**params), path, self.headers)
        return spark.read.text(path, wholetext=True).select(F.lit(self.source_id).alias("source_id"), F.col("value").alias("body"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """An unhealthy account raises before anything else is asked for."""
        probes = self._landed(spark, "probe").withColumn("output", F.lit(self.account.get("output")).cast("string"))
        health = probes.select(panel.account_health(F.col("body"), F.current_timestamp()).alias("h")).first()["h"]
        if not health["healthy"]:
            raise Unhealthy(f"account {self.source_id} is unhealthy: {health['reason'] or 'unknown'}")
        cats = self._landed(spark, "categories", action="get_live_categories")
        named = categories.classified(cats.select(F.explode(F.from_json("body", panel.CATEGORIES)).alias("c")).select("c.*"), self.overrides)
        included = [r["category_id"] for r in named.where("classification <> 'not-sports'").select("category_id").distinct().collect()]  # categories of one account
        streams = spark.createDataFrame([], "source_id string, category_id string, body string")
        for c in sorted(included):
            body = self._landed(spark, f"streams-{quote(c, safe='')}", action="get_live_streams", category_id=c)
            streams = streams.unionByName(body.withColumn("category_id", F.lit(c)))
        return panel.scan(probes, cats, streams, F.current_timestamp(), self.overrides)[0]


class PanelGuide(Guide):
    """The guide of a panel account."""

    def __init__(self, account: dict, folder: str, headers: dict[str, str] | None = None):
        super().__init__(account["id"], Panel(account, folder).url("xmltv.php"), folder, headers)


def of_account(account: dict, folder: str) -> tuple[Panel, PanelGuide]:
    """The two sources that an account gives."""
    return Panel(account, folder), PanelGuide(account, folder)
