"""Any number of sources over HTTP in one plan: executors fetch, a request that fails is a row with an error, and documents are read where they are."""

from __future__ import annotations

import gzip
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.functions.links import redact
from tunerline.operators.categories import classified
from tunerline.operators.scratch import settle
from tunerline.sources import m3u, panel, xmltv

REQUESTS = "source_id string, kind string, name string, url string"
DOCUMENTS = "source_id string, kind string, name string, body binary, error string"
#: Seconds that a request may take, and the bytes that a document may have; a larger one is an error and not cut.
TIMEOUT, MOST_BYTES = 60.0, 1 << 30


def _body(url: str, timeout: float, most: int) -> bytes:
    request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            data = answer.read(most + 1)
    except urllib.error.HTTPError as e:
        raise OSError(f"request failed ({e.code})") from None
    if len(data) > most:
        raise OSError("document too large")
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def fetch(requests: DataFrame, partitions: int | None = None, timeout: float = TIMEOUT, most: int = MOST_BYTES) -> DataFrame:
    """DOCUMENTS: the answer to each of requests (REQUESTS), or why there is none; no request keeps another from being made.

    Requests are dealt over partitions (all cores, if not given) and made one after another in each. The documents are written once to the
    shared folder, so that what reads them later doesn't ask again, and a lost executor costs its own requests. Errors don't hold URLs."""
    spark = requests.sparkSession

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                body, error = None, None
                try:
                    body = _body(row["url"], timeout, most)
                except Exception as e:  # whatever goes wrong is this request's failure
                    error = str(e) or type(e).__name__
                columns = {c: pa.array([row[c]], pa.string()) for c in ("source_id", "kind", "name")}
                yield pa.RecordBatch.from_pydict(columns | {"body": pa.array([body], pa.binary()), "error": pa.array([error], pa.string())})

    rows = requests.select("source_id", "kind", "name", "url").repartition(partitions or spark.sparkContext.defaultParallelism)
    return settle(rows.mapInArrow(run, DOCUMENTS).withColumn("error", redact(F.col("error"))), "documents")


def attempts(documents: DataFrame) -> DataFrame:
    """source_id, kind, error: one row for each source; the least of its errors, null if it has none."""
    return documents.groupBy("source_id", "kind").agg(F.min("error").alias("error"))


def _text(body: Column) -> Column:
    """The body as text; bytes that aren't UTF-8 become replacement characters, as a decoder does."""
    return F.make_valid_utf8(body.cast("string"))


def playlists(documents: DataFrame) -> DataFrame:
    """Channel rows of the playlists (kind m3u) among documents, as m3u.parse gives them."""
    good = documents.where("kind = 'm3u' and error is null").select("source_id", _text(F.col("body")).alias("content"))
    return m3u.parse(good).withColumnRenamed("url", "url_template").withColumnRenamed("ext", "container_ext")


def guides(documents: DataFrame) -> DataFrame:
    """source_id and the programme rows of the guides (kind epg) among documents.

    A guide is cut at its programme elements, and each is parsed by itself: one that is broken is left out, and a
    guide that ends too early gives what it has, so that neither keeps other guides from being read."""
    good = documents.where("kind = 'epg' and error is null")
    cut = good.select("source_id", F.explode(F.regexp_extract_all(_text(F.col("body")), F.lit(r"(?s)<programme[\s>].*?</programme\s*>"), F.lit(0))).alias("x"))
    raw = cut.select("source_id", F.from_xml("x", xmltv.SCHEMA, {"nullValue": "\x00", "mode": "PERMISSIVE"}).alias("p")).select("source_id", "p.*")
    return xmltv.programmes(raw, "source_id")


def panels(accounts: DataFrame, now: Column, overrides: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, attempts, counts) of panel accounts (source_id, server_url, username, password, output), as panel.scan gives them.

    All probes are made at once; then the categories of the healthy accounts, then the streams of all included categories, a request
    each. A request that fails is its account's error, and such an account gives no rows: it keeps its last good ones."""
    login = F.concat_ws("", F.lit("username="), F.url_encode("username"), F.lit("&password="), F.url_encode("password"))
    page = F.concat(F.regexp_replace("server_url", "/+$", ""), F.lit("/player_api.php?"), login)
    known = accounts.select("source_id", "output", page.alias("page"))

    def asked(rows: DataFrame, name: str, query: Column) -> DataFrame:
        return fetch(rows.select("source_id", F.lit("xtream").alias("kind"), F.lit(name).alias("name") if name != "streams" else F.col("category_id").alias("name"), F.concat("page", query).alias("url")), **limits)

    probed = asked(known, "probe", F.lit(""))
    probes = probed.where("error is null").join(known, "source_id").select("source_id", "output", _text(F.col("body")).alias("body"))
    healthy = probes.select("source_id", panel.account_health(F.col("body"), now).alias("h")).where("h.healthy").select("source_id")
    listed = asked(known.join(healthy, "source_id", "left_semi"), "categories", F.lit("&action=get_live_categories"))
    cats = listed.where("error is null").select("source_id", _text(F.col("body")).alias("body"))
    named = cats.select("source_id", F.explode(F.from_json("body", panel.CATEGORIES)).alias("c")).select("source_id", "c.*")
    included = classified(named, overrides).where("classification <> 'not-sports'").select("source_id", "category_id").distinct()
    streams = asked(included.join(known, "source_id"), "streams", F.concat(F.lit("&action=get_live_streams&category_id="), F.url_encode("category_id")))
    failed = attempts(probed.unionByName(listed).unionByName(streams)).where("error is not null")
    bodies = streams.where("error is null").select("source_id", F.col("name").alias("category_id"), _text(F.col("body")).alias("body"))
    rows, tried, counts = panel.scan(probes, cats, bodies, now, overrides)
    whole = failed.select("source_id")
    tried = tried.join(whole, "source_id", "left_anti").unionByName(failed.select("source_id", "kind", "error"))
    return rows.join(whole, "source_id", "left_anti"), tried, counts.join(whole, "source_id", "left_anti")


def requests(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """REQUESTS of configured sources (source_id, kind, url)."""
    return spark.createDataFrame([(s, k, "document", u) for s, k, u in sources], REQUESTS)
