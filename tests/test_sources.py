"""Panel scans, pluggable sources, health, snapshots, reports."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

from tunerline.functions import similarity
from tunerline.operators import categories, health, incremental, reports, resolve, scratch, tables
from tunerline.sources import panel, reference, registry, xmltv

NOW = "2024-01-15"
GOOD = '{"user_info":{"status":"Active","allowed_output_formats":["m3u8"]},"server_info":{"url":"x"}}'
CATEGORIES = '[{"category_id":"1","category_name":"US Sports"},{"category_id":"2","category_name":"Kids"},{"category_id":"3","category_name":"Movies"}]'
STREAMS = '[{"stream_id":7,"name":"ESPN","stream_icon":"","epg_channel_id":"","category_id":"1","tv_archive":1,"tv_archive_duration":3},{"stream_id":"8","name":"TUDN","epg_channel_id":"t","category_id":"2"},{"stream_id":9,"name":"Z","category_id":"99"}]'


def _panel(spark):
    probes = spark.createDataFrame([("a", "", GOOD), ("b", "ts", GOOD.replace("Active", "Banned")), ("c", "ts", GOOD)], "source_id string, output string, body string")
    cats = spark.createDataFrame([(s, CATEGORIES) for s in "abc"], "source_id string, body string")
    streams = spark.createDataFrame([("a", "1", STREAMS), ("a", "2", STREAMS), ("b", "1", STREAMS), ("c", "1", "[]")], "source_id string, category_id string, body string")
    return probes, cats, streams


def test_panel_scan(spark):
    rows, attempts, counts = panel.scan(*_panel(spark), F.lit(NOW).cast("timestamp"))
    got = sorted((r["source_id"], r["stream_key"], r["group_name"], r["tvg_id"], r["url_template"], r["tv_archive"], r["tv_archive_hours"]) for r in rows.collect())
    url = "{server}/live/{username}/{password}/%s.m3u8"
    assert got == [("a", "7", "US Sports", None, url % 7, True, 3), ("a", "8", "Kids", "t", url % 8, False, None), ("a", "9", "US Sports", None, url % 9, False, None)]
    assert sorted((r["source_id"], r["error"]) for r in attempts.collect()) == [("a", None), ("b", "status=Banned"), ("c", None)]
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 1, 2), ("c", 1, 2)]
    forced = spark.createDataFrame([("kids", "sports"), ("us sports", "not-sports")], "name string, forced string")
    assert {r["stream_key"] for r in panel.scan(*_panel(spark), F.lit(NOW).cast("timestamp"), forced)[0].collect()} == {"7", "8", "9"}


def test_accounts_give_two_sources(spark):
    a = spark.createDataFrame([('[{"id":"p","serverUrl":"http://h","username":"u","password":"q"}]',), ("[]",)], "b string").select(panel.accounts(F.col("b")).alias("accounts"))
    assert sorted(tuple(r) for r in panel.account_sources(a).collect()) == [("p", "channels", "xtream"), ("p", "guide", "epg")]


def test_sources_plug_in_and_fail_alone(spark):
    def broken(spark):
        raise OSError("GET http://h/live/me/secret/9.ts failed")

    one = spark.createDataFrame([("1", "ESPN")], "stream_key string, name string")
    sources = [registry.Frame("a", "m3u", one), registry.Frame("b", "xtream", broken), registry.Frame("c", "m3u", lambda s: one)]
    rows, attempts = registry.collect(spark, sources)
    assert sorted((r["source_id"], r["stream_key"], r["logo"]) for r in rows.collect()) == [("a", "1", None), ("c", "1", None)]
    assert [tuple(r) for r in attempts.orderBy("source_id").collect()] == [("a", "m3u", None), ("b", "xtream", "GET http://h/live/**/**/9.ts failed"), ("c", "m3u", None)]
    old = spark.createDataFrame([("a", "0", "gone"), ("b", "5", "last good"), ("d", "1", "not asked")], "source_id string, stream_key string, name string")
    columns = ["stream_key", "name"]
    h = incremental.content_hash(old, ["source_id"], columns)
    new = rows.select("source_id", "stream_key", "name")
    table, hashes, replaced = incremental.ingest(old, new, attempts, h, columns)
    assert sorted(tuple(r) for r in table.collect()) == [("a", "1", "ESPN"), ("b", "5", "last good"), ("c", "1", "ESPN"), ("d", "1", "not asked")]
    assert sorted(r[0] for r in replaced.collect()) == ["a", "c"]
    again, _, replaced = incremental.ingest(table, new, attempts, hashes, columns)
    assert replaced.isEmpty() and again.count() == 4
    sources_ = health.mark(spark.createDataFrame([("b", "x", "mine", True, None, None), ("d", "m3u", None, True, None, None)], health.SOURCES), attempts, F.lit(NOW).cast("timestamp"))
    got = {r["source_id"]: (r["kind"], r["label"], r["healthy"], r["last_error"]) for r in sources_.collect()}
    assert got == {"a": ("m3u", None, True, None), "b": ("xtream", "mine", False, "GET http://h/live/**/**/9.ts failed"), "c": ("m3u", None, True, None), "d": ("m3u", None, True, None)}
    assert tuple(health.status(sources_, spark.createDataFrame([(2,)], "version int")).first()) == ("degraded", 2, 4, 1)
    assert health.status(sources_.where("healthy"), spark.createDataFrame([(2,)], "version int")).first()["status"] == "ok"
    assert health.status(sources_.where("healthy"), spark.createDataFrame([], "version int")).first()["status"] == "degraded"


def test_classification_is_observed(spark):
    c = spark.createDataFrame([(1, "US Sports"), (2, "Kids")], "category_id int, category_name string")
    seen = Observation("categories")
    categories.observed(categories.classified(c), seen).collect()
    assert seen.get == {"included": 1, "excluded": 1}


def test_snapshots_refresh(spark, tmp_path):
    root = str(tmp_path / "snap")
    calls = []

    def fetch(path):
        calls.append(path)
        os.makedirs(path, exist_ok=True)
        (tmp_path / "snap" / os.path.basename(path) / "channels.json").write_text("[]")

    def fail(path):
        fetch(path)
        raise OSError("no network")

    with pytest.raises(OSError):
        reference.refresh(spark, root, fail, 1_000)
    assert reference.refresh(spark, root, fetch, 2_000) == (f"{root}/2000", False)
    assert reference.refresh(spark, root, fail, 2_000 + 86_399) == (f"{root}/2000", False) and len(calls) == 2
    assert reference.refresh(spark, root, fail, 2_000 + 86_400) == (f"{root}/2000", True)
    assert reference.refresh(spark, root, fetch, 90_000) == (f"{root}/90000", False)


def test_conditional_requests_and_teams(spark):
    body = '{"sports":[{"leagues":[{"teams":[{"team":{"id":"1","displayName":"Bears","abbreviation":"CHI","logos":[{"href":"u"}]}},{}]}]}]}'
    cols = "url string, status int, etag string, body string"
    stored = spark.createDataFrame([("a", 200, "e1", "old"), ("b", 200, "e2", "kept"), ("c", 200, "e3", "c")], cols)
    asked = spark.createDataFrame([("a", 200, "e9", body), ("b", 304, None, None), ("c", 500, None, None), ("d", 404, None, None)], cols)
    now = reference.conditional(stored, asked)
    assert sorted((r["url"], r["status"], r["etag"], r["body"]) for r in now.collect()) == [("a", 200, "e9", body), ("b", 304, "e2", "kept"), ("c", 500, "e3", "c"), ("d", 404, None, None)]
    t = reference.teams(now.where("url in ('a', 'd')")).collect()
    assert [(r["url"], r["team_id"], r["name"], r["short_name"], r["logo"]) for r in t] == [("a", "1", "Bears", None, "u")]


def test_reports_and_dimension_files(spark, tmp_path):
    data = {"version": 1, "categories": [{"id": "x", "leagues": [{"espnPath": "p/1", "displayName": "É", "priority": 1}, {"espnPath": "p/2", "displayName": "B", "priority": 2}]}]}
    audit = spark.createDataFrame([("p/1", True, None), ("p/2", False, "unexpected status 404")], "espn_path string, ok boolean, error string")
    made = reports.disabled(data, audit)
    assert [x.get("disabled") for x in made["categories"][0]["leagues"]] == [None, True] and "disabled" not in data["categories"][0]["leagues"][1]
    path = str(tmp_path / "leagues.json")
    reports.write_dimension(spark, made, path)
    back = reference.leagues(spark, reference.read_dimension(path)).orderBy("priority").collect()
    assert [(r["display_name"], r["disabled"], r["disabled_reason"]) for r in back] == [("É", False, None), ("B", True, "unexpected status 404")]
    summary = audit.agg(F.count_if("ok").alias("okCount"), F.count_if(~F.col("ok")).alias("failedCount"))
    reports.write_json(summary, str(tmp_path / "r" / "report.json"), audit.where("not ok"))
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"okCount": 1, "failedCount": 1, "entries": [{"espn_path": "p/2", "ok": False, "error": "unexpected status 404"}]}


def test_small_tables(spark):
    meta = incremental.put(spark.createDataFrame([("version", "1"), ("x", "y")], "key string, value string"), "version", "2")
    assert sorted(tuple(r) for r in meta.collect()) == [("version", "2"), ("x", "y")]
    d = spark.createDataFrame([("a/b/c", '{"k":3}'), ("a", "junk"), (None, None)], "p string, j string")
    got = d.select(tables.split_path(F.col("p")).alias("s"), tables.parse(F.col("j"), "k long")["k"].alias("k"), tables.lookup(F.col("p"), {"a": "x"}).alias("l")).collect()
    assert [(r["s"]["head"], r["s"]["rest"], r["k"], r["l"]) for r in got[:2]] == [("a", "b/c", 3, None), ("a", "", None, "x")]
    assert got[2]["l"] is None and d.limit(0).select(tables.lookup(F.col("p"), {}).alias("l")).collect() == []


def test_letters_split_across_blocks(spark, tmp_path):
    """A guide of letters of two to four bytes, long enough that some stand across the borders of what is read at once."""
    titles = [("é日🔥" * 3000)[i:] for i in range(40)]
    body = "".join(f'<programme start="20260115173000 +0000" stop="20260115200000 +0000" channel="c{i}"><title>{t}</title></programme>\n' for i, t in enumerate(titles))
    (tmp_path / "g.xml").write_text(f"<tv>\n{body}</tv>", encoding="utf-8")
    assert {r["channel_ref"]: r["title"] for r in xmltv.read(spark, str(tmp_path)).collect()} == {f"c{i}": t for i, t in enumerate(titles)}


def test_letter_bound_loses_nothing(spark):
    """All pairs of random names: bounded() lets every pair pass whose score reaches the threshold."""
    rng = random.Random(7)
    words = ["espn", "golf", "fox", "news", "sports", "one", "two", "hd", "detroit", "detriot", "a", "ab", "bba", "1", "42"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(90)} | {"".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))).strip() for _ in range(60)})
    d = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = d.crossJoin(d.withColumnRenamed("a", "b"))
    a, b = F.col("a"), F.col("b")
    for threshold in (0.85, 0.6):
        kept = similarity.bounded(a, b, similarity.sides(a), similarity.sides(b), threshold)
        got = pairs.select(kept.alias("kept"), (similarity.combined_score(a, b) >= threshold).alias("reaches")).groupBy("kept", "reaches").count().collect()
        n = {(r["kept"], r["reaches"]): r["count"] for r in got}
        assert n.get((False, True), 0) == 0 and n[True, True] > 100 and n[False, False] > 1000


def test_threshold_is_a_parameter(spark):
    keys = spark.createDataFrame([("golf chanel",), ("glof",)], "key string")
    index = spark.createDataFrame([("golf channel", "g", 0, 0)], "name_key string, ref_id string, pos int, alt_pos int")
    got = {t: {r["key"] for r in resolve.best_fuzzy(keys, index, t).collect()} for t in (0.99, 0.85, 0.3)}
    assert got == {0.99: set(), 0.85: {"golf chanel"}, 0.3: {"golf chanel", "glof"}}


def test_scratch(spark):
    kept = scratch.settle(spark.range(5), "t")
    assert kept.count() == 5
    path = scratch._made[-1][1]
    assert os.path.isdir(path.removeprefix("file://"))
    scratch.clear()
    assert not os.path.isdir(path.removeprefix("file://"))


@pytest.fixture
def server():
    """A local server of fixed answers; asked has the paths in their order."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    answers, asked = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            status, body = answers.get(self.path, (404, ""))
            tag = f'"{len(body)}"'
            if self.headers.get("If-None-Match") == tag:
                status, body = 304, ""
            self.send_response(status)
            self.send_header("ETag", tag)
            self.end_headers()
            self.wfile.write(body.encode("utf-8"))

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", answers, asked
    s.shutdown()


def test_sources_over_http(spark, server, tmp_path):
    from tunerline.sources import fetch

    url, answers, asked = server
    folder = str(tmp_path)
    guide = '<tv><programme start="20260115173000 +0000" stop="20260115200000 +0000" channel="c"><title>Café</title></programme></tv>'
    key = "username=me&password=a+b%26c"
    answers |= {
        "/list.m3u": (200, "#EXTM3U\n#EXTINF:-1 tvg-id=\"t\",ESPN\nhttp://h/live/u/p/1.ts\n"), "/broken.m3u": (500, "x"), "/guide.xml": (200, guide), f"/player_api.php?{key}": (200, GOOD),
        f"/player_api.php?{key}&action=get_live_categories": (200, CATEGORIES), f"/player_api.php?{key}&action=get_live_streams&category_id=1": (200, STREAMS), f"/xmltv.php?{key}": (200, guide),
        "/player_api.php?username=x&password=y": (200, GOOD.replace("Active", "Banned")),
    }
    good, bad = ({"id": i, "server_url": f"{url}/", "username": u, "password": p} for i, u, p in (("acc", "me", "a b&c"), ("bad", "x", "y")))
    channels, epg = fetch.of_account(good, folder)
    rows, attempts = registry.collect(spark, [fetch.Playlist("m3u-0", f"{url}/list.m3u", folder), fetch.Playlist("m3u-1", f"{url}/broken.m3u", folder), channels, fetch.of_account(bad, folder)[0]])
    got = sorted((r["source_id"], r["name"], r["url_template"], r["container_ext"]) for r in rows.collect())
    template = "{server}/live/{username}/{password}/%s.m3u8"
    assert got == [("acc", "ESPN", template % 7, "m3u8"), ("acc", "TUDN", template % 8, "m3u8"), ("acc", "Z", template % 9, "m3u8"), ("m3u-0", "ESPN", "http://h/live/**/**/1.ts", "ts")]
    errors = {r["source_id"]: r["error"] for r in attempts.collect()}
    assert errors == {"m3u-0": None, "m3u-1": "request failed (500)", "acc": None, "bad": "account bad is unhealthy: status=Banned"}
    assert [p for p in asked if "username=x" in p] == ["/player_api.php?username=x&password=y"]
    assert not any("category_id=2" in p for p in asked)
    programmes, attempts = registry.collect(spark, [fetch.Guide("epg-0", f"{url}/guide.xml", folder), epg, fetch.Guide("epg-1", f"{url}/none.xml", folder)], registry.PROGRAMMES)
    assert sorted((r["source_id"], r["channel_ref"], r["title"]) for r in programmes.collect()) == [("acc", "c", "Café"), ("epg-0", "c", "Café")]
    assert {r["source_id"] for r in health.succeeded(attempts).collect()} == {"acc", "epg-0"}


def test_conditional_landing(spark, server, tmp_path):
    from tunerline.sources import fetch

    url, answers, _ = server
    answers["/a"] = (200, "one" * 1_000_000)
    path = str(tmp_path / "a.txt")
    first = fetch.land(spark, f"{url}/a", path)
    assert first.status == 200 and (tmp_path / "a.txt").read_text() == "one" * 1_000_000
    assert fetch.land(spark, f"{url}/a", path, etag=first.etag) == (304, first.etag)
    answers["/a"] = (503, "down")
    with pytest.raises(fetch.FetchError, match=r"^request failed \(503\)$"):
        fetch.land(spark, f"{url}/a", path)
    assert (tmp_path / "a.txt").read_text() == "one" * 1_000_000
    answers["/a"] = (200, "new")
    assert fetch.land(spark, f"{url}/a", path, etag=first.etag).status == 200 and (tmp_path / "a.txt").read_text() == "new"
