import pytest
from pyspark.sql import functions as F

from tunerline.operators import categories, incremental, lookup, metrics, resolve, state
from tunerline.sources import m3u, panel, reference, xmltv
from tunerline.streaming import micro

# A reference world and labelled names (name, tvg id, group, expected id, whether an event).
WORLD = [
    ("ESPN.us", "ESPN", ["ESPN USA"]), ("ESPN2.us", "ESPN2", ["ESPN 2"]), ("ESPNU.us", "ESPNU", None), ("ESPNews.us", "ESPNews", None), ("ESPNDeportes.us", "ESPN Deportes", None),
    ("FoxSports1.us", "FOX Sports 1", None), ("FoxSports2.us", "FOX Sports 2", None), ("NBATV.us", "NBA TV", None), ("NFLNetwork.us", "NFL Network", None), ("NFLRedZone.us", "NFL RedZone", None),
    ("GolfChannel.us", "Golf Channel", None), ("CBSSportsNetwork.us", "CBS Sports Network", None), ("SkySportsMainEvent.uk", "Sky Sports Main Event", None), ("TUDN.us", "TUDN", None),
    ("WillowCricket.us", "Willow Cricket", None), ("BigTenNetwork.us", "Big Ten Network", None), ("SECNetwork.us", "SEC Network", None), ("ACCNetwork.us", "ACC Network", None),
    ("Pac12Network.us", "Pac-12 Network", None), ("YESNetwork.us", "YES Network", None), ("MLBNetwork.us", "MLB Network", None), ("NHLNetwork.us", "NHL Network", None), ("UnivisionDeportesNetwork.us", "Univision Deportes Network", None),
]
LABELLED = [
    ("US: ESPN", None, None, "ESPN.us"), ("ESPN HD", None, None, "ESPN.us"), ("eSpN", None, None, "ESPN.us"), ("ESPN.", None, None, "ESPN.us"), ("ESPN!!", None, None, "ESPN.us"), ("📺 ESPN 🔥", None, None, "ESPN.us"),
    ("ESPN2 FHD", None, None, "ESPN2.us"), ("USA| ESPN2", None, None, "ESPN2.us"), ("ESPN_2", None, None, "ESPN2.us"), ("ESPNU HD", None, None, "ESPNU.us"), ("ESPN News", None, None, "ESPNews"),
    ("ESPN Deportes", None, None, "ESPNDeportes.us"), ("ESPN Deprotes", None, None, "ESPNDeportes.us"), ("Some Weird Name", "ESPN2.us", None, "ESPN2.us"),
    ("FOX Sports Detroit (East)", None, None, "FanDuel Sports Network Detroit"), ("Bally Sports Detroit", None, None, "FanDuel Sports Network Detroit"), ("FanDuel Sports Network Detroit HD", None, None, "FanDuel Sports Network Detroit"),
    ("Fox Sports Ohio", None, None, "FanDuel Sports Network Ohio"), ("FanDuel Sports Network Ohio HD", None, None, "FanDuel Sports Network Ohio"),
    ("WABC New York HD", None, None, "station:WABC"), ("WCBS New York", None, None, "station:WCBS"), ("WNBC New York", None, None, "station:WNBC"), ("WNYW New York", None, None, "station:WNYW"),
    ("KABC Los Angeles", None, None, "station:KABC"), ("KCBS Los Angeles", None, None, "station:KCBS"), ("KNBC Los Angeles", None, None, "station:KNBC"), ("KTTV Los Angeles", None, None, "station:KTTV"),
    ("WLS Chicago", None, None, "station:WLS"), ("WBBM Chicago", None, None, "station:WBBM"), ("WMAQ Chicago", None, None, "station:WMAQ"), ("WFLD Chicago", None, None, "station:WFLD"),
    ("FOX 5 New York", None, None, "station:WNYW"), ("NBC 4 Los Angeles", None, None, "station:KNBC"), ("ABC 7 Chicago", None, None, "station:WLS"),
    ("Golf Channel HD", None, None, "GolfChannel.us"), ("NBA TV UHD", None, None, "NBATV.us"), ("MLB Network HD", None, None, "MLBNetwork.us"), ("NHL Network HD", None, None, "NHLNetwork.us"),
    ("Big Ten Network (East) HD", None, None, "BigTenNetwork.us"), ("SEC Network HD Backup", None, None, "SECNetwork.us"), ("ACC Network West HD", None, None, "ACCNetwork.us"), ("CBS Sports Network 4K", None, None, "CBSSportsNetwork.us"),
    ("Willow Cricket HD", None, None, "WillowCricket.us"), ("Univision Deportes Network", None, None, "UnivisionDeportesNetwork.us"), ("TUDN HD", None, None, "TUDN.us"), ("Pac-12 Network HD", None, None, "Pac12Network.us"),
    ("YES Network (East) HD", None, None, "YESNetwork.us"), ("NFL Network", None, None, "NFLNetwork.us"), ("NFL RedZone", None, None, "NFLRedZone.us"), ("FOX Sports 1", None, None, "FoxSports1.us"), ("FOX Sports 2 HD", None, None, "FoxSports2.us"),
    ("UK: Sky Sports Main Event", None, None, "SkySportsMainEvent.uk"), ("NFL 05 | KC @ BUF", None, "NFL GAME PASS", None), ("PPV 3 - UFC 320", None, "PPV EVENTS", None),
    ("beIN Sports en Español HD", None, None, None), ("Comedy Central HD", None, None, None), ("Some Totally Unknown Channel XYZ123", None, None, None),
]
CHANNEL = "source_id string, stream_key string, name string, tvg_id string, group_name string"


@pytest.fixture(scope="module")
def dims(spark):
    ref = spark.createDataFrame([(*w, False, i) for i, w in enumerate(WORLD)], "id string, name string, alt_names array<string>, closed boolean, pos int")
    return {"reference": ref, "index": lookup.reference_index(ref), "aliases": lookup.alias_index(lookup.seed_aliases(spark)), "stations": lookup.seed_stations(spark)}


def test_accuracy_is_full(spark, dims):
    # a source for each name: equal keys with different ids would share the first one's answer
    rows = [(f"s{i:02}", str(i), n, t, g) for i, (n, t, g, _) in enumerate(LABELLED)]
    expected = spark.createDataFrame([(f"s{i:02}", str(i), e, bool(g)) for i, (_, _, g, e) in enumerate(LABELLED)], "source_id string, stream_key string, expected_id string, expect_event boolean")
    got, fresh = resolve.resolve(spark.createDataFrame(rows, CHANNEL), **dims)
    got = got.cache()
    assert metrics.mismatches(got, expected).collect() == []
    r = metrics.accuracy(got, expected).first()
    assert (r["total"], r["correct"], r["accuracy"]) == (57, 57, 1.0)
    assert metrics.accuracy(got.limit(0), expected).first()["accuracy"] == 1.0
    assert fresh.count() == fresh.select("normalized_key").distinct().count()


def test_memo_decides_before_the_rest(spark, dims):
    memo = spark.createDataFrame([("espn", "old", "alias", 0.5)], resolve.MEMO)
    got, fresh = resolve.resolve(spark.createDataFrame([("a", "1", "ESPN", "ESPN2.us", None), ("a", "2", "TUDN", None, None)], CHANNEL), **dims, memo=memo)
    assert {r["stream_key"]: r["canonical_id"] for r in got.collect()} == {"1": "old", "2": "TUDN.us"}
    assert [r["normalized_key"] for r in fresh.collect()] == ["tudn"]


def test_pruning_loses_nothing(spark, dims):
    keys = spark.createDataFrame([("espn deprotes",), ("willow criket",), ("nfl redzon",), ("fox sport",), ("espm",), ("",)], "key string")
    index = dims["index"]
    one, two = (sorted(map(tuple, resolve.best_fuzzy(keys, index, prune=p).collect())) for p in (True, False))
    assert one == two and one


def test_empty_reference(spark, dims):
    none = {**dims, "reference": dims["reference"].limit(0), "index": dims["index"].limit(0)}
    got, _ = resolve.resolve(spark.createDataFrame([("a", "1", "Nobody Knows", None, None)], CHANNEL), **none)
    assert got.first()["method"] == "unresolved"


PLAYLIST = '#EXTM3U\r\n#EXTINF:-1 tvg-id="ESPN.us" tvg-name="ESPN HD" group-title="Sports",ESPN, the one\r\n\r\n#EXTVLCOPT:x\nhttp://h/live/u/p/1.m3u8?t=1\nhttp://h/orphan\n#EXTINF:-1 tvg-name="Second",\n#EXTINF:-1 tvg-id="" tvg-name="Third",\nhttp://h/3\n#EXTINF:-1,\nhttp://h/4'


def test_m3u(spark):
    rows = m3u.parse(spark.createDataFrame([("p", PLAYLIST), ("empty", ""), ("null", None)], "source_id string, content string")).orderBy("pos").collect()
    assert [(r["name"], r["tvg_id"], r["group_name"], r["url"], r["ext"]) for r in rows] == [("ESPN, the one", "ESPN.us", "Sports", "http://h/live/**/**/1.m3u8?t=1", "m3u8"), ("Third", None, None, "http://h/3", "ts"), ("Unknown", None, None, "http://h/4", "ts")]


GUIDE = """<?xml version="1.0"?><tv><channel id="a"><display-name>A</display-name></channel>
<programme start="20260115230000 -0500" stop="20260116010000 -0500" channel="a"><title lang="en">First &amp; last</title><sub-title>s</sub-title><category></category><category>Sports</category><previously-shown/></programme>
<programme start="20260115173000 +0000" stop="20260115200000 +0000" channel="b"><title><![CDATA[Café]]></title><desc>d</desc></programme>
<programme start="20260115173000 +0000" stop="20260115200000 +0000" channel="b"><title></title></programme>
<programme start="20260115173000 +0000" channel="b"><title>no stop</title></programme></tv>"""


def test_xmltv_batch_equals_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "g.xml").write_text(GUIDE, encoding="utf-8")
    batch = {(r["channel_ref"], str(r["start"]), r["title"], r["category"], r["previously_shown"]) for r in xmltv.read(spark, str(inbox)).collect()}
    assert batch == {("a", "2026-01-16 04:00:00", "First & last", "Sports", True), ("b", "2026-01-15 17:30:00", "Café", None, False)}
    for _ in range(2):  # the second run finds nothing new
        micro.ingest_guides(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["channel_ref"], str(r["start"]), r["title"], r["category"], r["previously_shown"]) for r in got.collect()} == batch


def test_channel_stream_equals_batch(spark, dims, tmp_path):
    rows = [("s", str(i), n, t, g) for i, (n, t, g, _) in enumerate(LABELLED[:20])]
    folder = str(tmp_path / "ch")
    spark.createDataFrame(rows, CHANNEL).repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(CHANNEL).option("maxFilesPerTrigger", 1).parquet(folder)
    micro.resolve_channels(stream, dims, str(tmp_path / "memo"), str(tmp_path / "res"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["stream_key"], r["canonical_id"]) for r in state.read(spark, str(tmp_path / "res"), micro.RESOLUTIONS).collect()}
    want = {(r["stream_key"], r["canonical_id"]) for r in resolve.resolve(spark.createDataFrame(rows, CHANNEL), **dims)[0].collect()}
    assert got == want
    assert state.version(spark, str(tmp_path / "memo")) >= 2


def test_incremental(spark, tmp_path):
    one = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z"), ("b", "1", "z")], "source_id string, stream_key string, name string")
    h = lambda df: incremental.content_hash(df, ["source_id"], ["stream_key", "name"])
    assert incremental.changed(h(one.orderBy(F.desc("name"))), h(one), ["source_id"]).isEmpty()
    fewer = one.dropDuplicates()
    assert [r["source_id"] for r in incremental.changed(h(fewer), h(one), ["source_id"]).collect()] == ["b"]
    path = str(tmp_path / "t")
    incremental.write_replacing(one, path, ["a", "b"])
    incremental.write_replacing(one.where("stream_key = '2'"), path, ["a"])
    incremental.write_replacing(one.limit(0), path, ["b"])
    assert {tuple(r) for r in spark.read.parquet(path).select("source_id", "stream_key").collect()} == {("a", "2")}
    v = spark.createDataFrame([(3,)], "version int")
    assert incremental.bump(v, one).first()["version"] == 4 and incremental.bump(v, one.limit(0)).first()["version"] == 3


def test_panel(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    good = '{"user_info":{"status":"Active","exp_date":"4795200000","max_connections":"1","active_cons":0,"allowed_output_formats":["m3u8"]},"server_info":{"url":"x"}}'
    bodies = [(good,), (good.replace("4795200000", ""),), (good.replace("Active", "Banned"),), ("{}",), ("junk",)]
    r = [x["h"] for x in spark.createDataFrame(bodies, "b string").select(panel.account_health(F.col("b"), now).alias("h")).collect()]
    assert [x["healthy"] for x in r] == [True, False, False, False, False]
    assert r[1]["reason"] == "status=Active (expired)" and r[2]["reason"] == "status=Banned" and "malformed" in r[4]["reason"]
    a = '[{"id":"p","serverUrl":"http://h//","username":"u","password":"q"}]'
    got = spark.createDataFrame([(a,), (a.replace("username", "x"),), ("nope",), (None,)], "b string").select(panel.accounts(F.col("b")).alias("a")).collect()
    assert got[0]["a"][0]["server_url"] == "http://h" and [len(x["a"]) for x in got] == [1, 0, 0, 0]


def test_categories_and_overrides(spark):
    c = spark.createDataFrame([(1, "US Sports"), (2, "Liverpool TV"), (3, "News"), (4, "Events"), (5, " Kids ")], "category_id int, category_name string")
    o = spark.createDataFrame([("kids", "sports")], "name string, forced string")
    assert [r["classification"] for r in categories.classified(c, o).orderBy("category_id").collect()] == ["sports", "sports", "not-sports", "maybe-sports", "sports"]


def test_reference_files(spark, tmp_path):
    (tmp_path / "channels.json").write_text('[{"id":"a","name":"A","alt_names":["B"],"closed":null},{"id":"b","name":"B","closed":"2020-01-01"}]')
    ref = reference.read(spark, str(tmp_path), "channels")
    assert {(r["name_key"], r["ref_id"]) for r in lookup.reference_index(ref).collect()} == {("a", "a"), ("b", "a")}
    snaps = spark.createDataFrame([("one", "2024-01-01 00:00:00", True), ("two", "2024-01-03 00:00:00", False)], "path string, fetched_at string, readable boolean").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    assert tuple(reference.choose_snapshot(snaps, F.lit("2024-01-03").cast("timestamp")).first()) == ("one", True)
    body = '{"events":[{"id":"1","name":"n","date":"2024-01-15T01:00Z","competitions":[{"status":{"type":{"state":"in"}},"competitors":[{"homeAway":"home","team":{"displayName":"H"}},{"homeAway":"away","team":{"displayName":"W"}}]}]}]}'
    r = reference.scoreboard(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert [(x["event_id"], x["state"], x["home"], x["away"]) for x in r] == [("1", "in", "H", "W")]
