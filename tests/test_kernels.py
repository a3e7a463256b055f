import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunerline.functions import links, similarity, text, titles

# Names and their normal forms.
NAMES = [
    ("US: ESPN", "espn", None), ("USA| ESPN2", "espn2", None), ("[US] NBC", "nbc", None), ("UK: Sky Sports Main Event", "sky sports main event", None),
    ("USA | FOX Sports 1", "fox sports 1", None), ("ESPN2 FHD", "espn2", None), ("Fox Sports 4K", "fox sports", None), ("beIN Sports RAW", "bein sports", None),
    ("ESPN HD2", "espn", None), ("NBC Backup 2", "nbc", None), ("CBS BACKUP", "cbs", None), ("📺 ESPN 🔥", "espn", None), ("ESPN--News", "espn news", None),
    ("ESPN_2", "espn 2", None), ("NBC    Sports    Network", "nbc sports network", None), ("Fútbol Canal", "futbol canal", None), ("Canal+ Sport", "canal sport", None),
    ("beIN SPORTS ESPAÑOL", "bein sports espanol", None), ("FOX Sports Detroit (East)", "fox sports detroit", "east"), ("USA Network - West", "usa network", "west"),
    ("TNT East", "tnt", "east"), ("USA| ESPN2 FHD (East) Backup", "espn2", "east"), ("[USA] TNT UHD (West)", "tnt", "west"), ("ESPN+", "espn", None),
    ("Big Ten Network (East) HD", "big ten network", "east"), ("Pac-12 Network HD", "pac 12 network", None), ("US - ESPNU HD", "espnu", None), ("CA: TSN1 HD", "tsn1", None),
    ("Comedy Central HD", "comedy", "central"), ("ᴿᴬᵂ ESPN", "espn", None), ("  Straße\t TV ", "strasse tv", None), ("🔥", "", None),
]


def test_normalize(spark):
    df = spark.createDataFrame([(n,) for n, _, _ in NAMES], "name string").select("name", text.normalize(F.col("name")).alias("n")).select("name", "n.*")
    got = {r["name"]: (r["normalized"], r["feed_hint"]) for r in df.collect()}
    assert got == {n: (a, b) for n, a, b in NAMES}
    again = df.select(text.normalize(F.col("normalized"))["normalized"].alias("x"), "normalized", "feed_hint").where("x <> normalized")
    assert again.isEmpty()


@pytest.mark.parametrize(("a", "b", "score"), [("MARTHA", "MARHTA", 0.944), ("DWAYNE", "DUANE", 0.822), ("DIXON", "DICKSONX", 0.767), ("", "", 1.0), ("", "x", 0.0), ("a", "b", 0.0)])
def test_jaro(a, b, score):
    assert similarity.jaro_of(a, b) == pytest.approx(score, abs=5e-4)


@settings(max_examples=200, deadline=None)
@given(st.text("abcde ", max_size=12), st.text("abcde ", max_size=12))
def test_jaro_is_symmetric_in_range(a, b):
    assert 0 <= similarity.jaro_of(a, b) <= 1
    assert (similarity.jaro_of(a, b) == 1) >= (a == b)


def test_scores(spark):
    df = spark.createDataFrame([("espn deprotes", "espn deportes"), ("espn deprotes", "espn"), ("deportes espn", "espn deportes"), ("MARTHA", "MARHTA"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    r = df.select(similarity.combined_score(a, b).alias("c"), similarity.token_set_ratio(a, b).alias("t"), similarity.jaro_winkler(a, b).alias("w")).collect()
    assert r[0]["c"] > r[1]["c"]
    assert r[2]["t"] == 1
    assert r[3]["w"] == pytest.approx(0.961, abs=5e-4)
    assert r[4]["c"] == 1


# Event names (group) that are events, and ordinary channels.
EVENTS = ["ESPN+ 14: Alabama vs Georgia 7:30PM ET", "NFL 05 | KC @ BUF", "PPV 3 - UFC 320", "UFC 300: Prelims", "Boxing 2: Fury vs Usyk", "NBA 07: Lakers at Celtics 8PM ET", "UFC 320 PPV", "KC @ BUF", "NCAAF 03: Michigan vs Ohio State", "MMA 5: Bellator 300"]
CHANNELS = ["ESPN2 HD", "FOX Sports Detroit (East)", "NBA TV", "NFL RedZone", "NFL Network", "Golf Channel", "UFC Fight Pass", "Comedy Central HD"]


def test_events(spark):
    rows = [(n, "USA| SPORTS", True) for n in EVENTS] + [(n, "USA| SPORTS", False) for n in CHANNELS] + [("PPV 10", "PPV EVENTS", True), ("Plain", None, False)]
    df = spark.createDataFrame(rows, "name string, g string, want boolean")
    assert df.where(titles.is_event(F.col("name"), F.col("g")) != F.col("want")).isEmpty()
    p = spark.createDataFrame([(EVENTS[0],), ("PPV 3 - UFC 320",)], "n string").select(titles.parse_event(F.col("n")).alias("p")).select("p.*").collect()
    assert (p[0]["league_prefix"], p[0]["channel_number"], p[0]["team_a"], p[0]["team_b"]) == ("ESPN+", "14", "Alabama", "Georgia")
    assert (p[0]["time"]["hour"], p[0]["time"]["minute"], p[0]["time"]["meridiem"], p[0]["time"]["timezone"]) == (7, 30, "PM", "ET")
    assert (p[1]["event_name"], p[1]["team_a"]) == ("UFC 320", None)


def test_stations_patterns(spark):
    r = spark.createDataFrame([("WABC New York KABC WABC",), ("FOX 5 New York",), ("Wabc",)], "n string").select(titles.callsigns(F.col("n")).alias("c"), titles.network_city(F.col("n")).alias("p")).collect()
    assert r[0]["c"] == ["WABC", "KABC"]
    assert tuple(r[1]["p"]) == ("FOX", "New York")
    assert r[2]["c"] == [] and r[2]["p"] is None


def test_links(spark):
    df = spark.createDataFrame([("http://h/LIVE/u/p/1.ts?Password=x&user=y",), ("http://h/a.M3U8?x=1",), ("http://h/a",)], "u string")
    r = df.select(links.redact(F.col("u")).alias("m"), links.extension(F.col("u")).alias("e"), links.stream_key(F.col("u")).alias("k")).collect()
    assert r[0]["m"] == "http://h/LIVE/**/**/1.ts?Password=**&user=**"
    assert [x["e"] for x in r] == ["ts", "m3u8", "ts"]
    assert len(r[0]["k"]) == 16
    t = spark.createDataFrame([("20260115230000 -0500",), ("20260115230000",), ("20261399000000 +0000",), ("soon",), (None,)], "s string").select(links.xmltv_time(F.col("s")).cast("string").alias("t")).collect()
    assert [x["t"] for x in t] == ["2026-01-16 04:00:00", "2026-01-15 23:00:00", None, None, None]
    b = spark.createDataFrame([("aGk=",), ("not base64!",), ("gA==",)], "s string").select(links.decode_base64(F.col("s")).alias("d")).collect()
    assert [x["d"] for x in b] == ["hi", "not base64!", "gA=="]
