"""Sources that executors fetch, and guides that come again in a stream."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tunerline.sources import registry, remote, xmltv
from tunerline.streaming import micro

GUIDE = """<?xml version="1.0" encoding="UTF-8"?><tv><channel id="a"/>
<programme start="20260116040000 +0000" stop="20260116050000 +0000" channel="a"><title>First &amp; last</title><category lang="en">Sports</category><previously-shown/></programme>
<programme start="20260115173000 +0000" stop="20260115180000 +0000" channel="b"><title lang="fr">Café</title></programme>
</tv>"""
BROKEN = GUIDE.replace("First &amp; last", "First & <last").replace("</tv>", '<programme start="20260116040000 +0000" channel="c"><title>cut')


def _playlist(i: int) -> str:
    return "#EXTM3U\n" + "".join(f'#EXTINF:-1 tvg-id="t{k}",Channel {k}\nhttp://h/live/u/p/{i}{k}.ts\n' for k in range(3))


def _account(user: str) -> dict:
    return {"user_info": {"auth": 1, "status": "Banned" if user == "u4" else "Active", "exp_date": "4102444800", "allowed_output_formats": ["ts"]}, "server_info": {}}


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            asked.append(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            number = int("".join(filter(str.isdigit, url.path)) or 0)
            status, body = 200, b""
            if url.path.startswith("/list"):
                status, body = (500, b"x") if number % 7 == 3 else (200, _playlist(number).encode())
                if number % 7 == 5:
                    body = gzip.compress(body)[: 20 if number % 2 else None]  # every other one is cut off
            elif url.path.startswith("/guide"):
                body = [GUIDE, BROKEN, "no xml", ""][number % 4].encode() + (b"\xff" if number % 4 == 2 else b"")
            elif url.path == "/player_api.php":
                user, action = q["username"], q.get("action")
                if action is None:
                    body = json.dumps(_account(user)).encode()
                elif action == "get_live_categories":
                    status, body = (503, b"") if user == "u5" else (200, json.dumps([{"category_id": str(c), "category_name": n} for c, n in enumerate(["US Sports", "ESPN", "Cooking"])]).encode())
                else:
                    c = int(q["category_id"])
                    status = 500 if (user, c) == ("u6", 1) else 200
                    body = json.dumps([{"stream_id": 10 * c + k, "name": f"{user} {c}{k}", "category_id": str(c)} for k in range(2)]).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_many_sources_in_one_plan(spark, server):
    url, asked = server
    sources = [(f"m3u-{i}", "m3u", f"{url}/list{i}") for i in range(200)] + [(f"epg-{i}", "epg", f"{url}/guide{i}") for i in range(8)]
    sources += [("gone", "m3u", "http://127.0.0.1:9/x?password=secret"), ("odd", "m3u", "no url")]
    documents = remote.fetch(remote.requests(spark, sources), partitions=8)
    errors = {r["source_id"]: r["error"] for r in remote.attempts(documents).collect()}
    rows = remote.playlists(documents)
    bad = {f"m3u-{i}" for i in range(200) if i % 7 == 3 or i % 14 == 5}
    assert len(errors) == 210 and {k for k, v in errors.items() if v} == bad | {"gone", "odd"}
    assert errors["m3u-3"] == "request failed (500)" and "secret" not in str(errors)
    got = {}
    for r in rows.collect():
        got.setdefault(r["source_id"], []).append(r["name"])
    assert got == {f"m3u-{i}": ["Channel 0", "Channel 1", "Channel 2"] for i in range(200) if f"m3u-{i}" not in bad}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    guides = sorted((r["source_id"], r["channel_ref"], str(r["start"]), r["title"], r["category"], r["previously_shown"]) for r in remote.guides(documents).collect())
    first, second = ("a", "2026-01-16 04:00:00", "First & last", "Sports", True), ("b", "2026-01-15 17:30:00", "Café", None, False)
    assert guides == sorted([(f"epg-{i}", *x) for i in (0, 4) for x in (first, second)] + [(f"epg-{i}", *second) for i in (1, 5)])
    assert len([x for x in asked if x.startswith(("/list", "/guide"))]) == 208  # each once, however often the documents are read
    assert remote.attempts(remote.fetch(remote.requests(spark, []))).collect() == []


def test_large_documents_are_errors(spark, server):
    documents = remote.fetch(remote.requests(spark, [("a", "m3u", f"{server[0]}/list1"), ("b", "m3u", "x")]), most=20)
    assert {r["source_id"]: r["error"] for r in documents.where("source_id = 'a'").collect()} == {"a": "document too large"}


def test_panels(spark, server):
    url, _ = server
    accounts = spark.createDataFrame([(f"acc{i}", url + "//", f"u{i}", "p&q", None) for i in range(9)], "source_id string, server_url string, username string, password string, output string")
    rows, attempts, counts = remote.panels(accounts, F.lit("2024-01-01").cast("timestamp"), partitions=4)
    errors = {r["source_id"]: r["error"] for r in attempts.collect()}
    assert len(errors) == 9 and {k for k, v in errors.items() if v} == {"acc4", "acc5", "acc6"}
    assert errors["acc5"] == "request failed (503)" and errors["acc6"] == "request failed (500)"
    got = sorted((r["source_id"], r["stream_key"], r["name"]) for r in rows.collect())
    good = [i for i in range(9) if i not in (4, 5, 6)]
    included = {r["source_id"]: r["included"] for r in counts.collect()}
    assert set(included) == {f"acc{i}" for i in good} and len(set(included.values())) == 1
    assert got == sorted((f"acc{i}", str(10 * c + k), f"u{i} {c}{k}") for i in good for c in range(included["acc0"]) for k in range(2))
    assert set(spark.createDataFrame([], registry.CHANNELS).columns) >= {c for c in rows.columns}


def _element(channel: str, day: int, title: str) -> str:
    return f'<programme start="202601{day:02d}040000 +0000" stop="202601{day:02d}050000 +0000" channel="{channel}"><title>{title}</title></programme>'


def test_programmes_that_come_again(spark, tmp_path):
    """One row for a programme that comes in several files and runs, after a restart too; what is too old for the state is left out."""
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run(name, *elements):
        (inbox / f"{name}.xml").write_text("<tv>" + "".join(elements) + "</tv>", encoding="utf-8")
        micro.ingest_guides(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"), "3 days").awaitTermination()
        return sorted((r["channel_ref"], r["title"], str(r["start"])[8:10]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    a, b, c = _element("a", 10, "A"), _element("b", 11, "B"), _element("c", 20, "C")
    one = run("1", a, b, a)
    assert one == [("a", "A", "10"), ("b", "B", "11")]
    assert run("2", b, c, _element("a", 10, "other")) == sorted([*one, ("c", "C", "20"), ("a", "other", "10")])
    rows = run("3", c, _element("d", 19, "D"), a.replace("A<", "late<"))  # the latest start is the 20th: the 10th is past
    assert rows == sorted([*one, ("c", "C", "20"), ("a", "other", "10"), ("d", "D", "19")])
    assert run("4", *[c, b, a]) == rows
    assert xmltv.read(spark, str(inbox)).count() > len(rows)
