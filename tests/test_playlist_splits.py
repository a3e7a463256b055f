"""Playlists that are read in splits give the rows that they give in one piece."""

import random

import pytest

from tunerline.sources import m3u


def _playlist(rng: random.Random, entries: int) -> str:
    out = ["#EXTM3U"]
    for i in range(entries):
        out.append(f'#EXTINF:-1 tvg-id="t{i}" group-title="é{i % 3}",Channel {i}')
        if rng.random() < 0.2:
            out.append(rng.choice(["", "   ", "#EXTVLCOPT:x", "#EXTINF:-1,again", "#" * 90]))
        if rng.random() < 0.9:
            out.append(f"http://h/live/u/p/{i}.ts")
        if rng.random() < 0.1:
            out.append("http://h/without/info.ts")
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n", "\n\n\n"])


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_splits(spark, tmp_path, size):
    rng = random.Random(size)
    for i in range(6):
        (tmp_path / f"list{i}.m3u").write_bytes(_playlist(rng, [0, 1, 2, 5, 20, 40][i]).encode())
    (tmp_path / "empty.m3u").write_bytes(b"")
    want = sorted(map(str, m3u.parse(m3u.read(spark, str(tmp_path))).collect()))
    keys = {"spark.sql.files.maxPartitionBytes": str(max(size, 20)), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = sorted(map(str, m3u.scan(spark, str(tmp_path)).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and len(want) > 50
