"""Input frames derived from the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunerline.plans.seeds import STATIONS

_NET = "CASE k % 8 WHEN 0 THEN 'ESPN' WHEN 1 THEN 'FOX Sports' WHEN 2 THEN 'Bally Sports' WHEN 3 THEN 'NBC Sports' WHEN 4 THEN 'CBS Sports' WHEN 5 THEN 'ABC' WHEN 6 THEN 'Golf' ELSE 'Willow' END"
_PREFIX = "CASE k % 5 WHEN 0 THEN 'US: ' WHEN 1 THEN 'USA| ' WHEN 2 THEN '[US] ' WHEN 3 THEN '' ELSE 'UK - ' END"
_SUFFIX = "CASE k % 7 WHEN 0 THEN ' HD' WHEN 1 THEN ' FHD (East)' WHEN 2 THEN ' UHD Backup' WHEN 3 THEN '' WHEN 4 THEN ' 4K' WHEN 5 THEN ' West HD' ELSE ' HD2' END"
_SIGN = "CASE CAST(floor(k / 23) AS INT) % 12 " + " ".join(f"WHEN {i} THEN '{s[0]} {s[2]} HD'" for i, s in enumerate(STATIONS)) + " END"
_PLACE = "CASE CAST(floor(k / 23) AS INT) % 12 " + " ".join(f"WHEN {i} THEN '{s[1]} {i + 2} {s[2]}'" for i, s in enumerate(STATIONS)) + " END"

#: Channels from part, with event titles, station names, swapped letters and ids strewn in. k is the part's key.
CHANNELS = f"""
SELECT concat('m3u-', CAST(k % 4 AS VARCHAR(10))) AS source_id, url, substr(sha1(url), 1, 16) AS stream_key, k,
  CASE WHEN k % 17 = 0 THEN concat('NFL ', CAST(k % 30 AS VARCHAR(10)), ' | ', name_, ' @ Bears 7:30PM ET') WHEN k % 46 = 0 THEN {_SIGN} WHEN k % 23 = 0 THEN {_PLACE}
    ELSE concat({_PREFIX}, {_NET}, ' ', name_, {_SUFFIX}) END AS name,
  CASE WHEN k % 13 = 0 THEN concat('ref-', CAST(k % 512 AS VARCHAR(10))) END AS tvg_id,
  CASE WHEN k % 19 = 0 THEN 'PPV EVENTS' ELSE p_type END AS group_name
FROM (SELECT p_partkey AS k, p_type, concat('http://host', CAST(p_partkey % 3 AS VARCHAR(10)), '.example.com/live/u', CAST(p_partkey % 3 AS VARCHAR(10)), '/p', CAST(p_partkey % 5 AS VARCHAR(10)), '/', CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN '.TS?a=1' ELSE '.m3u8' END) AS url,
    CASE WHEN p_partkey % 11 = 0 THEN concat(substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1), substr(p_name, 5)) ELSE p_name END AS name_
  FROM {{part}}) p"""

#: A reference world: each network with each part name.
REFERENCE = f"""
SELECT concat('ref-', CAST(pos AS VARCHAR(10))) AS id, concat(net, ' ', p_name) AS name, concat(p_name, ' ', net) AS alt_name, length(concat(net, p_name)) % 9 = 0 AS closed, CAST(pos AS INT) AS pos
FROM (SELECT row_number() OVER (ORDER BY p_name, k) - 1 AS pos, p_name, k, {_NET} AS net FROM (SELECT DISTINCT p_name FROM {{part}}) n CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(k)) r"""

#: Older names of one network's channels.
ALIASES = """
SELECT concat('FanDuel SN ', p_name) AS canonical, concat('FSN ', p_name) AS name_a, concat('Fox Sports ', p_name) AS name_b, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INT) AS pos FROM (SELECT DISTINCT p_name FROM {part}) n"""

STATION_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {i})" for i, (a, b, c) in enumerate(STATIONS)) + ") AS v(callsign, network, city, pos)"

#: Categories with and without keywords.
CATEGORIES = """
SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS category_id, name AS category_name FROM (
  SELECT DISTINCT p_type AS name FROM {part} UNION SELECT DISTINCT concat('US Sports ', p_brand) FROM {part} UNION SELECT DISTINCT concat(p_brand, ' PPV') FROM {part}
  UNION SELECT * FROM (VALUES ('Liverpool TV'), ('Transport'), ('24/7 Shows'), ('  Kids  '), ('Game Pass'), ('constructor')) AS v(name)) c"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def duck(sql: str) -> str:
    return sql.format(part="part")
