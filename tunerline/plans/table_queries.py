"""Queries over dimensions, joins, resolution, filters, aggregates, incremental loading and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunerline.functions import links, text, titles
from tunerline.operators import categories, health, incremental, lookup, metrics, resolve, scratch, tables
from tunerline.plans import frames
from tunerline.plans.catalog import query, table
from tunerline.plans.frames import duck, view
from tunerline.plans.text_queries import CHAN, COMBINED, LEAGUES, T_MATCH, T_PREFIX, T_CUT, chan, duck_family, duck_hint, duck_normal, duck_token_ratio
from tunerline.sources import m3u, panel, remote, xmltv

NOW = "2024-01-15 00:00:00"


def reference(spark, sf_dir):
    r = view(spark, sf_dir, frames.REFERENCE)
    return r.select("id", "name", F.array("alt_name").alias("alt_names"), "closed", "pos")


def aliases(spark, sf_dir):
    return view(spark, sf_dir, frames.ALIASES).select("canonical", F.array("name_a", "name_b").alias("names"), "pos")


def stations(spark):
    return spark.sql(frames.STATION_ROWS)


def cats(spark, sf_dir):
    return view(spark, sf_dir, frames.CATEGORIES)


REF = f"ref AS ({duck(frames.REFERENCE)})"
IDX = f"""{REF}, names AS (SELECT id, pos, 0 AS alt_pos, name AS n FROM ref WHERE NOT closed UNION ALL SELECT id, pos, 1, alt_name FROM ref WHERE NOT closed),
keyed AS (SELECT {duck_normal('n')} AS name_key, id, pos, alt_pos FROM names),
idx AS (SELECT name_key, arg_min(id, pos * 10 + alt_pos) AS ref_id, CAST(arg_min(pos, pos * 10 + alt_pos) AS INT) AS pos, CAST(arg_min(alt_pos, pos * 10 + alt_pos) AS INT) AS alt_pos FROM keyed WHERE name_key <> '' GROUP BY name_key)"""
ALI = f"""ali AS ({duck(frames.ALIASES)}), ali_keyed AS (SELECT {duck_normal('name_a')} AS name_key, canonical, pos * 10 AS o FROM ali UNION ALL SELECT {duck_normal('name_b')}, canonical, pos * 10 + 1 FROM ali),
alidx AS (SELECT name_key, arg_max(canonical, o) AS canonical FROM ali_keyed GROUP BY name_key)"""
STA = f"sta AS ({frames.STATION_ROWS})"
CAT = f"cat AS ({duck(frames.CATEGORIES)})"


# --- dimensions

@query(f"WITH {IDX} SELECT * FROM idx")
def q_ref_index(spark, sf_dir):
    return lookup.reference_index(reference(spark, sf_dir))


@query(f"WITH {ALI} SELECT * FROM alidx")
def q_alias_index(spark, sf_dir):
    return lookup.alias_index(aliases(spark, sf_dir))


@query(f"WITH {CAT}, leagues AS (SELECT category_id, unnest(['a/' || category_id, 'b/' || category_id || '/x']) AS path FROM cat) SELECT category_id, path FROM leagues")
def q_flatten(spark, sf_dir):
    tree = cats(spark, sf_dir).select("category_id", F.array(F.concat(F.lit("a/"), F.col("category_id").cast("string")), F.concat(F.lit("b/"), F.col("category_id").cast("string"), F.lit("/x"))).alias("leagues"))
    return tables.flatten(tree, "leagues", "path")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' END AS code FROM events")
def q_map_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tables.lookup(F.col("event_type"), {"click": "c", "view": "v"}).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'seg-' || c_mktsegment ELSE 'default' END AS agent, 'json' AS accept FROM customer")
def q_map_merge(spark, sf_dir):
    defaults = F.create_map(F.lit("agent"), F.lit("default"), F.lit("accept"), F.lit("json"))
    own = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("agent"), F.concat(F.lit("seg-"), "c_mktsegment"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", links.merge_headers(defaults, own).alias("h")).select("c_custkey", F.col("h")["agent"].alias("agent"), F.col("h")["accept"].alias("accept"))


@query("SELECT page_id, split_part(substr(url, 9), '/', 1) AS head, CASE WHEN strpos(substr(url, 9), '/') > 0 THEN substr(url, 9 + strpos(substr(url, 9), '/')) ELSE '' END AS rest FROM pages")
def q_path_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tables.split_path(F.substr("url", F.lit(9))).alias("p")).select("page_id", "p.*")


# --- joins

KEYS = f"keys AS (SELECT DISTINCT {duck_normal('name')} AS key FROM chan)"


def keys(spark, sf_dir):
    return chan(spark, sf_dir).select(text.normalize(F.col("name"))["normalized"].alias("key")).distinct()


@query(f"WITH {CHAN}, {REF} SELECT c.stream_key, r.id AS canonical_id FROM chan c LEFT JOIN (SELECT id FROM ref WHERE NOT closed) r ON c.tvg_id = r.id")
def q_join_tvg_id(spark, sf_dir):
    open_ = reference(spark, sf_dir).where(~F.col("closed")).select(F.col("id").alias("canonical_id"))
    return chan(spark, sf_dir).join(open_, F.col("tvg_id") == F.col("canonical_id"), "left").select("stream_key", "canonical_id")


@query(f"WITH {CHAN}, {KEYS}, {IDX} SELECT k.key, i.ref_id FROM keys k LEFT JOIN idx i ON k.key = i.name_key")
def q_join_ref_name(spark, sf_dir):
    idx = lookup.reference_index(reference(spark, sf_dir)).select(F.col("name_key").alias("key"), "ref_id")
    return keys(spark, sf_dir).join(idx, "key", "left")


@query(f"WITH {CHAN}, {KEYS}, {ALI} SELECT k.key, i.canonical FROM keys k LEFT JOIN alidx i ON k.key = i.name_key")
def q_join_alias(spark, sf_dir):
    idx = lookup.alias_index(aliases(spark, sf_dir)).select(F.col("name_key").alias("key"), "canonical")
    return keys(spark, sf_dir).join(idx, "key", "left")


SIGNS = rf"""cand AS (SELECT stream_key, unnest(list_distinct(regexp_extract_all(name, '\b([KW][A-Z]{{2,3}})\b', 1))) AS callsign, generate_subscripts(list_distinct(regexp_extract_all(name, '\b([KW][A-Z]{{2,3}})\b', 1)), 1) AS place_ FROM chan),
signs AS (SELECT stream_key, arg_min(c.callsign, place_) AS callsign FROM cand c JOIN sta USING (callsign) GROUP BY stream_key)"""


@query(f"WITH {CHAN}, {STA}, {SIGNS} SELECT * FROM signs")
def q_join_callsign(spark, sf_dir):
    c = chan(spark, sf_dir).select(F.col("stream_key").alias("key"), "name")
    return lookup.by_callsign(c, titles.callsigns(F.col("name")), stations(spark)).withColumnRenamed("key", "stream_key")


_CITY = rf"\b({titles.NETWORKS})\s*[0-9]{{0,2}}\s+([A-Z][A-Za-z.]*(?:\s+[A-Z][A-Za-z.]*){{0,2}})"
CITY = f"city AS (SELECT stream_key, upper(regexp_extract(name, '{_CITY}', 1)) AS network, lower(trim(regexp_extract(name, '{_CITY}', 2))) AS city FROM chan)"


@query(f"WITH {CHAN}, {STA}, {CITY} SELECT c.stream_key, s.callsign FROM city c JOIN sta s ON c.network = s.network AND c.city = lower(s.city)")
def q_join_network_city(spark, sf_dir):
    c = titles.network_city(F.col("name"))
    c = chan(spark, sf_dir).select("stream_key", c["network"].alias("network"), F.lower(c["city"]).alias("city"))
    return c.join(stations(spark).select("network", F.lower("city").alias("city"), "callsign"), ["network", "city"]).select("stream_key", "callsign")


STREAMS = "SELECT k, 1 + k % 80 AS category_id FROM (SELECT p_partkey AS k FROM {part}) s"
SPORTS_SQL = " OR ".join(f"contains(key, '{w}')" for w in categories.SPORTS)
MAYBE_SQL = " OR ".join(f"contains(key, '{w}')" for w in categories.MAYBE)
CLS = f"{CAT}, cls AS (SELECT category_id, category_name, CASE WHEN {SPORTS_SQL} THEN 'sports' WHEN {MAYBE_SQL} THEN 'maybe-sports' ELSE 'not-sports' END AS classification FROM (SELECT *, lower(trim(category_name)) AS key FROM cat) q)"


@query(f"WITH {CAT}, s AS ({duck(STREAMS)}) SELECT s.k, coalesce(c.category_name, CAST(s.category_id AS VARCHAR)) AS group_name FROM s LEFT JOIN cat c ON c.category_id = s.category_id")
def q_category_name_join(spark, sf_dir):
    return view(spark, sf_dir, STREAMS).join(cats(spark, sf_dir), "category_id", "left").select("k", F.coalesce("category_name", F.col("category_id").cast("string")).alias("group_name"))


@query(f"WITH {CLS}, s AS ({duck(STREAMS)}) SELECT s.k, c.category_name AS group_name FROM s JOIN cls c ON c.category_id = s.category_id WHERE classification <> 'not-sports'")
def q_category_semi(spark, sf_dir):
    return categories.included_streams(view(spark, sf_dir, STREAMS), cats(spark, sf_dir)).select("k", "group_name")


@query(f"WITH {CHAN}, {KEYS} SELECT key FROM keys WHERE length(key) % 3 <> 0")
def q_memo_anti(spark, sf_dir):
    k = keys(spark, sf_dir)
    return k.join(k.where(F.length("key") % 3 == 0), "key", "left_anti")


@query("SELECT 'p/' || n_nationkey AS espn_path, n_name AS display_name, (n_nationkey % 4 = 0 OR n_nationkey % 5 = 0) AS disabled, CASE WHEN n_nationkey % 4 = 0 THEN 'unexpected status 404' WHEN n_nationkey % 5 = 0 THEN 'old' END AS disabled_reason FROM nation")
def q_disable_failed(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("p/"), F.col("n_nationkey").cast("string")).alias("espn_path"), F.col("n_name").alias("display_name"), (F.col("n_nationkey") % 5 == 0).alias("disabled"), F.when(F.col("n_nationkey") % 5 == 0, "old").alias("disabled_reason"), "n_nationkey")
    audit = n.select("espn_path", (F.col("n_nationkey") % 4 != 0).alias("ok"), F.when(F.col("n_nationkey") % 4 == 0, "unexpected status 404").alias("error"))
    return metrics.disable_failed(n.drop("n_nationkey"), audit)


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '_' || lower(n_name) || '.sql' AS file, row_number() OVER (ORDER BY n_nationkey) AS step FROM nation WHERE n_nationkey > 17")
def q_pending_migrations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    files = n.select("n_nationkey", F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("_"), F.lower("n_name"), F.lit(".sql")).alias("file"))
    return tables.pending(files, files.where("n_nationkey <= 17"))


# --- resolution

FUZZY_IDX = f"fcand AS (SELECT name_key, ref_id, pos, alt_pos, {duck_family('name_key')} AS family FROM idx)"


def _fuzzy_sql(keys_: str) -> str:
    """fuz(key, canonical_id, score): unpruned, so equal results show that pruning loses nothing."""
    pairs = f"(SELECT k.key AS a, c.name_key AS b, c.ref_id, c.pos * 10 + c.alt_pos AS o FROM (SELECT key, {duck_family('key')} AS family FROM {keys_}) k JOIN fcand c ON k.family IS NULL OR k.family = c.family)"
    return f"fpairs AS (SELECT a, ref_id, o, CAST({COMBINED} AS DOUBLE) AS score FROM ({duck_token_ratio(pairs, 'a, b, ref_id, o')}) t), fuz AS (SELECT a AS key, arg_max(ref_id, (score, -o)) AS canonical_id, max(score) AS score FROM fpairs GROUP BY a HAVING max(score) >= 0.85)"


@query(f"WITH {CHAN}, {KEYS}, {IDX}, {FUZZY_IDX}, {_fuzzy_sql('keys')} SELECT key, canonical_id, round(score, 6) AS score FROM fuz")
def q_fuzzy_best(spark, sf_dir):
    idx = lookup.reference_index(reference(spark, sf_dir))
    return resolve.best_fuzzy(keys(spark, sf_dir), idx).withColumn("score", F.round("score", 6))


def _event(rows: str) -> str:
    """prep: rows of chan with normalized_key, feed_hint, is_event."""
    t = f"""t2 AS (SELECT *, nullif(regexp_extract(trim(name), '{T_PREFIX}', 1), '') AS league, substr(trim(name), length(regexp_extract(trim(name), '{T_PREFIX}', 0)) + 1) AS rest FROM {rows}),
t3 AS (SELECT *, CASE WHEN regexp_matches(rest, '{T_CUT}', 'is') THEN trim(regexp_extract(rest, '{T_CUT}', 1, 'is') || regexp_extract(rest, '{T_CUT}', 9, 'is')) ELSE rest END AS body FROM t2)"""
    groups = " OR ".join(f"contains(lower(coalesce(group_name, '')), '{g}')" for g in titles.EVENT_GROUPS)
    return rf"{t}, prep AS (SELECT source_id, stream_key, k, name, tvg_id, {duck_normal('name')} AS normalized_key, {duck_hint('name')} AS feed_hint, (regexp_extract(body, '{T_MATCH}', 1, 'i') <> '' OR coalesce(upper(league) IN ({LEAGUES}), false) OR regexp_matches(name, '\bppv\b', 'i') OR {groups}) AS is_event FROM t3)"


FIRST = "first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY normalized_key ORDER BY source_id, stream_key) AS r FROM prep WHERE NOT is_event) q WHERE r = 1)"


@query(f"WITH {CHAN}, {_event('chan')}, {FIRST} SELECT normalized_key, source_id, stream_key FROM first_")
def q_first_per_key(spark, sf_dir):
    return resolve.first_per_key(resolve.prepare(chan(spark, sf_dir))).select("normalized_key", "source_id", "stream_key")


DECIDED = f"""{_event('chan')}, {FIRST}, {IDX}, {ALI}, {STA}, {SIGNS}, {CITY}, {FUZZY_IDX},
place AS (SELECT c.stream_key, s.callsign FROM city c JOIN sta s ON c.network = s.network AND c.city = lower(s.city)),
pre AS (SELECT f.normalized_key AS key, f.name, r.id AS by_id, i.ref_id, a.canonical, g.callsign AS sign, p.callsign AS place FROM first_ f LEFT JOIN (SELECT id FROM ref WHERE NOT closed) r ON r.id = f.tvg_id
  LEFT JOIN idx i ON i.name_key = f.normalized_key LEFT JOIN alidx a ON a.name_key = f.normalized_key LEFT JOIN signs g ON g.stream_key = f.stream_key LEFT JOIN place p ON p.stream_key = f.stream_key),
todo AS (SELECT key FROM pre WHERE coalesce(by_id, ref_id, canonical, sign, place) IS NULL), {_fuzzy_sql('todo')},
memo AS (SELECT pre.key AS normalized_key, coalesce(by_id, ref_id, canonical, 'station:' || sign, 'station:' || place, fuz.canonical_id) AS canonical_id,
  CASE WHEN by_id IS NOT NULL THEN 'tvg_id' WHEN coalesce(ref_id, canonical) IS NOT NULL THEN 'alias' WHEN sign IS NOT NULL THEN 'callsign' WHEN place IS NOT NULL THEN 'network_city' WHEN fuz.key IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS method,
  CASE WHEN by_id IS NOT NULL THEN 0.99 WHEN coalesce(ref_id, canonical) IS NOT NULL THEN 0.95 WHEN sign IS NOT NULL THEN 0.9 WHEN place IS NOT NULL THEN 0.75 ELSE coalesce(fuz.score, 0) END AS confidence FROM pre LEFT JOIN fuz ON fuz.key = pre.key),
res AS (SELECT p.source_id, p.stream_key, p.normalized_key, p.feed_hint, p.is_event, CASE WHEN NOT p.is_event THEN m.canonical_id END AS canonical_id, CASE WHEN p.is_event THEN 'event_channel' ELSE m.method END AS method, CASE WHEN p.is_event THEN 1.0 ELSE m.confidence END AS confidence FROM prep p LEFT JOIN memo m ON m.normalized_key = p.normalized_key)"""
RES = f"{CHAN}, {DECIDED}"


def resolved(spark, sf_dir):
    ref = reference(spark, sf_dir)
    return resolve.resolve(chan(spark, sf_dir), ref.where(~F.col("closed")), lookup.reference_index(ref), lookup.alias_index(aliases(spark, sf_dir)), stations(spark))[0]


@query(f"WITH {RES} SELECT source_id, stream_key, normalized_key, feed_hint, is_event, canonical_id, method, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM res")
def q_cascade(spark, sf_dir):
    return resolved(spark, sf_dir).drop("event").withColumn("confidence", F.round("confidence", 6))


# --- filters and cases

@query(f"WITH {CLS} SELECT category_id, category_name, classification FROM cls")
def q_classify(spark, sf_dir):
    return categories.classified(cats(spark, sf_dir))


@query("SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, '') AS label, (o_orderkey % 4 = 1) AS archived FROM orders")
def q_project_nullif(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("x"), F.when(F.col("o_orderkey") % 4 < 3, F.col("o_orderkey") % 4).alias("flag"))
    return o.select("o_orderkey", F.nullif("x", F.lit("")).alias("label"), F.coalesce(F.col("flag") == 1, F.lit(False)).alias("archived"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'mkv' WHEN c_custkey % 3 = 1 THEN 'm3u8' ELSE 'ts' END AS ext FROM customer")
def q_coalesce_ext(spark, sf_dir):
    k = F.col("c_custkey") % 3
    allowed = F.when(k == 1, F.array(F.lit("m3u8"), F.lit("ts"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", links.output_extension(F.when(k == 0, "mkv"), allowed).alias("ext"))


@query(f"""SELECT user_id, CAST(CASE WHEN bool_or(event_type = 'purchase' AND value > 200) THEN 60 WHEN bool_or(event_type <> 'purchase' AND ts BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 6 HOUR) THEN 600 ELSE 3600 END AS INT) AS seconds FROM events GROUP BY user_id""")
def q_poll_interval(spark, sf_dir):
    state = F.when((F.col("event_type") == "purchase") & (F.col("value") > 200), "in").when(F.col("event_type") != "purchase", "pre").otherwise("post")
    e = table(spark, sf_dir, "events").select("user_id", state.alias("state"), F.col("ts").alias("start"))
    return metrics.poll_seconds(e, F.lit(NOW).cast("timestamp"), ["user_id"])


@query(f"SELECT event_id, (epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) < 86400) AS fresh FROM events")
def q_ttl_freshness(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", links.fresh(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("fresh"))


_NUM = "CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'abc' WHEN c_custkey % 4 = 2 THEN concat(' ', CAST(c_custkey AS VARCHAR(20)), ' ') ELSE concat(CAST(c_custkey AS VARCHAR(20)), '.5') END"


@query(f"SELECT c_custkey, CASE WHEN trim(s) = '' THEN 0.0::DOUBLE ELSE try_cast(trim(s) AS DOUBLE) END AS n FROM (SELECT c_custkey, {_NUM} AS s FROM customer) q")
def q_to_number(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NUM).alias("s")).select("c_custkey", links.to_number(F.col("s")).alias("n"))


@query("SELECT n_nationkey, CAST(least(1000.0 * pow(2, n_nationkey), 30000.0) AS DOUBLE) AS ms FROM nation")
def q_backoff(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", links.backoff(F.col("n_nationkey")).alias("ms"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def q_top_n(spark, sf_dir):
    return tables.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 4, F.desc("o_totalprice"), "o_orderkey")


# --- aggregates

@query(f"WITH {RES} SELECT method, count(*) AS n FROM res GROUP BY method")
def q_method_counts(spark, sf_dir):
    return metrics.method_counts(resolved(spark, sf_dir))


@query(f"WITH {RES} SELECT count(*) AS total, count(*) FILTER (is_event) AS events, count(*) FILTER (method = 'unresolved') AS unresolved FROM res")
def q_stage_summary(spark, sf_dir):
    return metrics.stage_summary(resolved(spark, sf_dir))


@query(f"WITH {CHAN} SELECT source_id, count(*) AS channels, count(tvg_id) AS with_id FROM chan GROUP BY source_id")
def q_counts(spark, sf_dir):
    return chan(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("channels"), F.count("tvg_id").alias("with_id"))


@query(f"WITH {CLS} SELECT count(*) FILTER (classification <> 'not-sports') AS included, count(*) FILTER (classification = 'not-sports') AS excluded FROM cls")
def q_classify_counts(spark, sf_dir):
    c = categories.classified(cats(spark, sf_dir))
    return c.agg(F.count_if(F.col("classification") != "not-sports").alias("included"), F.count_if(F.col("classification") == "not-sports").alias("excluded"))


@query(f"WITH {RES}, e AS (SELECT source_id, stream_key, tvg_id AS want, k % 17 = 0 AS ev FROM chan WHERE tvg_id IS NOT NULL), j AS (SELECT CASE WHEN ev THEN is_event ELSE NOT is_event AND canonical_id IS NOT DISTINCT FROM want END AS ok FROM res JOIN e USING (source_id, stream_key)) SELECT count(*) AS total, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM j")
def q_accuracy(spark, sf_dir):
    e = chan(spark, sf_dir).where("tvg_id is not null").select("source_id", "stream_key", F.col("tvg_id").alias("expected_id"), (F.col("k") % 17 == 0).alias("expect_event"))
    return metrics.accuracy(resolved(spark, sf_dir), e).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) FILTER (n_nationkey % 4 <> 0) AS ok, count(*) FILTER (n_nationkey % 4 = 0) AS failed, CAST(sum(CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey + 1 END) AS BIGINT) AS events FROM nation")
def q_path_audit(spark, sf_dir):
    r = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, 404).otherwise(200).alias("status"), F.when(F.col("n_nationkey") % 3 != 0, F.sequence(F.lit(0), F.col("n_regionkey"))).alias("events"))
    return metrics.path_audit(r)


# --- incremental: two snapshots, the second differs for one source

SNAP2 = "snap2 AS (SELECT source_id, stream_key, CASE WHEN k % 4 = 1 THEN name || '!' ELSE name END AS name FROM chan WHERE k % 4 <> 1 OR k % 8 = 1)"
HASH = """SELECT source_id, count(*) AS n, bit_xor(a) || '-' || sum(a::HUGEINT) || '-' || sum(b::HUGEINT) AS digest FROM (
  SELECT source_id, ('0x' || substr(h, 1, 15))::BIGINT AS a, ('0x' || substr(h, 16, 15))::BIGINT AS b FROM (SELECT source_id, md5(coalesce(stream_key, chr(0)) || chr(31) || coalesce(name, chr(0))) AS h FROM {}) q) r GROUP BY source_id"""


def snapshots(spark, sf_dir):
    c = chan(spark, sf_dir)
    two = c.where("k % 4 <> 1 or k % 8 = 1").withColumn("name", F.when(F.col("k") % 4 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return c.select("source_id", "stream_key", "name"), two.select("source_id", "stream_key", "name")


def _hash(df):
    return incremental.content_hash(df, ["source_id"], ["stream_key", "name"])


@query(f"WITH {CHAN} {HASH.format('chan')}")
def q_content_hash(spark, sf_dir):
    return _hash(snapshots(spark, sf_dir)[0])


@query(f"WITH {CHAN}, {SNAP2}, a AS ({HASH.format('chan')}), b AS ({HASH.format('snap2')}) SELECT b.* FROM b LEFT JOIN a USING (source_id) WHERE a.digest IS DISTINCT FROM b.digest OR a.n IS DISTINCT FROM b.n")
def q_changed_sources(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return incremental.changed(_hash(b), _hash(a), ["source_id"])


@query(f"WITH {CHAN}, {SNAP2} SELECT source_id, stream_key, name FROM chan WHERE source_id <> 'm3u-1' UNION ALL SELECT * FROM snap2 WHERE source_id = 'm3u-1'")
def q_replace_source(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return incremental.replace_source(a, b, incremental.changed(_hash(b), _hash(a), ["source_id"]))


def _attempts(spark):
    """The second source fails, with credentials in its error; the third was read and gave no rows."""
    return spark.createDataFrame([("m3u-0", "m3u", None), ("m3u-1", "m3u", None), ("m3u-2", "m3u", "GET http://h/live/me/secret/9.ts?password=x failed (500)"), ("m3u-3", "m3u", None)], "source_id string, kind string, error string")


@query(f"WITH {CHAN}, {SNAP2} SELECT source_id, stream_key, name FROM chan WHERE source_id IN ('m3u-0', 'm3u-2') UNION ALL SELECT * FROM snap2 WHERE source_id = 'm3u-1'")
def q_quarantine(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    rows = b.where("source_id <> 'm3u-3'").withColumn("name", F.when(F.col("source_id") == "m3u-2", "half a page").otherwise(F.col("name")))
    return incremental.ingest(a, rows, _attempts(spark), _hash(a), ["stream_key", "name"])[0]


#: Customers are sources; the last event of the user with a customer's key is its attempt.
_TRIED = """last AS (SELECT user_id, max_by(event_type, event_id) AS what, max(event_id) AS seq FROM events GROUP BY user_id)"""
_SEEN = f"""{_TRIED}, s AS (
  SELECT concat('src-', CAST(coalesce(c_custkey, user_id) AS VARCHAR(20))) AS source_id, CASE WHEN user_id IS NULL THEN 'm3u' ELSE 'epg' END AS kind, c_name AS label,
    CASE WHEN user_id IS NULL THEN c_acctbal >= 0 ELSE what <> 'error' END AS healthy,
    CASE WHEN user_id IS NULL AND c_acctbal < 0 THEN 'old' WHEN what = 'error' THEN concat('GET http://h/live/**/**/', CAST(seq AS VARCHAR(20)), '.ts?password=** failed (500)') END AS last_error, user_id IS NOT NULL AS tried
  FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) FULL JOIN last ON user_id = c_custkey)"""


def _source_attempts(spark, sf_dir):
    """A source fails if its last event is an error, with credentials in the message."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("what"), F.max("event_id").alias("at"))
    error = F.when(F.col("what") == "error", F.concat(F.lit("GET http://h/live/me/secret/"), F.col("at").cast("string"), F.lit(".ts?password=x failed (500)")))
    return last.select(F.concat(F.lit("src-"), F.col("user_id").cast("string")).alias("source_id"), F.lit("epg").alias("kind"), error.alias("error"))


def _known_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0")
    good = F.col("c_acctbal") >= 0
    return c.select(F.concat(F.lit("src-"), F.col("c_custkey").cast("string")).alias("source_id"), F.lit("m3u").alias("kind"), F.col("c_name").alias("label"), good.alias("healthy"), F.when(~good, "old").alias("last_error"), F.lit(None).cast("timestamp").alias("updated_at"))


def _marked(spark, sf_dir):
    return health.mark(_known_sources(spark, sf_dir), _source_attempts(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"WITH {_SEEN} SELECT * FROM s")
def q_source_health(spark, sf_dir):
    return _marked(spark, sf_dir).withColumn("tried", F.col("updated_at").isNotNull()).drop("updated_at")


@query(f"WITH {_SEEN} SELECT CASE WHEN count(*) FILTER (WHERE NOT healthy) > 0 THEN 'degraded' ELSE 'ok' END AS status, (SELECT max(event_id) FROM events) AS data_version, count(*) AS sources, count(*) FILTER (WHERE NOT healthy) AS unhealthy FROM s")
def q_health_status(spark, sf_dir):
    return health.status(_marked(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("event_id").alias("version")))


_GUIDE = """SELECT concat('epg-', CAST(user_id % 7 AS VARCHAR(10))) AS source_id, concat('ch', CAST(user_id % 50 AS VARCHAR(10))) AS channel_ref, event_id, event_type, ts FROM events"""


@query(f"WITH g AS ({_GUIDE}) SELECT source_id, channel_ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, concat(event_type, ' & ', CAST(event_id AS VARCHAR(20))) AS title FROM g WHERE source_id <> 'epg-3' AND event_id % 11 <> 0")
def q_guide_documents(spark, sf_dir):
    """Guides made of events, a document for 1,000 of them; one source's request failed, and elements are broken here and there."""
    g = table(spark, sf_dir, "events").withColumn("source_id", F.concat(F.lit("epg-"), (F.col("user_id") % 7).cast("string")))
    time = F.date_format("ts", "yyyyMMddHHmmss")
    element = F.concat(
        F.lit('<programme start="'), time, F.lit(' +0000" stop="'), time, F.lit(' +0000" channel="ch'), (F.col("user_id") % 50).cast("string"), F.lit('"><title lang="en">'), F.col("event_type"),
        F.when(F.col("event_id") % 11 == 0, " & <br").otherwise(" &amp; "), F.col("event_id").cast("string"), F.lit("</title></programme>\n"),
    )
    part = F.floor(F.col("event_id") / 1000)
    docs = g.select("source_id", part.alias("part"), element.alias("x")).groupBy("source_id", "part").agg(F.concat(F.lit("<tv>\n"), F.array_join(F.collect_list("x"), ""), F.lit("<programme start=")).alias("body"))
    docs = docs.select("source_id", F.lit("epg").alias("kind"), F.col("body").cast("binary").alias("body"), F.when(F.col("source_id") == "epg-3", "request failed (500)").alias("error"))
    return remote.guides(docs).select("source_id", "channel_ref", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "title")


PROGRAMMES = "SELECT concat('epg-', CAST(user_id % 3 AS VARCHAR(10))) AS source_id, concat('ch', CAST(user_id % 50 AS VARCHAR(10))) AS channel_ref, event_id, event_type AS title FROM events"


def _programmes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("epg-"), (F.col("user_id") % 3).cast("string")).alias("source_id"), F.concat(F.lit("ch"), (F.col("user_id") % 50).cast("string")).alias("channel_ref"), "event_id", F.col("event_type").alias("title"))


@query(f"WITH p AS ({PROGRAMMES}) SELECT source_id, channel_ref, event_id, CASE WHEN source_id = 'epg-1' THEN title || ' (new)' ELSE title END AS title FROM p WHERE source_id <> 'epg-1' OR event_id % 2 = 0")
def q_replace_programmes(spark, sf_dir):
    old = _programmes(spark, sf_dir)
    new = old.where("source_id = 'epg-0' or event_id % 2 = 0").withColumn("title", F.when(F.col("source_id") == "epg-1", F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")))
    columns = ["channel_ref", "event_id", "title"]
    attempts = spark.createDataFrame([("epg-0", "epg", None), ("epg-1", "epg", None), ("epg-2", "epg", "timeout")], "source_id string, kind string, error string")
    return incremental.ingest(old, new, attempts, incremental.content_hash(old, ["source_id"], columns), columns)[0]


@query("WITH o AS (SELECT n_nationkey AS id, 'epg' AS kind, n_name AS label, 'ok' AS health FROM nation WHERE n_nationkey < 15), n AS (SELECT n_nationkey AS id, 'channel' AS kind, lower(n_name) AS label, 'new' AS health FROM nation WHERE n_nationkey >= 10) SELECT coalesce(n.id, o.id) AS id, coalesce(n.kind, o.kind) AS kind, coalesce(n.label, o.label) AS label, coalesce(o.health, n.health) AS health FROM o FULL JOIN n ON o.id = n.id")
def q_upsert_partial(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey < 15").select(F.col("n_nationkey").alias("id"), F.lit("epg").alias("kind"), F.col("n_name").alias("label"), F.lit("ok").alias("health"))
    new = n.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("id"), F.lit("channel").alias("kind"), F.lower("n_name").alias("label"), F.lit("new").alias("health"))
    return incremental.upsert_partial(old, new, ["id"], ["kind", "label"])


@query(f"WITH {CHAN}, {SNAP2} SELECT * FROM snap2 UNION ALL SELECT source_id, stream_key, name FROM chan c WHERE NOT EXISTS (SELECT 1 FROM snap2 s WHERE s.source_id = c.source_id AND s.stream_key = c.stream_key)")
def q_upsert_resolutions(spark, sf_dir):
    a, b = snapshots(spark, sf_dir)
    return incremental.upsert(a, b, ["source_id", "stream_key"])


@query(f"WITH {CHAN}, {KEYS} SELECT key AS normalized_key, CASE WHEN length(key) % 3 = 0 THEN 'old' ELSE 'new' END AS method FROM keys")
def q_memo_merge(spark, sf_dir):
    k = keys(spark, sf_dir).select(F.col("key").alias("normalized_key"))
    return incremental.merge_memo(k.where("length(normalized_key) % 3 = 0").withColumn("method", F.lit("old")), k.withColumn("method", F.lit("new")))


# --- parsing

_LINES = """concat('#EXTINF:-1 tvg-id="', coalesce(tvg_id, ''), '" tvg-name="', {name}, '" group-title="x" group-title="', coalesce(group_name, ''), '",', CASE WHEN k % 29 = 0 THEN '' ELSE {name} END, chr(10), CASE WHEN k % 5 = 0 THEN concat('#EXTVLCOPT:x', chr(10), chr(10)) ELSE '' END, url)"""


def _playlists(spark, sf_dir):
    c = chan(spark, sf_dir).withColumn("line", F.expr(_LINES.format(name="name")))
    return c.groupBy("source_id").agg(F.concat(F.lit("#EXTM3U\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\r\n")).alias("content"))


@query(rf"WITH {CHAN} SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY k) - 1 AS INT) AS pos, stream_key, trim(name) AS name, nullif(tvg_id, '') AS tvg_id, nullif(group_name, '') AS group_name, regexp_replace(url, '/(live|movie|series|timeshift)/[^/\s?#]+/[^/\s?#]+/', '/\1/**/**/', 'gi') AS url, coalesce(nullif(lower(regexp_extract(split_part(url, '?', 1), '\.([a-zA-Z0-9]+)$', 1)), ''), 'ts') AS ext FROM chan")
def q_m3u_parse(spark, sf_dir):
    return m3u.parse(_playlists(spark, sf_dir)).drop("attrs", "logo")


PANEL = """SELECT CONCAT('acc-', CAST(p_partkey % 25 AS VARCHAR(5))) AS source_id, CAST(p_partkey AS VARCHAR(20)) AS stream_key, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN CONCAT('ref-', CAST(p_partkey AS VARCHAR(20))) END AS tvg_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'Kids' WHEN p_partkey % 3 = 0 THEN CONCAT('US Sports ', n_name) ELSE 'PPV' END AS group_name, CASE WHEN p_partkey % 25 % 3 = 0 THEN 'm3u8' ELSE 'ts' END AS ext, p_partkey % 2 = 0 AS tv_archive, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 25 AS INT) END AS hours
FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 25 % 4 <> 0 AND p_partkey % 3 <> 1"""


@query(f"SELECT source_id, stream_key, name, tvg_id, NULL AS logo, group_name, concat('{{server}}/live/{{username}}/{{password}}/', stream_key, '.', ext) AS url_template, ext AS container_ext, tv_archive, hours AS tv_archive_hours FROM ({PANEL}) q")
def q_panel_channels(spark, sf_dir):
    account = lambda key: F.concat(F.lit("acc-"), key.cast("string"))
    n = table(spark, sf_dir, "nation").select(account(F.col("n_nationkey")).alias("source_id"), F.col("n_nationkey").alias("n"), "n_name")
    user = F.struct(F.when(F.col("n") % 4 == 0, "Banned").otherwise("Active").alias("status"), F.when(F.col("n") % 3 == 0, F.array(F.lit("m3u8"), F.lit("ts"))).alias("allowed_output_formats"))
    probes = n.select("source_id", F.lit("").alias("output"), tables.render(user.alias("user_info"), F.struct(F.lit("u").alias("url")).alias("server_info")).alias("body"))
    one = lambda id_, name: F.struct(F.lit(id_).alias("category_id"), name.alias("category_name"))
    cats_ = n.select("source_id", F.to_json(F.array(one("0", F.concat(F.lit("US Sports "), "n_name")), one("1", F.lit("Kids")), one("2", F.lit("PPV")))).alias("body"))
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    category = (k % 3).cast("string")
    stream = F.struct(k.alias("stream_id"), F.col("p_name").alias("name"), F.lit("").alias("stream_icon"), F.when(k % 7 == 0, F.concat(F.lit("ref-"), k.cast("string"))).otherwise("").alias("epg_channel_id"), F.when(k % 5 == 0, "1").otherwise(category).alias("category_id"), F.when(k % 2 == 0, 1).otherwise(0).alias("tv_archive"), F.when(k % 2 == 0, k % 25).alias("tv_archive_duration"))
    # a panel answers in lists; these are pages of them, of bounded length
    pages = p.groupBy(account(k % 25).alias("source_id"), category.alias("category_id"), F.floor(k / 2500).alias("page")).agg(F.to_json(F.collect_list(stream)).alias("body"))
    rows, _, _ = panel.scan(probes, cats_, pages.drop("page"), F.lit(NOW).cast("timestamp"))
    return rows


@query(f"WITH {CHAN} SELECT stream_key, coalesce(tvg_id, '') AS tvg_id, name AS tvg_name, coalesce(group_name, '') AS group_title, CAST(3 AS INT) AS n FROM chan")
def q_m3u_attrs(spark, sf_dir):
    c = chan(spark, sf_dir).select("stream_key", m3u.attributes(F.expr(_LINES.format(name="name"))).alias("m"))
    return c.select("stream_key", F.col("m")["tvg-id"].alias("tvg_id"), F.col("m")["tvg-name"].alias("tvg_name"), F.col("m")["group-title"].alias("group_title"), F.size("m").alias("n"))


_XML = """concat('<programme start="', date_format(ts, 'yyyyMMddHHmmss'), CASE WHEN event_id % 3 = 0 THEN ' +0000' WHEN event_id % 3 = 1 THEN ' -0500' ELSE '' END, '" stop="', date_format(ts, 'yyyyMMddHHmmss'), ' +0130" channel="ch', CAST(user_id % 50 AS STRING), '">',
 CASE WHEN event_id % 7 = 0 THEN '<title></title>' ELSE concat('<title>old</title><title>', event_type, ' &amp; ', CAST(event_id AS STRING), '</title>') END, CASE WHEN event_id % 2 = 0 THEN '<sub-title>s</sub-title><category></category><category>c1</category><category>c2</category>' ELSE '' END, CASE WHEN value > 50 THEN '<previously-shown/>' ELSE '' END, '</programme>')"""


def _rooted(frames_):
    """Each part file is a document of its own."""
    import pandas as pd

    yield pd.DataFrame({"value": ["<tv>"]})
    yield from frames_
    yield pd.DataFrame({"value": ["</tv>"]})


@query("""SELECT 'ch' || (user_id % 50) AS channel_ref, date_trunc('second', ts) + CASE WHEN event_id % 3 = 1 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS start, date_trunc('second', ts) - INTERVAL 90 MINUTE AS stop, event_type || ' & ' || event_id AS title,
 CASE WHEN event_id % 2 = 0 THEN 's' END AS sub_title, CASE WHEN event_id % 2 = 0 THEN 'c1' END AS category, value > 50 AS previously_shown FROM events WHERE event_id % 7 <> 0""")
def q_xmltv_parse(spark, sf_dir):
    path = scratch.place(spark, "guide")
    table(spark, sf_dir, "events").select(F.expr(_XML).alias("value")).mapInPandas(_rooted, "value string").write.text(path)
    return xmltv.read(spark, path).select("channel_ref", "start", "stop", "title", "sub_title", "category", "previously_shown")


_DATES = "CASE WHEN event_id % 5 = 0 THEN '2024-01-01' WHEN event_id % 5 = 1 THEN concat({0}, ' +0230') WHEN event_id % 5 = 2 THEN concat({0}, '-0500') WHEN event_id % 5 = 3 THEN {0} ELSE concat(substr({0}, 1, 4), '1399', substr({0}, 9)) END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 1 THEN t - INTERVAL 150 MINUTE WHEN 2 THEN t + INTERVAL 5 HOUR WHEN 3 THEN t END AS start FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events) q")
def q_xmltv_date(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_DATES.format("date_format(ts, 'yyyyMMddHHmmss')")).alias("s"))
    return e.select("event_id", links.xmltv_time(F.col("s")).alias("start"))


@query("SELECT c_custkey, 'm3u-0' AS source_id, 'http://a/' || c_custkey AS url FROM customer UNION ALL SELECT c_custkey, 'm3u-1', 'http://b' FROM customer WHERE c_custkey % 2 = 0")
def q_csv_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" ,http://a/"), F.col("c_custkey").cast("string"), F.lit(" ,, "), F.when(F.col("c_custkey") % 2 == 0, "http://b").otherwise("")).alias("list"))
    return panel.csv_sources(c, "list", "m3u")


@query("SELECT event_id, event_type AS title, CASE WHEN event_id % 2 = 0 THEN 'not base64!' ELSE 'v ' || user_id END AS description, 's' AS start, 'e' AS \"end\" FROM events WHERE event_id % 3 <> 0")
def q_short_epg_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b64 = lambda c: F.base64(F.encode(c, "UTF-8"))
    one = F.struct(b64(F.col("event_type")).alias("title"), F.when(F.col("event_id") % 2 == 0, "not base64!").otherwise(b64(F.concat(F.lit("v "), F.col("user_id").cast("string")))).alias("description"), F.when(F.col("event_id") % 3 != 0, "s").otherwise("").alias("start"), F.lit("e").alias("end"))
    return panel.short_epg(e.select("event_id", F.to_json(F.struct(F.array(one).alias("epg_listings"))).alias("body")))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def q_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tables.parse(F.col("props"), "k long")["k"].alias("k"))


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"user_id\":' || user_id ELSE '' END || '}' AS body FROM events")
def q_json_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tables.render("event_type", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id")).alias("body"))


@query(f"""SELECT c_custkey, (c_custkey % 5 <> 0 AND c_custkey % 3 = 1) AS healthy, CASE WHEN c_custkey % 5 = 0 THEN 'malformed account-check response (missing user_info/server_info)' WHEN c_custkey % 3 = 1 THEN NULL ELSE 'status=' || CASE WHEN c_custkey % 3 = 0 THEN 'Banned' ELSE 'Active (expired)' END END AS reason, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS max_connections FROM customer""")
def q_account_health(spark, sf_dir):
    k = F.col("c_custkey") % 3
    user = F.struct(F.when(k == 0, "Banned").otherwise("Active").alias("status"), F.when(k == 2, "").when(k == 1, "4102444800").alias("exp_date"), F.col("c_nationkey").cast("string").alias("max_connections"))
    server = F.when(F.col("c_custkey") % 5 != 0, F.struct(F.lit("u").alias("url")))
    body = F.to_json(F.struct(user.alias("user_info"), server.alias("server_info")))
    c = table(spark, sf_dir, "customer").select("c_custkey", panel.account_health(body, F.lit(NOW).cast("timestamp")).alias("h"))
    return c.select("c_custkey", "h.healthy", "h.reason", F.when(F.col("c_custkey") % 5 != 0, F.col("h.max_connections")).alias("max_connections"))
