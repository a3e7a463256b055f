"""Queries over the scalar kernels: normalisation, URLs, masking, similarity, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunerline.functions import links, similarity, text, titles
from tunerline.plans import frames
from tunerline.plans.catalog import query, table
from tunerline.plans.frames import duck, view

CHAN = f"chan AS ({duck(frames.CHANNELS)})"
#: Accented text: the documents.
ROWS = "rows_ AS (SELECT doc_id, text AS s FROM documents)"

CODES = "|".join(text.COUNTRY_CODES)
PREFIX_RE = rf"^\s*(?:\[(?:{CODES})\]\s*|(?:{CODES})(?:\s*[:|]\s*|\s+-\s+))"
HINTS = "|".join(text.FEED_HINTS)


def duck_prefix(s: str) -> str:
    for _ in range(3):
        s = f"regexp_replace({s}, '{PREFIX_RE}', '', 'i')"
    return s


def duck_tags(s: str) -> str:
    return rf"regexp_replace(regexp_replace({s}, '\bback\s*-?up\s*[0-9]*\b', ' ', 'gi'), '\b(FHD|UHD|SD|HD[0-9]?|4K|8K|RAW|HEVC|H\s*26[45])\b', ' ', 'gi')"


FEED_RE = rf"[(\[]?\s*({HINTS})\s*[)\]]?\s*$"


def duck_ascii(s: str) -> str:
    return rf"regexp_replace(strip_accents(replace({s}, 'ß', 'ss')), '[^\x00-\x7F]', '', 'g')"


def duck_fold(s: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({s}, '[^a-zA-Z0-9\s]', ' ', 'g')), '\s+', ' ', 'g'))"


def duck_normal(s: str) -> str:
    return duck_fold(duck_ascii(f"regexp_replace({duck_tags(duck_prefix(f'trim({s})'))}, '{FEED_RE}', '', 'i')"))


def duck_hint(s: str) -> str:
    return f"nullif(lower(regexp_extract({duck_tags(duck_prefix(f'trim({s})'))}, '{FEED_RE}', 1, 'i')), '')"


def chan(spark, sf_dir):
    return view(spark, sf_dir, frames.CHANNELS)


def prose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"))


@query(f"WITH {CHAN} SELECT stream_key, {duck_prefix('name')} AS stripped FROM chan")
def q_strip_prefix(spark, sf_dir):
    return chan(spark, sf_dir).select("stream_key", text.strip_prefix(F.col("name")).alias("stripped"))


@query(f"WITH {CHAN} SELECT stream_key, {duck_tags('name')} AS stripped FROM chan")
def q_strip_tags(spark, sf_dir):
    return chan(spark, sf_dir).select("stream_key", text.strip_tags(F.col("name")).alias("stripped"))


@query(f"WITH {CHAN} SELECT stream_key, {duck_hint('name')} AS feed_hint FROM chan")
def q_feed_hint(spark, sf_dir):
    return chan(spark, sf_dir).select("stream_key", text.normalize(F.col("name"))["feed_hint"].alias("feed_hint"))


@query(f"WITH {ROWS} SELECT doc_id, {duck_ascii('s')} AS plain FROM rows_")
def q_translit(spark, sf_dir):
    return prose(spark, sf_dir).select("doc_id", text.transliterate(F.col("s")).alias("plain"))


@query(f"WITH {CHAN}, {ROWS} SELECT stream_key AS id, {duck_normal('name')} AS normalized, {duck_hint('name')} AS feed_hint FROM chan UNION ALL SELECT CAST(doc_id AS VARCHAR), {duck_normal('s')}, {duck_hint('s')} FROM rows_")
def q_normalize(spark, sf_dir):
    n = lambda df, key, c: df.select(key.alias("id"), text.normalize(F.col(c)).alias("n")).select("id", "n.*")
    return n(chan(spark, sf_dir), F.col("stream_key"), "name").unionByName(n(prose(spark, sf_dir), F.col("doc_id").cast("string"), "s"))


@query(rf"WITH {CHAN}, u AS (SELECT url FROM chan UNION ALL SELECT url FROM pages) SELECT url, coalesce(nullif(lower(regexp_extract(split_part(url, '?', 1), '\.([a-zA-Z0-9]+)$', 1)), ''), 'ts') AS ext FROM u")
def q_url_ext(spark, sf_dir):
    u = chan(spark, sf_dir).select("url").unionByName(table(spark, sf_dir, "pages").select("url"))
    return u.select("url", links.extension(F.col("url")).alias("ext"))


@query(f"WITH {CHAN} SELECT url, substr(sha1(url), 1, 16) AS key FROM chan")
def q_stream_key(spark, sf_dir):
    return chan(spark, sf_dir).select("url", links.stream_key(F.col("url")).alias("key"))


@query(f"WITH {CHAN} SELECT k, '{{server}}/live/{{username}}/{{password}}/' || k || '.ts' AS template FROM chan")
def q_url_template(spark, sf_dir):
    return chan(spark, sf_dir).select("k", links.stream_template(F.col("k"), F.lit("ts")).alias("template"))


@query("SELECT c_custkey, 'http://panel.example.com/player_api.php?username=' || c_custkey || '&password=' || replace(replace(c_name, '#', '%23'), ' ', '+') || '&action=get_live_streams&category_id=' || c_nationkey AS url FROM customer")
def q_build_url(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", links.api_url(F.lit("http://panel.example.com//"), F.col("c_custkey").cast("string"), F.col("c_name"), action=F.lit("get_live_streams"), category_id=F.col("c_nationkey").cast("string")).alias("url"))


PATH_SQL = r"regexp_replace({}, '/(live|movie|series|timeshift)/[^/\s?#]+/[^/\s?#]+/', '/\1/**/**/', 'gi')"
QUERY_SQL = "{}"
for _key in links.CREDENTIAL_KEYS:
    QUERY_SQL = rf"regexp_replace({QUERY_SQL}, '([?&]{_key}=)[^&\s]+', '\1**', 'gi')"
_URLS = f"{CHAN}, u AS (SELECT url FROM chan UNION ALL SELECT replace(url, 'page=', 'Password=') FROM pages)"


def _urls(spark, sf_dir):
    return chan(spark, sf_dir).select("url").unionByName(table(spark, sf_dir, "pages").select(F.replace("url", F.lit("page="), F.lit("Password=")).alias("url")))


@query(f"WITH {_URLS} SELECT url, {PATH_SQL.format('url')} AS masked FROM u")
def q_redact_path(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", links.redact_path(F.col("url")).alias("masked"))


@query(f"WITH {_URLS} SELECT url, {QUERY_SQL.format('url')} AS masked FROM u")
def q_redact_query(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", links.redact_query(F.col("url")).alias("masked"))


@query(f"WITH {_URLS} SELECT url, {QUERY_SQL.format(PATH_SQL.format('url'))} AS masked FROM u")
def q_redact(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", links.redact(F.col("url")).alias("masked"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '**' END AS username, '**' AS password FROM customer")
def q_mask(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("u"), "c_name")
    return c.select("c_custkey", links.mask(F.col("u")).alias("username"), links.mask(F.col("c_name")).alias("password"))


# --- similarity: pairs of neighbouring distinct names

PAIRS_SPARK = "SELECT a, b FROM (SELECT n AS a, lead(n, {0}) OVER (ORDER BY n) AS b FROM (SELECT DISTINCT {1} AS n FROM {{part}}) d) p WHERE b IS NOT NULL"
_N = "concat(p_name, ' ', p_brand)"
PAIRS = f"{PAIRS_SPARK.format(1, _N)} UNION ALL {PAIRS_SPARK.format(7, _N)} UNION ALL {PAIRS_SPARK.format(3, 'p_name')} UNION ALL {PAIRS_SPARK.format(1, 'p_type')} UNION ALL SELECT n AS a, substr(n, 1, 4) AS b FROM (SELECT DISTINCT p_name AS n FROM {{part}}) d UNION ALL SELECT '' AS a, n AS b FROM (SELECT DISTINCT p_brand AS n FROM {{part}}) d UNION ALL SELECT '' AS a, '' AS b"
PAIR = f"pairs AS ({duck(PAIRS)})"
JARO = "(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE jaro_similarity(a, b) END)"
COMMON = "(CASE WHEN length(a) >= 4 AND length(b) >= 4 AND substr(a,1,4) = substr(b,1,4) THEN 4 WHEN length(a) >= 3 AND length(b) >= 3 AND substr(a,1,3) = substr(b,1,3) THEN 3 WHEN length(a) >= 2 AND length(b) >= 2 AND substr(a,1,2) = substr(b,1,2) THEN 2 WHEN length(a) >= 1 AND length(b) >= 1 AND substr(a,1,1) = substr(b,1,1) THEN 1 ELSE 0 END)"
WINKLER = f"({JARO} + {COMMON} * 0.1 * (1 - {JARO}))"


def duck_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def duck_sets(a: str = "a", b: str = "b") -> str:
    """Columns both, only_a, only_b of two texts, sorted."""
    ta, tb = (rf"list_distinct(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> ''))" for x in (a, b))
    return f"list_sort(list_intersect({ta}, {tb})) AS both_, list_sort(list_filter({ta}, lambda t: NOT list_contains({tb}, t))) AS only_a, list_sort(list_filter({tb}, lambda t: NOT list_contains({ta}, t))) AS only_b"


def duck_token_ratio(source: str, keep: str) -> str:
    """SELECT of keep and tsr from a relation with a and b."""
    x, y, z = "array_to_string(both_, ' ')", "array_to_string(both_ || only_a, ' ')", "array_to_string(both_ || only_b, ' ')"
    return f"SELECT {keep}, greatest({duck_ratio('x', 'y')}, {duck_ratio('x', 'z')}, {duck_ratio('y', 'z')}) AS tsr FROM (SELECT *, {x} AS x, {y} AS y, {z} AS z FROM (SELECT *, {duck_sets()} FROM {source}) q1) q2"


def pairs(spark, sf_dir):
    return view(spark, sf_dir, PAIRS)


def _scored(spark, sf_dir, f):
    return pairs(spark, sf_dir).withColumn("score", F.round(f(F.col("a"), F.col("b")).cast("double"), 6))


@query(f"WITH {PAIR} SELECT a, b, CAST(levenshtein(a, b) AS INT) AS d FROM pairs")
def q_levenshtein(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("d", F.levenshtein("a", "b"))


@query(f"WITH {PAIR} SELECT a, b, round({duck_ratio('a', 'b')}, 6) AS score FROM pairs")
def q_edit_ratio(spark, sf_dir):
    return _scored(spark, sf_dir, similarity.edit_ratio)


@query(f"WITH {PAIR} SELECT a, b, round(CAST({JARO} AS DOUBLE), 6) AS score FROM pairs")
def q_jaro(spark, sf_dir):
    return _scored(spark, sf_dir, similarity.jaro)


@query(f"WITH {PAIR} SELECT a, b, round(CAST({WINKLER} AS DOUBLE), 6) AS score FROM pairs")
def q_jaro_winkler(spark, sf_dir):
    return _scored(spark, sf_dir, similarity.jaro_winkler)


@query(f"WITH {PAIR} SELECT a, b, array_to_string(both_, ' ') AS common_tokens, array_to_string(only_a, ' ') AS only_a, array_to_string(only_b, ' ') AS only_b FROM (SELECT *, {duck_sets()} FROM pairs) q")
def q_token_sets(spark, sf_dir):
    s = similarity.token_sets(F.col("a"), F.col("b"))
    return pairs(spark, sf_dir).select("a", "b", F.array_join(s["both"], " ").alias("common_tokens"), F.array_join(s["only_a"], " ").alias("only_a"), F.array_join(s["only_b"], " ").alias("only_b"))


@query(f"WITH {PAIR} SELECT a, b, round(tsr, 6) AS score FROM ({duck_token_ratio('pairs', 'a, b')}) t")
def q_token_set_ratio(spark, sf_dir):
    return _scored(spark, sf_dir, similarity.token_set_ratio)


COMBINED = f"CASE WHEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b), 1) < 0.6 THEN {WINKLER} ELSE greatest({WINKLER}, tsr) END"


@query(f"WITH {PAIR} SELECT a, b, round(CAST({COMBINED} AS DOUBLE), 6) AS score FROM ({duck_token_ratio('pairs', 'a, b')}) t")
def q_combined_score(spark, sf_dir):
    return _scored(spark, sf_dir, similarity.combined_score)


def duck_family(s: str) -> str:
    tests = [(r"\bespn", "ESPN"), (r"\b(bally sports|fanduel sports network|fsn)\b", "RSN"), (r"\bfox sports\b", "FOX_SPORTS"), (r"\bnbc sports\b", "NBC_SPORTS"), (r"\bcbs sports\b", "CBS_SPORTS"), (r"\bfox\b", "FOX"), (r"\bcbs\b", "CBS"), (r"\bnbc\b", "NBC"), (r"\babc\b", "ABC")]
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '{p}') THEN '{f}'" for p, f in tests) + " END"


@query(f"WITH {CHAN}, n AS (SELECT DISTINCT {duck_normal('name')} AS normalized FROM chan) SELECT normalized, {duck_family('normalized')} AS family FROM n")
def q_network_family(spark, sf_dir):
    n = chan(spark, sf_dir).select(text.normalize(F.col("name"))["normalized"].alias("normalized")).distinct()
    return n.withColumn("family", similarity.network_family(F.col("normalized")))


# --- titles

T_PREFIX = r"^\s*([A-Za-z][A-Za-z0-9+]{1,10})\s*([0-9]{1,3})?\s*[:|-]\s*"
T_TIME = rf"(?:\b([0-9]{{1,2}}):([0-9]{{2}})\s*(AM|PM)?\s*({titles.ZONES})?\b|\b([0-9]{{1,2}})\s*(AM|PM)\s*({titles.ZONES})?\b)"
T_CUT = rf"^(.*?){T_TIME}(.*)$"
_S = r"[A-Za-z0-9.&'']+(?:\s+[A-Za-z0-9.&'']+){0,4}"
T_MATCH = rf"({_S}?)\s+(?:vs\.?|v\.?|@|at)\s+({_S})"
LEAGUES = ", ".join(f"'{x}'" for x in titles.EVENT_LEAGUES)

TITLES = f"""titles AS (SELECT stream_key AS id, name, group_name FROM chan UNION ALL SELECT CAST(doc_id AS VARCHAR), s, 'x' FROM rows_),
t1 AS (SELECT *, trim(name) AS t, regexp_extract(trim(name), '{T_PREFIX}', 0) AS head FROM titles),
t2 AS (SELECT *, nullif(regexp_extract(t, '{T_PREFIX}', 1), '') AS league, nullif(regexp_extract(t, '{T_PREFIX}', 2), '') AS num, substr(t, length(head) + 1) AS rest FROM t1),
t3 AS (SELECT *, regexp_matches(rest, '{T_CUT}', 'is') AS timed FROM t2),
t4 AS (SELECT *, CASE WHEN timed THEN trim(regexp_extract(rest, '{T_CUT}', 1, 'is') || regexp_extract(rest, '{T_CUT}', 9, 'is')) ELSE rest END AS body FROM t3),
t5 AS (SELECT *, nullif(regexp_extract(body, '{T_MATCH}', 1, 'i'), '') AS a, nullif(regexp_extract(body, '{T_MATCH}', 2, 'i'), '') AS b FROM t4),
t6 AS (SELECT *, (a IS NOT NULL OR coalesce(upper(league) IN ({LEAGUES}), false) OR regexp_matches(name, '\\bppv\\b', 'i')) AS event FROM t5)"""


def _titles(spark, sf_dir):
    return chan(spark, sf_dir).select(F.col("stream_key").alias("id"), "name", "group_name").unionByName(prose(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("name"), F.lit("x").alias("group_name")))


def _g(i: int) -> str:
    return f"nullif(regexp_extract(rest, '{T_CUT}', {i}, 'is'), '')"


@query(f"WITH {CHAN}, {ROWS}, {TITLES} SELECT id, league AS league_prefix, num AS channel_number, trim(a) AS team_a, trim(b) AS team_b, CASE WHEN a IS NULL THEN nullif(body, '') END AS event_name FROM t6 WHERE event")
def q_event_parse(spark, sf_dir):
    # a condition on p alone would be computed once more below the projection; a generator keeps it above
    p = _titles(spark, sf_dir).select("id", F.explode_outer(F.array(titles.parse_event(F.col("name")))).alias("p")).where("p is not null")
    return p.select("id", "p.league_prefix", "p.channel_number", "p.team_a", "p.team_b", "p.event_name")


@query(f"WITH {CHAN}, {ROWS}, {TITLES} SELECT id, CAST(coalesce({_g(2)}, {_g(6)}) AS INT) AS hour, coalesce(CAST({_g(3)} AS INT), 0) AS minute, upper(coalesce({_g(4)}, {_g(7)})) AS meridiem, upper(coalesce({_g(5)}, {_g(8)})) AS timezone FROM t6 WHERE timed")
def q_event_time(spark, sf_dir):
    name = text.trim_ws(F.col("name"))
    t = titles.event_time(F.substr(name, F.length(F.regexp_extract(name, titles._PREFIX, 0)) + 1))
    return _titles(spark, sf_dir).select("id", F.explode_outer(F.array(t)).alias("t")).where("t is not null").select("id", "t.*")


@query(f"WITH {CHAN}, {ROWS}, {TITLES} SELECT id, event OR {' OR '.join(f'''contains(lower(coalesce(group_name, '')), '{g}')''' for g in titles.EVENT_GROUPS)} AS is_event FROM t6")
def q_event_detect(spark, sf_dir):
    return _titles(spark, sf_dir).select("id", titles.is_event(F.col("name"), F.col("group_name")).alias("is_event"))


@query(f"WITH {CHAN} SELECT stream_key, array_to_string(list_distinct(regexp_extract_all(name, '\\b([KW][A-Z]{{2,3}})\\b', 1)), ',') AS candidates FROM chan")
def q_callsign_extract(spark, sf_dir):
    return chan(spark, sf_dir).select("stream_key", F.array_join(titles.callsigns(F.col("name")), ",").alias("candidates"))


CITY_RE = rf"\b({titles.NETWORKS})\s*[0-9]{{0,2}}\s+([A-Z][A-Za-z.]*(?:\s+[A-Z][A-Za-z.]*){{0,2}})"


@query(f"WITH {CHAN} SELECT stream_key, upper(nullif(regexp_extract(name, '{CITY_RE}', 1), '')) AS network, trim(nullif(regexp_extract(name, '{CITY_RE}', 2), '')) AS city FROM chan")
def q_network_city_extract(spark, sf_dir):
    return chan(spark, sf_dir).select("stream_key", titles.network_city(F.col("name")).alias("c")).select("stream_key", "c.network", "c.city")
