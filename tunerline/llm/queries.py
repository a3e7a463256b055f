"""Queries over the operators of this subpackage, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.llm import bpe, collocations, decontaminate, fingerprints, jaccard_join, langid, line_dedup, quality_model, quality_rules, spelling, suffix_dedup, tokens, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"), tokens.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame([(x,) for x in urls.LISTED], "url string"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontaminate.NEAR).drop("key")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed_lines"), F.col("__n_chunks").alias("n_removed_chunks"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(F.col("quality") == 1))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.judge(table(spark, sf_dir, "documents"))


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 edits, which SQL can express."""
    return op13_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def llm_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op10, which SQL can express; the hashes of its n-grams it can't."""
    return quality_rules.base(quality_rules.split_words(table(spark, sf_dir, "documents"))).drop("words")


def llm_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of what op2 decodes from its ids."""
    return op2_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_byte_bpe, op3_language_id, op4_ngram_jaccard, op5_quality_classifier, op6_url_filters, op7_decontamination, op8_line_dedup, op9_suffix_dedup, op10_quality_rules, op11_spelling_variants, op12_collocations, op13_fingerprints, llm_base_rules, llm_bpe_round_trip, llm_edited_texts)}

SQL = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["llm_bpe_round_trip"] = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

SQL["op4_ngram_jaccard"] = rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard_join.WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {jaccard_join.WORDS} + 2), lambda i: array_to_string(w[i:i + {jaccard_join.WORDS} - 1], ' ')))) END AS s FROM cut),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS class_size
FROM sets JOIN least ON a = doc_id
"""

SQL["op7_decontamination"] = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT item, array_to_string(w[i:i + {decontaminate.WINDOW} - 1], ' ') AS g, least(len(w), {decontaminate.WINDOW}) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {decontaminate.WINDOW} + 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item FROM grams JOIN wins USING (g, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id),
post AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM doc),
freq AS (SELECT term, count(*) AS c FROM post GROUP BY term),
rare AS (
  SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY c, term) AS k
  FROM (SELECT DISTINCT item, unnest(w) AS term FROM item) JOIN freq USING (term)),
place AS (SELECT item, k, doc_id, p FROM rare JOIN post USING (term) WHERE k <= {decontaminate.ANCHORS}),
near AS (
  SELECT DISTINCT a.item, a.doc_id FROM place a JOIN (SELECT item, least(max(k), {decontaminate.ANCHORS}) AS most FROM rare GROUP BY item) m USING (item)
  WHERE a.k = 1 AND (most < 2 OR EXISTS (SELECT 1 FROM place b WHERE b.item = a.item AND b.doc_id = a.doc_id AND b.k = 2 AND abs(b.p - a.p) < {decontaminate.NEAR}))
    AND (most < 3 OR EXISTS (SELECT 1 FROM place b WHERE b.item = a.item AND b.doc_id = a.doc_id AND b.k = 3 AND abs(b.p - a.p) < {decontaminate.NEAR}))),
close AS (SELECT doc_id, count(*) AS n_near_items FROM near GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN close USING (doc_id)
"""

_L = suffix_dedup.LENGTH
SQL["op9_suffix_dedup"] = rf"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
every AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * _L})) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {_L} + 1)) AS i FROM h WHERE length(x) >= {2 * _L})),
twice AS (SELECT g FROM every GROUP BY g HAVING count(*) > 1),
marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM every SEMI JOIN twice USING (g)),
runs AS (SELECT doc_id, i, sum(CASE WHEN step <= {_L} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + {_L} AS hi FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM spans),
kept AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""


def _crc_table() -> list[int]:
    """The remainders of the 256 bytes, as crc32 has them."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in out]
    return out


SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
hex AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM run),
crc AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, list_extract({_crc_table()}::BIGINT[], (xor(c, b) & 255) + 1)))) AS h FROM hex),
word AS (
  SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM crc)
  WHERE length(w) >= {spelling.LEAST_LENGTH} GROUP BY w HAVING sum(n) >= {spelling.LEAST_COUNT}),
place AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM word),
wild AS (SELECT w, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS g FROM place),
gone AS (SELECT DISTINCT w, substr(w, 1, i - 1) || substr(w, i + 1) AS g FROM place),
pair AS (
  SELECT a.w AS a, b.w AS b FROM wild a JOIN wild b ON a.g = b.g AND a.w <> b.w
  UNION SELECT gone.w, word.w FROM gone JOIN word ON word.w = g UNION SELECT word.w, gone.w FROM gone JOIN word ON word.w = g),
near AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM pair JOIN word ON w = b),
form AS (SELECT a, b, near.n AS form_n FROM near JOIN word ON w = a WHERE k = 1 AND near.n >= {spelling.RATIO} * word.n),
way AS (SELECT w, w AS root, 0 AS steps FROM word UNION ALL SELECT way.w, b, steps + 1 FROM way JOIN form ON a = root),
last AS (SELECT w, max_by(root, steps) AS root FROM way GROUP BY w)
SELECT word.w AS word, b AS form, root, word.n, coalesce(n_near, 0) AS n_near, form_n
FROM word JOIN last USING (w) LEFT JOIN form ON form.a = word.w LEFT JOIN (SELECT a, n_near FROM near WHERE k = 1) c ON c.a = word.w
"""

SQL["op12_collocations"] = rf"""
WITH piece AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents)),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, {collocations.WORDS + 1}) t(k) WHERE len(w) >= k)) GROUP BY ALL),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM gram WHERE k > 1 AND f >= {collocations.LEAST}),
scored AS (
  SELECT lang, phrase, a, x.f AS l, y.f AS r, m, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, [lang, array_to_string(w[1:m], ' ')] AS x, [lang, array_to_string(w[m + 1:k], ' ')] AS y FROM (SELECT *, unnest(range(1, k)) AS m FROM cand)) c
  JOIN (SELECT [lang, phrase] AS x, f FROM gram) x USING (x) JOIN (SELECT [lang, phrase] AS y, f FROM gram) y USING (y)),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, m) = 1),
held AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < {collocations.INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN size USING (lang) QUALIFY rank <= {collocations.TOP}
"""

SQL["llm_edited_texts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS follows FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(follows, 1, n // 4)) AS edited_sha256 FROM n
"""

SQL["llm_base_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '{_WORDS}') GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(again.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)
"""

_RULES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1])))
_LISTED = ", ".join(f"('{x}')" for x in urls.LISTED)
SQL["op6_url_filters"] = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM parts),
fit AS (SELECT *, CASE {_RULES} END AS r FROM cut),
listed(entry) AS (VALUES {_LISTED}),
own AS (
  SELECT *, regexp_replace(host, '^www\.', '') || '/' || regexp_replace(regexp_replace(path, '(/index\.html?)?/*$', ''), '^/+', '') AS page FROM fit),
found AS (
  SELECT o.page_id, o.host, o.path, max_by(l.entry, length(l.entry)) AS listed_as
  FROM (SELECT DISTINCT page_id, host, path, page FROM own WHERE r IS NULL AND host <> '') o JOIN listed l
    ON l.entry = o.page OR ends_with('.' || o.host || '/', '.' || l.entry) GROUP BY ALL)
SELECT o.page_id, o.host, o.path, split_part(o.r, '|', 1) AS rule,
  CASE WHEN o.r IS NOT NULL THEN split_part(o.r, '|', 2) WHEN f.listed_as IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, f.listed_as
FROM own o LEFT JOIN found f USING (page_id, host, path)
"""
