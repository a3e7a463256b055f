"""URLs, credentials and small scalar conversions as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys and path kinds that carry credentials.
CREDENTIAL_KEYS = ["username", "password", "user", "pass"]
CREDENTIAL_PATHS = ["live", "movie", "series", "timeshift"]


def extension(url: Column) -> Column:
    """Lower-case extension before any ?, else ts."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.substring_index(url, "?", 1), r"\.([a-zA-Z0-9]+)\z", 1)), F.lit("")), F.lit("ts"))


def stream_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def stream_template(stream_id: Column, ext: Column) -> Column:
    """Playback URL with its credentials left as placeholders."""
    return F.concat(F.lit("{server}/live/{username}/{password}/"), stream_id.cast("string"), F.lit("."), ext)


def redact_path(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?i)/({'|'.join(CREDENTIAL_PATHS)})/[^/\s?#]+/[^/\s?#]+/", "/$1/**/**/")


def redact_query(s: Column) -> Column:
    for key in CREDENTIAL_KEYS:
        s = F.regexp_replace(s, rf"(?i)([?&]{key}=)[^&\s]+", "$1**")
    return s


def redact(s: Column) -> Column:
    return redact_query(redact_path(s))


def mask(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) != "", "**").otherwise("")


def api_url(server: Column, username: Column, password: Column, **params: Column) -> Column:
    """Panel API address: credentials first, then the parameters in their order, form-encoded."""
    parts = [F.regexp_replace(server, "/+$", ""), F.lit("/player_api.php?username="), F.url_encode(username), F.lit("&password="), F.url_encode(password)]
    for k, v in params.items():
        parts += [F.lit(f"&{k}="), F.url_encode(v)]
    return F.concat(*parts)


def merge_headers(defaults: Column, configured: Column) -> Column:
    """Map of both; configured entries win."""
    keep = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(configured, k))
    return F.map_concat(keep, configured)


def to_number(s: Column) -> Column:
    """Lenient number: blank text is 0, text that is no number is null."""
    return F.when(F.btrim(s) == "", F.lit(0.0)).otherwise(s.try_cast("double"))


def decode_base64(s: Column) -> Column:
    """Text of base64, or the input itself where it isn't base64 or not UTF-8."""
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(s, F.lit("base64")).cast("string")), s)


def backoff(attempt: Column, cap_ms: int = 30_000) -> Column:
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt), F.lit(float(cap_ms)))


def output_extension(configured: Column, allowed: Column) -> Column:
    return F.coalesce(F.nullif(configured, F.lit("")), F.get(allowed, F.lit(0)), F.lit("ts"))


def fresh(fetched_at: Column, now: Column, ttl_seconds: int = 86_400) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(fetched_at) < ttl_seconds


def xmltv_time(s: Column) -> Column:
    """Timestamp of yyyyMMddHHmmss with an optional offset (UTC without one); null for anything else."""
    t = F.regexp_replace(s, r"\s+", "")
    plain = F.try_to_timestamp(F.concat(F.regexp_extract(t, r"^(\d{14})(?:[+-]\d{4})?\z", 1), F.lit("+0000")), F.lit("yyyyMMddHHmmssZ"))
    off = F.regexp_extract(t, r"^\d{14}([+-]\d{4})\z", 1)
    minutes = F.when(off == "", F.lit(0)).otherwise(F.when(F.substring(off, 1, 1) == "-", -1).otherwise(1) * (F.substring(off, 2, 2).try_cast("int") * 60 + F.substring(off, 4, 2).try_cast("int")))
    return F.timestamp_seconds(F.unix_seconds(plain) - F.coalesce(minutes, F.lit(0)) * 60)
