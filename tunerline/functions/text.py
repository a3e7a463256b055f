"""Name normalisation as Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense (Java's \s lacks NBSP and the Unicode blanks).
WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Codes, tags and words that the results depend on.
COUNTRY_CODES = ["US", "USA", "UK", "GB", "CA", "CANADA", "MX", "AU", "NZ", "DE", "FR", "ES", "IT", "NL", "LATAM", "ARABIC", "AR", "IN", "PK", "BR"]
QUALITY_TAGS = rf"FHD|UHD|SD|HD[0-9]?|4K|8K|RAW|HEVC|H{WS}*26[45]"
FEED_HINTS = ["East", "West", "Pacific", "Mountain", "Central", "Atlantic"]

WORD = "[A-Za-z0-9_]"
#: Word boundaries by ASCII word characters; Java's \b also counts accented letters.
START, END = f"(?<!{WORD})", f"(?!{WORD})"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

_CODES = "|".join(COUNTRY_CODES)
_PREFIX = rf"(?i)^{WS}*(?:\[(?:{_CODES})\]{WS}*|(?:{_CODES})(?:{WS}*[:|]{WS}*|{WS}+-{WS}+))"
_BACKUP = rf"(?i){START}back{WS}*-?up{WS}*[0-9]*{END}"
_QUALITY = rf"(?i){START}(?:{QUALITY_TAGS}){END}"
_FEED = rf"(?i)[(\[]?{WS}*({'|'.join(FEED_HINTS)}){WS}*[)\]]?{WS}*\z"


def _letters() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letter each is built on."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    pairs += list(zip("øØđĐłŁħĦıðÐ", "oOdDlLhHidD", strict=True)) + [(chr(c), "-") for c in range(0x2010, 0x2016)]
    pairs += [(chr(c), " ") for c in (0xA0, 0x3000, *range(0x2000, 0x200B))] + [(chr(c), "'") for c in (0x2018, 0x2019)] + [(chr(c), '"') for c in (0x201C, 0x201D)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _letters()
_DIGRAPHS = [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"), ("…", "...")]


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{WS}+|{WS}+\z", "")


def strip_prefix(s: Column) -> Column:
    """Up to three leading country codes go, in brackets or with a separator behind."""
    for _ in range(3):
        s = F.regexp_replace(s, _PREFIX, "")
    return s


def strip_tags(s: Column) -> Column:
    """Backup markers and quality tags become blanks."""
    return F.regexp_replace(F.regexp_replace(s, _BACKUP, " "), _QUALITY, " ")


def feed_hint(s: Column) -> Column:
    """The feed word that ends a name, in lower case, else null."""
    return F.nullif(F.lower(F.regexp_extract(s, _FEED, 1)), F.lit(""))


def cut_feed_hint(s: Column) -> Column:
    return F.regexp_replace(s, _FEED, "")


def transliterate(s: Column) -> Column:
    """ASCII form: Latin letters lose their accents; what has no ASCII form, such as emoji and raised letters, is dropped."""
    for a, b in _DIGRAPHS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(s, _FROM, _TO), r"[^\x00-\x7F]", "")


def fold(s: Column) -> Column:
    """Punctuation to blanks, lower case, single blanks."""
    return F.lower(F.btrim(F.regexp_replace(s, r"[^a-zA-Z0-9]+", " ")))


def normalize(name: Column) -> Column:
    """struct(normalized, feed_hint) of a raw name."""
    return let(strip_tags(strip_prefix(trim_ws(name))), lambda s: F.struct(fold(transliterate(cut_feed_hint(s))).alias("normalized"), feed_hint(s).alias("feed_hint")))
