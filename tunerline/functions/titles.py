"""Event titles, call signs and station patterns as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunerline.functions.text import EDGE, END, START, WS, let, trim_ws

# Fixed values.
EVENT_LEAGUES = ["PPV", "UFC", "WWE", "BOXING", "ESPN+", "NFL", "MLB", "NBA", "NHL", "NCAAF", "NCAAB", "MMA"]
EVENT_GROUPS = ["ppv", "pay per view", "pay-per-view", "events"]
ZONES = "ET|EST|EDT|CT|CST|CDT|MT|MST|MDT|PT|PST|PDT|UTC|GMT"
NETWORKS = "ABC|CBS|NBC|FOX|CW|PBS|MyNetworkTV"

# The patterns that titles are told by. A clock time begins with a digit after no word character.
_PREFIX = rf"^{WS}*([A-Za-z][A-Za-z0-9+]{{1,10}}){WS}*([0-9]{{1,3}})?{WS}*[:|-]{WS}*"
_TIME = rf"(?i)(?=[0-9]){START}[0-9]{{1,2}}(?::[0-9]{{2}}{WS}*(?:AM|PM)?|{WS}*(?:AM|PM)){WS}*(?:{ZONES})?{EDGE}"
_CLOCK = rf"(?i)^([0-9]{{1,2}})(?::([0-9]{{2}}))?{WS}*(AM|PM)?{WS}*({ZONES})?\z"
_SIDE = rf"[A-Za-z0-9.&']+(?:{WS}+[A-Za-z0-9.&']+){{0,4}}"
_MATCHUP = rf"(?i)({_SIDE}?){WS}+(?:vs\.?|v\.?|@|at){WS}+({_SIDE})"
_VERSUS = rf"(?i){WS}(?:vs\.?|v\.?|@|at){WS}"
_CALLSIGN = rf"{START}([KW][A-Z]{{2,3}}){END}"
_CITY = rf"{START}({NETWORKS}){WS}*[0-9]{{0,2}}{WS}+([A-Z][A-Za-z.]*(?:{WS}+[A-Z][A-Za-z.]*){{0,2}})"


def _got(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def _timed(text: Column) -> Column:
    """struct(text, around): the text, and what stands before and after its first clock time (one part without any). The only search for a time."""
    return F.struct(text.alias("text"), F.split(text, _TIME, 2).alias("around"))


def _clock(t: Column) -> Column:
    """The time of a _timed text: its groups come from the few characters of the match."""
    before, after = F.get(t["around"], F.lit(0)), F.get(t["around"], F.lit(1))
    match = F.substr(t["text"], F.length(before) + 1, F.length(t["text"]) - F.length(before) - F.length(after))

    def groups(m: Column) -> Column:
        g = lambda i: _got(F.regexp_extract(m, _CLOCK, i))
        return F.struct(g(1).cast("int").alias("hour"), F.coalesce(g(2).cast("int"), F.lit(0)).alias("minute"), F.upper(g(3)).alias("meridiem"), F.upper(g(4)).alias("timezone"))

    return F.when(F.size(t["around"]) == 2, let(match, groups))


def event_time(text: Column) -> Column:
    """struct(hour, minute, meridiem, timezone) of the first clock time, null without one."""
    return let(_timed(text), _clock)


def _body(t: Column) -> Column:
    return F.when(F.size(t["around"]) == 2, trim_ws(F.array_join(t["around"], ""))).otherwise(t["text"])


def without_time(text: Column) -> Column:
    return let(_timed(text), _body)


def _matched(raw: Column, use) -> Column:
    """use(struct(p: name, league, number, rest; timed; text: rest without a time; pair: the first matchup in it; event: whether it is one))."""

    def parts(name: Column) -> Column:
        head = F.regexp_extract(name, _PREFIX, 0)
        return F.struct(name.alias("name"), _got(F.regexp_extract(name, _PREFIX, 1)).alias("league"), _got(F.regexp_extract(name, _PREFIX, 2)).alias("number"), F.substr(name, F.length(head) + 1).alias("rest"))

    def timed(p: Column) -> Column:
        return F.struct(p.alias("p"), _timed(p["rest"]).alias("timed"))

    def sides(s: Column) -> Column:
        return F.struct(s["p"].alias("p"), s["timed"].alias("timed"), _body(s["timed"]).alias("text"))

    def pair(s: Column) -> Column:
        # a text without a separator can't match; asking for that first spares the search from every place
        found = F.when(s["text"].rlike(_VERSUS), _got(F.regexp_extract(s["text"], _MATCHUP, 0)))
        return F.struct(s["p"].alias("p"), s["timed"].alias("timed"), s["text"].alias("text"), found.alias("pair"))

    def event(s: Column) -> Column:
        known = F.coalesce(F.upper(s["p"]["league"]).isin(EVENT_LEAGUES), F.lit(False))
        ppv = F.contains(F.lower(s["p"]["name"]), F.lit("ppv")) & s["p"]["name"].rlike(rf"(?i){START}ppv{END}")
        return F.struct(*[s[c].alias(c) for c in ("p", "timed", "text", "pair")], (s["pair"].isNotNull() | known | ppv).alias("event"))

    return let(let(let(let(let(let(trim_ws(raw), parts), timed), sides), pair), event), use)


def parse_event(raw: Column) -> Column:
    """struct(league_prefix, channel_number, team_a, team_b, time, event_name), null for names that are no event."""

    def made(s: Column) -> Column:
        a, b = (trim_ws(_got(F.regexp_extract(s["pair"], _MATCHUP, i))) for i in (1, 2))
        return F.when(s["event"], F.struct(s["p"]["league"].alias("league_prefix"), s["p"]["number"].alias("channel_number"), a.alias("team_a"), b.alias("team_b"), _clock(s["timed"]).alias("time"), F.when(s["pair"].isNull(), _got(s["text"])).alias("event_name")))

    return _matched(raw, made)


def is_event_name(raw: Column) -> Column:
    """Whether parse_event finds an event."""
    return F.coalesce(_matched(raw, lambda s: s["event"]), F.lit(False))


def is_event(name: Column, group: Column) -> Column:
    """Whether a channel is a one-off event, by its name or else by its group."""
    lower = F.lower(F.coalesce(group, F.lit("")))
    by_group = F.lit(False)
    for word in EVENT_GROUPS:
        by_group = by_group | F.contains(lower, F.lit(word))
    return is_event_name(name) | by_group


def callsigns(name: Column) -> Column:
    """Distinct call-sign candidates in their order, case-sensitive."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(_CALLSIGN), F.lit(1)))


def network_city(name: Column) -> Column:
    """struct(network, city) of a network name followed by a city, else null."""
    return F.when(name.rlike(_CITY), F.struct(F.upper(F.regexp_extract(name, _CITY, 1)).alias("network"), trim_ws(F.regexp_extract(name, _CITY, 2)).alias("city")))
