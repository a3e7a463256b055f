"""Name similarity as Column functions; only the Jaro kernel is Python, over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tunerline.functions.text import END, START, let

# Network families in their order, and the factors of the scores.
FAMILIES = [
    (f"{START}espn", "ESPN"),
    (f"{START}(?:bally sports|fanduel sports network|fsn){END}", "RSN"),
    (f"{START}fox sports{END}", "FOX_SPORTS"),
    (f"{START}nbc sports{END}", "NBC_SPORTS"),
    (f"{START}cbs sports{END}", "CBS_SPORTS"),
    (f"{START}fox{END}", "FOX"),
    (f"{START}cbs{END}", "CBS"),
    (f"{START}nbc{END}", "NBC"),
    (f"{START}abc{END}", "ABC"),
]
PREFIX, WEIGHT, SHORT = 4, 0.1, 0.6


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity: matches within half the longer length, less half the transpositions, rounded down; two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = list(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [b[j] for j, c in enumerate(free) if c is None]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, other, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro(a: Column, b: Column) -> Column:
    return _jaro(a, b)


def common_prefix(a: Column, b: Column) -> Column:
    """Equal leading characters, PREFIX at most."""
    n = F.lit(0)
    for k in range(1, PREFIX + 1):  # an equal beginning has equal shorter ones
        n = n + F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), 1).otherwise(0)
    return n


def winkler(score: Column, a: Column, b: Column) -> Column:
    """The prefix bonus on a Jaro score, whatever the score."""
    return score + common_prefix(a, b) * F.lit(WEIGHT) * (F.lit(1.0) - score)


def jaro_winkler(a: Column, b: Column) -> Column:
    return winkler(jaro(a, b), a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, r"[\t-\r ]+"), lambda t: t != ""))


def token_sets(a: Column, b: Column) -> Column:
    """struct(both, only_a, only_b): sorted common tokens and the rest of each side."""
    return let(F.struct(tokens(a).alias("x"), tokens(b).alias("y")), lambda p: _sets(p["x"], p["y"]))


def _sets(x: Column, y: Column) -> Column:
    return F.struct(F.sort_array(F.array_intersect(x, y)).alias("both"), F.sort_array(F.array_except(x, y)).alias("only_a"), F.sort_array(F.array_except(y, x)).alias("only_b"))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best of three edit ratios between the common tokens, and these with the rest of either side. Each part is made once."""

    def joined(s: Column) -> Column:
        text = lambda *parts: F.array_join(F.concat(*parts), " ")
        return F.struct(text(s["both"]).alias("x"), text(s["both"], s["only_a"]).alias("y"), text(s["both"], s["only_b"]).alias("z"))

    return let(let(token_sets(a, b), joined), lambda t: F.greatest(edit_ratio(t["x"], t["y"]), edit_ratio(t["x"], t["z"]), edit_ratio(t["y"], t["z"])))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def combined_of(jw: Column, a: Column, b: Column) -> Column:
    """Jaro-Winkler alone for very different lengths, else the better of it and the token-set ratio."""
    return F.when(length_ratio(a, b) < SHORT, jw).otherwise(F.greatest(jw, token_set_ratio(a, b)))


def combined_score(a: Column, b: Column) -> Column:
    return combined_of(jaro_winkler(a, b), a, b)


def network_family(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, family in reversed(FAMILIES):
        out = F.when(name.rlike(pattern), family).otherwise(out)
    return out


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(s: Column) -> Column:
    """array of two longs: a bit for the first, second and third time that a letter, digit or blank occurs in s.

    Two texts differ in at least as many letters as their bits do, so lengths and bits bound from above how many letters they share."""

    def places(chars: Column) -> Column:
        at = F.transform(chars, lambda c, i: F.struct(F.position(c, F.lit(_ALPHABET)).alias("c"), (i + 1 - F.array_position(chars, c)).alias("again")))
        return F.transform(F.filter(at, lambda x: (x["c"] > 0) & (x["again"] < 3)), lambda x: (x["c"] - 1 + len(_ALPHABET) * x["again"]).cast("int"))

    def bits(places: Column) -> Column:
        one = lambda lo: F.aggregate(F.filter(places, lambda x: (x >= lo) & (x < lo + 63)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x - lo)))
        return F.array(one(0), one(63))

    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    return let(let(chars, places), bits)


def sides(s: Column) -> Column:
    """What bounded() needs to know of a name: its length and letters, and those of its distinct tokens, sorted and joined."""
    own = F.array_join(F.sort_array(tokens(s)), " ")
    return let(own, lambda t: F.struct(F.length(s).alias("n"), letters(s).alias("bits"), F.length(t).alias("set_n"), letters(t).alias("set_bits")))


def bounded(a: Column, b: Column, x: Column, y: Column, threshold: float) -> Column:
    """False only for pairs a, b (x, y: their sides) whose score can't reach the threshold.

    With m letters in common Jaro is at most (m / |a| + m / |b| + 1) / 3, and the bonus for a common prefix needs the less
    of it. A token-set ratio of t needs t * the shorter token text in common letters: of two texts with edit ratio t all but
    1 - t of the longer one's letters are shared, and the common tokens alone are part of both sides."""
    differ = lambda k: F.bit_count(x[k][0].bitwiseXOR(y[k][0])) + F.bit_count(x[k][1].bitwiseXOR(y[k][1]))
    shared = F.least(F.least(x["n"], y["n"]), (x["n"] + y["n"] - differ("bits")) / 2)
    p = common_prefix(a, b) * F.lit(WEIGHT)
    jaro_most = (shared / F.greatest(x["n"], F.lit(1)) + shared / F.greatest(y["n"], F.lit(1)) + 1) / 3
    by_jaro = (jaro_most >= (threshold - PREFIX * WEIGHT) / (1 - PREFIX * WEIGHT) - 1e-9) & (jaro_most >= (F.lit(threshold) - p) / (F.lit(1.0) - p) - 1e-9)  # numbers first, then the names
    by_set = (x["set_n"] + y["set_n"] - differ("set_bits")) / 2 >= F.lit(threshold) * F.least(x["set_n"], y["set_n"]) - 1e-9
    return (a == b) | by_jaro | ((length_ratio(a, b) >= SHORT) & by_set)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """False only for pairs whose score can't reach the threshold. Jaro is at most (2 + r) / 3 for a length ratio r; the
    bonus needs jaro >= (t - 0.1 p) / (1 - 0.1 p) for a common prefix of p; from r >= SHORT on the token sets may decide."""
    p = common_prefix(a, b) * F.lit(WEIGHT)
    need = (F.lit(threshold) - p) / (F.lit(1.0) - p)
    return (length_ratio(a, b) >= SHORT) | ((length_ratio(a, b) + 2) / 3 >= need - 1e-9)
