"""Quality rules: base measures, and a hashed n-gram log-likelihood ratio of trusted text against the raw corpus. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled

BLANKS = r"[\x20\x09-\x0D]+"
#: Hash buckets of the multinomials: what goes to the driver and back in the plan is at most this many numbers.
BUCKETS = 65_536
#: Weight of the raw corpus in the smoothed target multinomial, in n-grams.
PRIOR = 2_000
#: Log ratios are kept as whole millionths, so that sums don't depend on the order of their terms.
SCALE = 1_000_000
#: A document is rejected if its log-likelihood ratio for each n-gram is below this.
THRESHOLD = -0.1


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(grams: Column) -> Column:
    """Words covered by 3-word windows (hashes by start) that are found twice or more: the windows are sorted with their
    places, equal neighbours mark the places, and the union of [place, place + 3) is added up. O(n log n) for a text."""

    def marked(s: Column) -> Column:
        at = lambda k: F.get(s, k)["g"]
        same = lambda x, k: F.coalesce(at(k + 1) == x["g"], F.lit(False)) | ((k > 0) & F.coalesce(at(k - 1) == x["g"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(let(pairs, marked), covered)).otherwise(F.lit(0)).cast("long")


def split_words(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, text, words; null texts have none. row: with a struct __row of all columns."""
    docs = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text") if row else docs.select("doc_id", "text")
    return docs.withColumn("words", F.coalesce(F.array_remove(F.split("text", BLANKS), ""), F.array().cast("array<string>")))


def ngrams(words: DataFrame) -> DataFrame:
    """Adds grams: the buckets of each word, and of each two neighbouring words."""
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    pair = F.transform("hashes", lambda h, i: F.pmod(F.xxhash64(h, F.get("hashes", i + 1)), F.lit(BUCKETS)).cast("int"))
    one = F.transform("hashes", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return hashed.withColumn("grams", F.when(F.size("hashes") > 0, F.concat(one, F.slice(pair, F.lit(1), F.size("hashes") - 1))).otherwise(F.array().cast("array<int>"))).drop("hashes")


def base(words: DataFrame) -> DataFrame:
    """From split_words: doc_id (and __row), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the words."""
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    grams = F.when(n > 2, F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), n - 2)).otherwise(F.array().cast("array<long>"))
    out = words.withColumns({"lines": F.coalesce(lines, F.array().cast("array<string>")), "windows": grams}).select(
        *(c for c in ("__row", "doc_id", "words") if c in words.columns), n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("windows")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def fit(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Log ratio of target to raw probability for each bucket, in millionths. trusted: doc_id of the target's documents.

    Both multinomials are counted over every document. The target's is smoothed by PRIOR n-grams of the raw one; without
    trusted documents all ratios are 0. Tasks add up before anything is shuffled, to BUCKETS rows each at most. The ids
    are broadcast if small by their measured size; else both sides are shuffled.
    """
    ids = Settled(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    marked = ngrams(split_words(docs)).select("doc_id", "grams").join(ids.side().withColumn("target", F.lit(1)), "doc_id", "left")
    # explode() would put a filter on grams below the projection that makes them and so compute them in a nested way
    counts = marked.select("target", F.explode_outer("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target"))
    raw, target = [1] * BUCKETS, [0] * BUCKETS
    for row in counts.where("gram is not null").collect():  # BUCKETS rows at most
        raw[row["gram"]] += row["raw"]
        target[row["gram"]] = row["target"]
    ids.drop()
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0] * BUCKETS
    return [round(SCALE * math.log((t + PRIOR * r / n_raw) / (n_target + PRIOR) / (r / n_raw))) for r, t in zip(raw, target, strict=True)]


def score(docs: DataFrame, ratios: list[int], row: bool = False) -> DataFrame:
    """doc_id (and __row: all columns of docs), the base measures, base_failed, kept, n_grams, llr (for each n-gram; 0 without any)."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    own = ["__row", "doc_id"] if row else ["doc_id"]
    grams = ngrams(base(split_words(docs, row)))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    out = grams.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.size("grams").cast("long").alias("n_grams"), total.alias("sum"))
    kept = ~F.col("base_failed") & (F.col("sum") >= F.lit(round(THRESHOLD * SCALE)) * F.col("n_grams"))
    out = out.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_grams", F.coalesce(F.col("sum") / F.lit(float(SCALE)) / F.nullif("n_grams", F.lit(0)), F.lit(0.0)).alias("llr"))
    # a caller's condition on a measure would be pushed below and compute it, and what it is made of, once more at each step; a generator keeps it above
    return out.select(F.explode_outer(F.array(F.struct(*out.columns))).alias("__out")).select("__out.*")


def judge(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text) with the base measures, base_failed, kept, n_grams and llr.

    Null and empty texts have no words, fail the base rules and aren't kept. Repeated rows and equal ids are judged row
    by row. An empty table gives an empty result. trusted names the target's documents; ids that docs lacks don't
    matter. Other columns of docs are not read.
    """
    return score(docs, fit(docs, trusted))
