"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.llm.common import Settled

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with its path; the longest wins.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Hosts listed as unwanted, as canonical URLs; a host entry covers its subdomains.
LISTED = [f"{name}.example.{top}/" for name in ("spam-farm", "cheap-pills", "free-bets", "ads-track", "casino-win", "adult-x") for top in ("com", "net", "org")]
#: Filter bits for each listed URL, bits set for each, and the most blocks of 64 bits (8 MB). Beyond that more false positives go to the exact join; results stay.
BITS_PER_KEY, BITS_SET, MOST_BLOCKS = 16, 6, 1 << 20


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substr(url, F.locate("://", url) + 3), "#", 1))
    host = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty without a ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substring_index(F.substr(url, F.locate("://", url) + 3), "#", 1), "?", 1))
    return F.coalesce(F.when(F.locate("/", rest) > 0, F.substr(rest, F.locate("/", rest))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., then the path without trailing slashes and index pages; query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"(/index\.html?)?/*\z", ""), r"^/+", ""))


def lookups(host: Column, path: Column) -> Column:
    """The canonical URLs under which a page may be listed: its own, and the root of its host and of each parent domain of two labels or more."""
    labels = F.split(host, r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(host, path)), roots))


def _blocks(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of 64-bit keys: the low 40 bits choose the block, products of the key choose the bits in it."""
    k = keys.astype(np.int64).view(np.uint64)
    mask = np.zeros(len(k), np.uint64)
    x = k
    for _ in range(BITS_SET):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        mask |= np.uint64(1) << (x >> np.uint64(58))
    return (k & np.uint64((1 << 40) - 1)) % np.uint64(n), mask


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """url: canonical URLs from a file of a URL or host a line; blank lines and those that begin with # don't count."""
    line = F.btrim("value")
    url = F.when(F.locate("://", line) > 0, line).otherwise(F.concat(F.lit("http://"), line))
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(canonical(host_of(url), path_of(url)).alias("url"))


class BlockedBloom:
    """A Bloom filter whose keys each touch one 64-bit block. Built by tasks over the list; the union is at most 8 MB."""

    def __init__(self, keys: DataFrame, count: int):
        """keys: one column key, long."""
        n = self.n = min(MOST_BLOCKS, max(1, -(-count * BITS_PER_KEY // 64)))

        def part(frames):
            for pdf in frames:
                block, mask = _blocks(pdf["key"].to_numpy(), n)
                yield pd.DataFrame({"block": block.astype(np.int64), "mask": mask.view(np.int64)})

        rows = keys.mapInPandas(part, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
        self.bits = np.zeros(n, np.uint64)
        self.bits[rows["block"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        block, mask = _blocks(keys, self.n)
        return (self.bits[block.astype(np.int64)] & mask) == mask


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, listed_as.

    The verdict is that of the longest rule that fits; without a rule it is block if the page's canonical URL or a root
    of its host's domains is in listed (url: canonical URLs; duplicates and nulls don't matter), else allow. listed_as
    is the longest such entry, else null. A null url, or one without ://, has empty host and path, no rule and verdict
    allow. Equal page ids are judged row by row. Other columns are not read.

    Pages that no rule decides look up each of their canonical URLs in the filter, on the scan; only possible hits are
    shuffled, made distinct and go into the exact hash join. The list is read by tasks, never held whole by one.
    """
    spark = pages.sparkSession
    entries = listed.select(F.col("url").alias("entry")).where("entry is not null").distinct()
    settled = Settled(entries, "listed")
    bloom = BlockedBloom(settled.df.select(F.xxhash64("entry").alias("key")), settled.df.count())
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def may_hold(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(keys.to_numpy(np.int64)))

    judged = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    asked = judged.where("fit is null and host <> ''").select("host", "path", F.explode(lookups(F.col("host"), F.col("path"))).alias("entry"))
    hits = asked.where(may_hold(F.xxhash64("entry"))).distinct().join(settled.side(), "entry")
    hits = hits.groupBy("host", "path").agg(F.max_by("entry", F.struct(F.length("entry"), "entry")).alias("listed_as"))
    out = judged.join(Settled(hits, "url-hits").side(), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("listed_as").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.when(F.col("fit").isNull(), F.col("listed_as")).alias("listed_as"))
