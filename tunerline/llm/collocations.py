"""Phrase collocations: n-gram counts from word suffix arrays of shards, merged by key and scored by how often the parts stay together."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, worker_state

#: Phrases are of 2 to so many words, and occur so often at least.
WORDS, LEAST = 3, 10
#: A phrase goes if a longer candidate that holds it has so many hundredths of its occurrences.
INSIDE = 50
#: Phrases returned for each language.
TOP = 2_000
#: Words and separators of a shard; a suffix array is made of each.
SHARD = 1 << 20
#: Bits of the filter that tells shards which pairs of words are frequent: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: Parts that a language's phrases are ranked in before the foremost of all are.
SALTS = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]+")
_ENDS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
_KEY = "lang string, phrase string, n long"


#: Bytes of text that go into a shard at most, if no single text is longer, and that are cut into words at once.
SHARD_BYTES, BLOCK = 1 << 25, 1 << 20
#: Rows of an Arrow batch.
BATCH = 1 << 16


class _Ids(dict):
    """Numbers of a language's words within a shard, from 1 on; what ends a piece is 0."""

    def __init__(self, lang: int, words: list[bytes], langs: list[int]):
        super().__init__()
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, token: bytes) -> int:
        if token[0] in _ENDS:
            n = 0
        else:
            n = len(self.words)
            self.words.append(token)
            self.langs.append(self.lang)
        self[token] = n
        return n


def _tokens(data: bytes):
    """Lists of the words and separators of a text, cut at blanks so that few bytes are cut up at once."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield _TOKEN.findall(data[at:end])
        at = end


def _left(ids: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece. ids end with 0."""
    ends = np.flatnonzero(ids == 0)
    return ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))


def suffix_array(ids: np.ndarray, most: int) -> np.ndarray:
    """The places of words ordered by what follows in their piece, as far as most words decide. ids: word numbers from 1
    on, 0 after each piece. Prefix doubling: the rank of 2 * width words is that of two ranks of width words."""
    rank, left, width = ids.astype(np.int64), _left(ids), 1
    while width < most:
        then = np.zeros_like(rank)
        then[:-width] = np.where(left[:-width] >= width, rank[width:], 0)
        _, rank = np.unique(rank * (len(ids) + 1) + then, return_inverse=True)  # a 0 stays 0: nothing is less
        width *= 2
    order = np.argsort(rank, kind="stable")
    return order[np.searchsorted(rank, 0, side="right", sorter=order) :]


def common(ids: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many words, up to most, each suffix of the order begins with that the one before it begins with too."""
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    n, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in range(most):
        a = padded[order[1:] + k]
        same = same & (a == padded[order[:-1] + k]) & (a > 0)
        n[1:] += same
    return n


def intervals(ids: np.ndarray, least: int, most: int, starts: int):
    """(words, places, counts): for each number of words the phrases that begin at one of the first starts places, each by
    one place, and how often it does. Suffixes that share so many words are an interval of the order: it begins where fewer are shared."""
    order = suffix_array(ids, most)
    order = order[order < starts]
    lcp, left = common(ids, order, most), _left(ids)
    for k in range(least, most + 1):
        heads = np.flatnonzero(lcp < k)
        counts = np.diff(np.append(heads, len(order)))
        whole = left[order[heads]] >= k
        yield k, order[heads[whole]], counts[whole]


def _hashes(words: list[bytes], langs: list[int], names: list[str]) -> np.ndarray:
    """Hashes of words; langs: for each word the place of its language's name."""
    seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in names]
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seeds[x]) for w, x in zip(words, langs, strict=True)), np.uint64, len(words))


def _bit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The filter's bit of pairs of words, by their hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _cut(ids: np.ndarray, hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """ids with a 0 between each two words that aren't a frequent pair by the filter, and without the words that are then alone."""
    h = hashes[ids]
    bit = _bit(h[:-1], h[1:])
    pair = np.zeros(len(ids), bool)
    pair[:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & ((cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    kept = pair.copy()
    kept[1:] |= pair[:-1]
    out = np.stack([np.where(kept, ids, 0), np.where(pair, -1, 0)], 1).ravel()
    out = out[out >= 0]
    return np.concatenate([out[(out > 0) | np.concatenate([[True], out[:-1] > 0])], np.zeros(1, ids.dtype)])


def counts(docs: DataFrame, least: int, most: int, frequent=None) -> DataFrame:
    """lang, phrase, n of all phrases of least to most words, added up. docs: lang, text. With least 1 also the empty
    phrase, which counts a language's words. frequent: a broadcast filter; phrases with a pair that isn't in it are left out."""

    def run(batches):
        worker_state("")
        held, size, number, words, langs, dicts = [], 0, 0, [b""], [0], {"": None}  # word 0 is none, of no language
        for b in batches:
            for name, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                data = (text.as_py() or "").encode().translate(_LOWER)
                if dicts.get(name) is None:
                    dicts[name] = _Ids(0 if name == "" else len(dicts), words, langs)
                ids = dicts[name]
                for tokens in _tokens(data):
                    held.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                    number += len(tokens)
                held.append(np.zeros(1, np.int32))
                size += len(data)
                if number >= SHARD or size >= SHARD_BYTES:
                    yield from shard(np.concatenate(held), words, langs, list(dicts))
                    held, size, number, words, langs, dicts = [], 0, 0, [b""], [0], {"": None}
        if held:
            yield from shard(np.concatenate(held), words, langs, list(dicts))

    def shard(ids, words, langs, names):
        of, name, text = np.array(langs, np.int32), pa.array(names, pa.string()), pa.array(words, pa.string())
        if least == 1:
            total = np.bincount(of, np.bincount(ids, minlength=len(words)) * (np.arange(len(words)) > 0), len(names)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": name, "phrase": pa.array([""] * len(names), pa.string()), "n": pa.array(total)}).filter(pa.array(total > 0))
        if frequent is not None:
            ids = _cut(ids, _hashes(words, langs, names), frequent.value)
        for lo in range(0, len(ids), SHARD):  # only a single text can be longer; what its part shares with the next is behind the starts
            part = np.append(ids[lo : lo + SHARD + most - 1], np.int32(0))
            for k, places, n in intervals(part, least, most, min(SHARD, len(ids) - lo)):
                for i in range(0, len(places), BATCH):
                    own = places[i : i + BATCH]
                    parts = [text.take(pa.array(part[own + j])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
                    yield pa.RecordBatch.from_pydict({"lang": name.take(pa.array(of[part[own]])), "phrase": phrase, "n": pa.array(n[i : i + BATCH].astype(np.int64))})

    return docs.select("lang", "text").mapInArrow(run, _KEY).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pair_filter(pairs: DataFrame):
    """A broadcast array of FILTER_BITS bits, in cells of 64: those of pairs (lang, phrase of two words) are set. Tasks add the bits up; the driver gets the cells, however many pairs there are."""

    def run(batches):
        for b in batches:
            words = [x.encode().split(b" ") for x in b.column("phrase").to_pylist()]
            lang = b.column("lang").dictionary_encode()
            langs, names = lang.indices.to_pylist(), lang.dictionary.to_pylist()
            bit = _bit(_hashes([w[0] for w in words], langs, names), _hashes([w[1] for w in words], langs, names))
            yield pa.RecordBatch.from_pydict({"cell": pa.array((bit >> np.uint64(6)).astype(np.int32)), "bits": pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))})

    cells = np.zeros(FILTER_BITS >> 6, np.uint64)
    found = pairs.select("lang", "phrase").mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(cells)


def grams(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """lang, phrase, n, words of all phrases of 1 to words words with least occurrences; the phrase without words counts all
    of a language's. docs: lang, text.

    Words and pairs are counted first. Longer phrases can only be frequent if each pair in them is, so the shards leave
    out what holds another: by a filter of fixed size, which lets some through, whose counts then show that they are rare."""
    size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    short = Settled(counts(docs, 1, min(2, words)).where((F.col("n") >= least) | (F.col("phrase") == "")).withColumn("words", size), "phrases", share=1)
    if words < 3:
        return short.df
    frequent = pair_filter(short.df.where("words = 2"))
    long_ = Settled(counts(docs, 3, words, frequent).where(F.col("n") >= least).withColumn("words", size), "long-phrases", share=1)
    frequent.unpersist()
    return short.df.unionByName(long_.df)


def score(counted: DataFrame, words: int = WORDS) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words or more, by the cut of the lowest score; without those that
    a longer one holds too often. counted: as from grams."""
    phrases = counted.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words").withColumn("w", F.split("phrase", " "))
    join = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = counted.where(f"words between 1 and {words - 1}")
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n)), ["lang", part])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1_000_000).cast("decimal(38,0)") * exact("a") * exact("a")).withColumn("down", (exact("l") * exact("r")).cast("decimal(38,0)"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    scored = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*")
    if words < 3:
        return scored
    held = phrases.where("words > 2").select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    held = held.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("lo"))
    held = held.groupBy("lang", join(F.col("lo"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    return scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a"))).drop("longer")


def mine(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language of docs (text, lang).

    Texts, with A-Z made small, are cut at `.,;:!?` and line ends into pieces and these at blanks and tabs into words. A
    phrase is 2 to words neighbouring words of a piece with least occurrences (a), overlapping ones included. Cut into two
    it has parts with l and r occurrences and a score, the whole part of 1,000,000 * a * a / (l * r); its lowest score counts,
    of ties the one with the shortest first part. A phrase goes if a longer candidate that holds it has INSIDE hundredths of its
    occurrences. n: words of the language. Ranks go by score, a (both falling) and the phrase's bytes. A null language is
    `und`; null and empty texts have no words; repeated rows count each time; an empty table gives no rows; other
    columns are not read. Arithmetic is exact up to 10**15 words.

    Each task counts phrases by suffix arrays over shards of bounded size and adds up before the shuffle; keys meet as
    texts, so a hot word or pair is one row for each shard. Languages are ranked in SALTS parts before the foremost rows of all parts are.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = grams(docs, words, least)
    best = score(counted, words)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counted.where("words = 0").select("lang", F.col("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
