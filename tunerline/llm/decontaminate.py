"""Benchmark decontamination by a distributed positional inverted index: shifted postings lists are intersected, rarest terms first."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.llm import common
from tunerline.llm.common import Settled, worker_state
from tunerline.llm.urls import BlockedBloom

#: Words of a window.
WINDOW = 10
#: Terms of a window, and of an item, whose postings are intersected, rarest first.
ANCHORS = 2
#: An item is near a document if its rarest terms lie within so many words of one another.
NEAR = 20
#: Slices that the postings of a term are stored in.
SLICES = 64
#: Words that a worker remembers as asked for or not.
ASKED = 1 << 18
#: A-Z to lower case; all other ASCII but digits and letters ends a word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def windows(benchmark: DataFrame) -> DataFrame:
    """phrase_id, terms (array), items (the ids as text, sorted): the distinct windows of all items (item_id, text)."""

    def run(batches):
        for b in batches:
            ids, terms = [], []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = [w.decode() for w in words(text)]
                for i in range(max(1, len(ws) - WINDOW + 1) if ws else 0):
                    ids.append(item)
                    terms.append(ws[i : i + WINDOW])
            yield pa.RecordBatch.from_pydict({"item": pa.array(ids, pa.string()), "terms": pa.array(terms, pa.list_(pa.string()))})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    out = items.mapInArrow(run, "item string, terms array<string>").groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return out.select(F.sha2(F.array_join("terms", " "), 256).alias("phrase_id"), "terms", "items")


class Asked(dict):
    """Word -> whether it may be among the terms of a Bloom filter; remembers up to ASKED words."""

    def __init__(self, bloom: BlockedBloom):
        super().__init__()
        self.bloom = bloom

    def __missing__(self, word: bytes) -> bool:
        if len(self) > ASKED:
            self.clear()
        key = xxhash.xxh64_intdigest(word, seed=42)  # as Spark's xxhash64
        found = self[word] = bool(self.bloom.may_hold(np.array([key], np.uint64).view(np.int64))[0])
        return found


def filter_of(terms: Settled) -> frozenset | BlockedBloom:
    """For the workers: the terms themselves (column term) if their table is small by its measured size, else a Bloom
    filter of them, of at most 8 MB however many there are. What it lets pass is joined with the terms, so either gives the same."""
    if terms.bytes() <= common.BROADCAST_BYTES:
        return frozenset(r["term"].encode("utf-8") for r in terms.df.collect())
    return BlockedBloom(terms.df.select(F.xxhash64("term").alias("key")), terms.df.count())


def _asks(passed: frozenset | BlockedBloom | None):
    """Whether a word may be asked for, as a function; without a filter all are."""
    return (lambda w: True) if passed is None else passed.__contains__ if isinstance(passed, frozenset) else Asked(passed).__getitem__


def frequencies(docs: DataFrame, terms: Settled) -> DataFrame:
    """term, n: occurrences over all texts of the terms that any text has. Tasks add up before anything is shuffled."""
    shared, key = docs.sparkSession.sparkContext.broadcast(filter_of(terms)), f"asked:{uuid.uuid4().hex}"

    def run(batches):
        asked, seen = worker_state(key, lambda: _asks(shared.value)), Counter()

        def out():
            return pa.RecordBatch.from_pydict({"term": pa.array([t.decode() for t in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for b in batches:
            for text in b.column("text"):
                seen.update(filter(asked, words(text.as_py())))
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    counts = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(terms.side(), "term", "left_semi")


def anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase_id and picked: array of (term, offset), ANCHORS at most, the rarest terms first. Phrases with a term that no text has are left out."""
    each = phrases.select("phrase_id", F.posexplode("terms").alias("offset", "term")).groupBy("phrase_id", "term").agg(F.min("offset").alias("offset"))
    each = each.join(counts, "term", "left").groupBy("phrase_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("ranked"))
    return each.where(F.col("ranked")[0]["n"] > 0).select("phrase_id", F.transform(F.slice("ranked", 1, ANCHORS), lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset"))).alias("picked"))


def item_anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """item, picked (array of terms): the ANCHORS rarest terms of each item, of those that any text has."""
    each = phrases.select(F.explode("items").alias("item"), "terms").select("item", F.explode("terms").alias("term")).distinct().join(counts, "term")
    return each.groupBy("item").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, ANCHORS), lambda x: x["term"]).alias("picked"))


def text_key(text: str | Column = "text") -> Column:
    """Names a text: equal texts share their postings."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def index(docs: DataFrame, terms: Settled | None = None) -> tuple[Settled, Settled]:
    """The positional inverted index of all texts: texts (doc_id, key, n_words), a row for each of docs, and postings
    (term, key, positions: ascending array), stored by term in SLICES slices of texts, so that no frequent term makes one
    large piece. terms (column term) asks for these only; a Bloom filter of bounded size thins the words before an exact join."""
    spark, kind, made = docs.sparkSession, dict(docs.dtypes)["doc_id"], f"postings:{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(None if terms is None else filter_of(terms))

    def run(batches):
        asked = worker_state(made, lambda: _asks(shared.value))
        for b in batches:
            n, terms, lengths, places, sizes = [], [], [], [], []
            for text in b.column("text"):
                ws, found = words(text.as_py()), {}
                n.append(len(ws))
                for i in [i for i, w in enumerate(ws) if asked(w)]:
                    found.setdefault(ws[i], []).append(i)
                sizes.append(len(found))
                terms += found
                for p in found.values():
                    lengths.append(len(p))
                    places += p
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            own = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(ends(lengths), pa.array(places, pa.int32()))], names=["term", "positions"])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": b.column("key"), "n_words": pa.array(n, pa.int64()), "postings": pa.ListArray.from_arrays(ends(sizes), own)})

    rows = docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key binary, n_words long, postings array<struct<term:string,positions:array<int>>>")
    texts = Settled(rows, "texts")
    posted = texts.df.select("key", F.explode("postings").alias("p")).select("p.term", "key", "p.positions")
    if terms is not None:
        posted = posted.join(terms.side(), "term", "left_semi")
    posted = posted.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES))).repartition("term", "slice")
    # equal texts are in one slice, so this needs no further shuffle
    return texts, Settled(posted.dropDuplicates(["term", "slice", "key"]).drop("slice"), "postings", share=4)


def phrase_candidates(postings: DataFrame, anchored: DataFrame) -> DataFrame:
    """key, phrase_id, starts: where a phrase's anchors all stand at their offsets.

    The positions of the rarest term, less its offset, are intersected with those of the next rarest, less theirs."""
    shifted = lambda p, offset: F.transform(p, lambda x: x - offset)
    wanted = anchored.select("phrase_id", F.col("picked")[0]["term"].alias("term"), F.col("picked")[0]["offset"].alias("offset"), *[F.get("picked", F.lit(i)).alias(f"next{i}") for i in range(1, ANCHORS)])
    hit = postings.join(wanted, "term").withColumn("starts", F.filter(shifted("positions", F.col("offset")), lambda s: s >= 0)).where(F.size("starts") > 0)
    hit = hit.select("key", "phrase_id", "starts", *[f"next{i}" for i in range(1, ANCHORS)])
    for i in range(1, ANCHORS):
        other = postings.select(F.col("key").alias("k"), "term", "positions")
        met = hit.join(other, (F.col("key") == F.col("k")) & (F.col(f"next{i}.term") == F.col("term")), "left")
        both = F.array_intersect("starts", F.coalesce(shifted("positions", F.col(f"next{i}.offset")), F.array().cast("array<int>")))
        hit = met.withColumn("starts", F.when(F.col(f"next{i}").isNull(), F.col("starts")).otherwise(both)).drop("k", "term", "positions").where(F.size("starts") > 0)
    return hit.select("key", "phrase_id", "starts")


def phrase_matches(docs: DataFrame, candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """key, n_hit (words inside any occurrence), phrase_ids (those that occur): candidates whose words in the text are all the phrase's."""

    def run(batches):
        for b in batches:
            keys, hits, ids = [], [], []
            for key, text, asked in zip(b.column("key"), b.column("text"), b.column("asked"), strict=True):
                ws, found, spans = words(text.as_py()), set(), []
                for x in asked.as_py():
                    terms = [t.encode() for t in x["terms"]]
                    at = [s for s in x["starts"] if ws[s : s + len(terms)] == terms]
                    if at:
                        found.add(x["phrase_id"])
                        spans += [(s, s + len(terms)) for s in at]
                end = n = 0
                for lo, hi in sorted(spans):
                    n += max(0, hi - max(lo, end))
                    end = max(end, hi)
                if n:
                    keys.append(key.as_py())
                    hits.append(n)
                    ids.append(sorted(found))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "n_hit": pa.array(hits, pa.int64()), "phrase_ids": pa.array(ids, pa.list_(pa.string()))})

    asked = candidates.join(phrases.select("phrase_id", "terms"), "phrase_id").groupBy("key").agg(F.collect_list(F.struct("phrase_id", "terms", "starts")).alias("asked"))
    asked = Settled(asked, "phrase-candidates", share=4)
    rows = docs.select(text_key().alias("key"), "text").join(asked.side(), "key").select("key", "text", "asked")
    return rows.mapInArrow(run, "key binary, n_hit long, phrase_ids array<string>").dropDuplicates(["key"])


def proximity_matches(postings: DataFrame, queries: DataFrame, span: int, terms: int = ANCHORS) -> DataFrame:
    """item, key: the texts in which all terms of a query lie near one of its first term's places: fewer than span words
    away from it. queries: item, picked (array of at most so many terms, the rarest first); none match an empty array.

    Places are dealt into stretches of span words; a place meets those of its own stretch and of the two beside it."""
    place = lambda i: postings.join(queries.select("item", F.get("picked", F.lit(i)).alias("term")), "term").select("item", "key", F.explode("positions").alias("p"))
    out = place(0).join(queries.select("item", F.size("picked").alias("size")), "item").withColumn("stretch", F.floor(F.col("p") / span))
    for i in range(1, terms):
        near = place(i).select(F.col("item").alias("item2"), F.col("key").alias("key2"), F.col("p").alias("q"), F.explode(F.array(*[F.floor(F.col("p") / span) + d for d in (-1, 0, 1)])).alias("stretch2"))
        met = out.where(F.col("size") > i).join(near, (F.col("item") == F.col("item2")) & (F.col("key") == F.col("key2")) & (F.col("stretch") == F.col("stretch2")) & (F.abs(F.col("p") - F.col("q")) < span), "left_semi")
        out = out.where(F.col("size") <= i).unionByName(met)
    return out.select("item", "key").distinct()


def judge(docs: DataFrame, benchmark: DataFrame, near: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key, and n_near_items if near is given.

    n_hit counts the words inside any occurrence of a window of benchmark (item_id, text), n_items the items with such
    windows; items_sha256 is over their ids, sorted as text and joined by commas (of nothing without items). n_near_items
    counts the items whose ANCHORS rarest terms (of those that any text has) lie in the text, the others fewer than near
    words from the rarest. Null and empty texts have no words and aren't contaminated; items without words, or with a
    null id, have no windows. Equal items share windows and each count. Repeated rows and equal ids are judged row by
    row. Columns besides are not read. key is the SHA-256 of the text.

    Two passes over the texts: how often the benchmark's terms occur, then the postings of each window's rarest terms,
    stored by term. Shifted lists are intersected text by text, and the texts of what is left are compared word by word.
    """
    phrases = Settled(windows(benchmark), "windows", few=True)
    terms = Settled(phrases.df.select(F.explode("terms").alias("term")).distinct(), "terms", few=True)
    counts = Settled(frequencies(docs, terms), "term-counts", few=True)
    anchored = Settled(anchors(phrases.side(), counts.side()), "anchors", few=True)
    wanted = anchored.df.select(F.explode("picked.term").alias("term"))
    if near is not None:
        items = Settled(item_anchors(phrases.df, counts.side()), "item-anchors", few=True)
        wanted = wanted.unionByName(items.df.select(F.explode("picked").alias("term")))
    wanted = Settled(wanted.distinct(), "wanted-terms", few=True)
    texts, postings = index(docs, wanted)
    found = Settled(phrase_matches(docs, phrase_candidates(postings.df, anchored.side()), phrases.side()), "phrase-matches", share=4)
    named = found.df.select("key", F.explode("phrase_ids").alias("phrase_id")).join(phrases.side().select("phrase_id", "items"), "phrase_id")
    named = named.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    hits = Settled(found.df.select("key", "n_hit").join(named, "key"), "hits", share=4)
    out = texts.df.select("doc_id", "key", "n_words").join(hits.side(), "key", "left")
    if near is not None:
        close = proximity_matches(postings.df, items.side(), near).groupBy("key").agg(F.count(F.lit(1)).alias("near"))
        out = out.join(Settled(close, "near-items", share=4).side(), "key", "left")
    for x in (phrases, terms, counts, anchored, wanted, postings, found):
        x.drop()
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "key", *([F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items")] if near is not None else []))
