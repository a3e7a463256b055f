"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, grouped without making pairs of them."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, worker_state

#: Words are of so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A run loses a code point where this divides the hash of its document and itself.
DAMAGE = 199
#: A near word is a word's form if it occurs so many times as often.
RATIO = 5
#: Longer words are named by hashes in the groups' keys, as a word of a million letters would make a million keys of that length.
LONG = 64
#: Entries that a task adds up before it hands them on, and keys in a batch.
HELD, BATCH = 1 << 19, 1 << 14

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D2B79F7BC9A1
_AT_LEAST = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def damaged(doc_id: str, run: str) -> str:
    """The run, without the code point that its hash points at where DAMAGE divides it."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: damaged runs of letters of LEAST_LENGTH code points or more, added up over all documents."""

    def made(held: Counter):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches):
        worker_state("")
        held = Counter()
        for b in batches:
            for k, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # equal runs of a document share their hash
                for word, n in Counter(_AT_LEAST.findall(text.encode().translate(_LOWER).decode())).items():
                    word = damaged(k, word)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield made(held)
                    held = Counter()
        if held:
            yield made(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ends(word: str) -> tuple[list[int], list[int], list[int]]:
    """Hashes of the word's first k letters, of its letters from k on, and powers of the base, modulo a prime of 127 bits."""
    size = len(word)
    left, right, power = [0] * (size + 1), [0] * (size + 1), [1] * (size + 1)
    for k, c in enumerate(word):
        left[k + 1] = (left[k] * _BASE + ord(c)) % _PRIME
        power[k + 1] = power[k] * _BASE % _PRIME
    for k in range(size - 1, -1, -1):
        right[k] = (ord(word[k]) * power[size - 1 - k] + right[k + 1]) % _PRIME
    return left, right, power


def wildcards(word: str):
    """A key for each (position, prefix, suffix) that the word has: those of two words are equal if they differ in that place alone."""
    if len(word) <= LONG:
        for i in range(len(word)):
            yield word[:i] + "*" + word[i + 1 :]
        return
    left, right, _ = _ends(word)
    for i in range(len(word)):
        yield f"{len(word)}*{i}*{left[i]:x}*{right[i + 1]:x}"


def deletions(word: str):
    """The names of the different words that the word becomes by losing one letter."""
    if len(word) <= LONG + 1:
        for i in range(len(word)):
            if not i or word[i] != word[i - 1]:  # of equal neighbours each leaves the same
                yield word[:i] + word[i + 1 :]
        return
    left, right, power = _ends(word)
    for i in range(len(word)):
        if not i or word[i] != word[i - 1]:
            yield f"{len(word) - 1}#{(left[i] * power[len(word) - 1 - i] + right[i + 1]) % _PRIME:x}"


def own_name(word: str):
    """What deletions() calls the word."""
    yield word if len(word) <= LONG else f"{len(word)}#{_ends(word)[0][-1]:x}"


def keyed(words: DataFrame, keys) -> DataFrame:
    """key, id: the keys of each word of words (id, word)."""

    def run(batches):
        for b in batches:
            out, ids = [], []
            for i, word in zip(b.column("id").to_pylist(), b.column("word"), strict=True):
                for k in keys(word.as_py()):
                    out.append(k)
                    ids.append(i)
                    if len(out) >= BATCH:
                        yield pa.RecordBatch.from_pydict({"key": pa.array(out, pa.string()), "id": pa.array(ids, pa.int64())})
                        out, ids = [], []
            if out:
                yield pa.RecordBatch.from_pydict({"key": pa.array(out, pa.string()), "id": pa.array(ids, pa.int64())})

    return words.select("id", "word").mapInArrow(run, "key string, id long")


def near(words: DataFrame) -> DataFrame:
    """id, n_near, best: of words (id, word; ids ascend as counts fall) that have any, the number of near words and the least of their ids.

    Two words that differ by a replaced letter meet in one wildcard group, that of the place. A group has a word for each
    letter at most (90 letters there are); its size and its two foremost words tell each member how many others there
    are and which is foremost. Two that differ by an added letter meet where the longer one's deletions join the
    vocabulary, in as many rows as the longer one has letters at most."""
    group = keyed(words, wildcards).groupBy("key").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    group = group.select(F.size("ids").alias("size"), F.array_min("ids").alias("first"), "ids").withColumn("second", F.array_min(F.array_remove("ids", F.col("first"))))
    replaced = group.select("size", "first", "second", F.explode("ids").alias("id")).select("id", (F.col("size") - 1).cast("long").alias("n"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    shorter = keyed(words, own_name).select("key", F.col("id").alias("short"))
    joined = keyed(words, deletions).join(shorter, "key").select(F.explode(F.array(F.struct("id", F.col("short").alias("best")), F.struct(F.col("short").alias("id"), F.col("id").alias("best")))).alias("x"))
    indels = joined.select("x.id", F.lit(1).cast("long").alias("n"), "x.best")
    return replaced.unionByName(indels).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> Settled:
    """id, root: where the forms (id, form) lead to. Each round doubles the steps; counts grow by RATIO at each step, so a
    way has no more steps than the logarithm of the largest count, and the rounds are few."""
    now = Settled(forms.select("id", F.col("form").alias("root")), "roots", few=True)
    while True:
        on = now.side().select(F.col("id").alias("root"), F.col("root").alias("on"))
        after = Settled(now.df.join(on, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots", few=True)
        done = after.df.where("moved").isEmpty()
        now.drop()
        now = after
        if done:
            return now


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of docs (doc_id, text) with their near words counted, and what they are variants of.

    Words are runs of letters (A-Z made small) of LEAST_LENGTH code points and LEAST_COUNT occurrences; a run loses a
    code point as damaged() says. Near are two words by one inserted, deleted or replaced code point. form: the near
    word of most occurrences, of ties the first in the order of code points, if it has RATIO times the word's; form_n
    its count; root: the last form on the way from the word, or the word itself. Null and empty texts have no words; a
    null doc_id counts as an empty one; repeated rows count each time; an empty table gives no rows. Other columns are not read.

    Counts are added up in tasks before the shuffle. The vocabulary is sorted by falling count and then word, so that its
    row numbers order near words and groups carry numbers only. Keys of words up to LONG code points are the strings
    themselves; those of longer ones are hashes of 127 bits, which aren't compared by letters again.
    """
    counts = Settled(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "word-counts", share=4)
    words = Settled(counts.df.orderBy(F.col("n").desc(), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    counts.drop()
    found = Settled(near(words.df), "near-words", share=4)
    other = words.df.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = words.df.join(found.df, "id", "left").join(other, "best", "left")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    known = Settled(known, "forms", share=4)
    found.drop()
    roots = _roots(known.df.where("best is not null").select("id", F.col("best").alias("form")))
    named = roots.df.join(words.df.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.df.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
