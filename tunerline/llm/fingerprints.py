"""Document fingerprints: homomorphic multiset hashes, sums of wide vectors hashed from paragraphs. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the vector that a paragraph is hashed to, each modulo 2**32: 512 bits say whether two multisets are equal.
WIDE = 16
#: A paragraph's pieces are added into LEVELS times LANES numbers modulo 2**16, from which it is told how many differ.
LEVELS, LANES = 12, 32
#: Pieces end after a sentence, and have so many code points at most.
PIECE = 120
#: Blocks of rows, for each shuffle partition and in all, that neighbours are looked for in.
BLOCKS, MOST_BLOCKS = 4, 1 << 16

#: A fingerprint as it is added to and taken from: numbers of paragraphs and of pieces, the vector, and the numbers of the
#: pieces that aren't 0, each with its place above 16 bits, ascending.
TYPE = "struct<lines:long,pieces:long,wide:array<long>,lanes:array<int>>"
_NUMBER = (1 << 32) - 1
_LANE = (1 << 16) - 1


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _added(lanes: Column) -> Column:
    """Lanes (place << 16 | number, several of a place) with the numbers of each place added up modulo 2**16; what is 0 goes."""
    place = lambda x: F.shiftright(x, 16)
    places = F.array_sort(F.array_distinct(F.transform(lanes, place)))
    total = lambda p: _sum(F.transform(F.filter(lanes, lambda x: place(x) == p), lambda x: x.bitwiseAND(_LANE).cast("long"))).bitwiseAND(F.lit(_LANE).cast("long"))
    return F.filter(F.transform(places, lambda p: (F.shiftleft(p, 16) + total(p)).cast("int")), lambda x: x.bitwiseAND(_LANE) != 0)


def _lane(piece: Column) -> Column:
    """Where a piece's hash is added: a level that half as many pieces reach as the one below, one of its lanes, and the number."""

    def made(h: Column) -> Column:
        low = h.bitwiseAND(F.lit((1 << (LEVELS - 1)) - 1).cast("long")).bitwiseOR(F.lit(1 << (LEVELS - 1)).cast("long"))
        level = F.bit_count(low.bitwiseAND(-low) - 1)  # zeros at the end
        lane = F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(LANES - 1).cast("long"))
        number = F.greatest(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(_LANE).cast("long")), F.lit(1).cast("long"))
        return (F.shiftleft(level.cast("long") * LANES + lane, 16) + number).cast("int")

    return let(F.xxhash64(piece), made)


def _seeded(i: int):
    return lambda x: F.xxhash64(x, F.lit(i))


def fingerprint(text: Column) -> Column:
    """The fingerprint (TYPE) of a text's multiset of paragraphs, which are its lines; a null or empty text has none.

    Texts with equal paragraphs in any order have equal fingerprints; others differ but for a collision of 512 bits of
    sums of numbers hashed from SHA-256. The lanes are sums over the paragraphs' pieces: sentences, cut after PIECE code points."""

    def wide(hashes: Column) -> Column:
        def two(v: Column) -> Column:
            return F.array(_sum(F.transform(v, lambda x: F.shiftrightunsigned(x, 32))).bitwiseAND(F.lit(_NUMBER)), _sum(F.transform(v, lambda x: x.bitwiseAND(F.lit(_NUMBER)))).bitwiseAND(F.lit(_NUMBER)))

        return F.flatten(F.array(*[let(F.transform(hashes, _seeded(i)), two) for i in range(WIDE // 2)]))

    def made(lines: Column) -> Column:
        pieces = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(rf"[^.!?]{{0,{PIECE - 1}}}[.!?]|[^.!?]{{1,{PIECE}}}"), F.lit(0))))
        own = let(F.transform(pieces, _lane), lambda lanes: F.struct(F.size(lanes).cast("long").alias("pieces"), _added(lanes).alias("lanes")))
        return F.struct(F.size(lines).cast("long").alias("lines"), own["pieces"].alias("pieces"), let(F.transform(lines, lambda x: F.sha2(x, 256)), wide).alias("wide"), own["lanes"].alias("lanes"))

    return let(F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>")), made)


def insert(a: Column, b: Column, times: int = 1) -> Column:
    """The fingerprint of a's paragraphs and b's: what a text becomes when paragraphs are added to it."""
    modulo = lambda x, most: F.pmod(x, F.lit(most + 1).cast("long"))
    other = F.transform(b["lanes"], lambda x: (x.bitwiseOR(F.lit(_LANE)) - F.lit(_LANE) + modulo(times * x.bitwiseAND(_LANE).cast("long"), _LANE)).cast("int"))
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: modulo(x + times * y, _NUMBER))
    return F.struct((a["lines"] + times * b["lines"]).alias("lines"), (a["pieces"] + times * b["pieces"]).alias("pieces"), wide.alias("wide"), let(F.concat(a["lanes"], other), _added).alias("lanes"))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which must be among them."""
    return insert(a, b, -1)


def written(x: Column) -> Column:
    """A fingerprint as hexadecimal text: 8 digits for each of the two numbers and each of the vector's, 7 for each lane."""
    digits = lambda v, n: F.substring(F.hex(v + F.lit(1 << 4 * n)), 2, n)
    return F.lower(F.concat(digits(x["lines"], 8), digits(x["pieces"], 8), F.array_join(F.transform(x["wide"], lambda v: digits(v, 8)), ""), F.array_join(F.transform(x["lanes"], lambda v: digits(v, 7)), "")))


def likeness(a: Column, b: Column) -> Column:
    """How many of two texts' different pieces are in both equally often, as a part of all (0 to 1), told from their fingerprints alone; 1 for equal ones.

    Lanes that differ hold pieces that one text has more often, lanes that aren't 0 those of a text: of LANES lanes into which d
    pieces go, about LANES * exp(-d / LANES) are left. A level with hardly a lane left is too full to tell; those above it, with
    one piece in 2, 4, 8, stand for all. Where the last level is full (some 200,000 different pieces), likeness is 0."""
    table = F.array(*[F.lit(-LANES * math.log1p(-min(c, LANES - 1) / LANES)) for c in range(LANES + 1)])
    level = lambda lanes: F.transform(lanes, lambda x: F.floor(F.shiftright(x, 16) / LANES).cast("int"))
    levels = lambda found: let(found, lambda v: F.array(*[F.size(v) - F.size(F.array_remove(v, F.lit(k))) for k in range(LEVELS)]))
    either = F.array_distinct(F.transform(F.concat(F.array_except(a["lanes"], b["lanes"]), F.array_except(b["lanes"], a["lanes"])), lambda x: F.shiftleft(F.shiftright(x, 16), 16)))

    def told(c: Column) -> Column:
        start = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.when(F.greatest(*[F.get(c[x], k) for x in "abd"]) > LANES - 2, k + 1).otherwise(0)))

        def part(start: Column) -> Column:
            size = lambda x: F.aggregate(F.transform(c[x], lambda n, k: F.when(k >= start, F.get(table, n)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
            sizes = F.struct((size("a") + size("b")).alias("n"), size("d").alias("d"))
            return let(sizes, lambda z: F.when((start < LEVELS) & (z["n"] > 0), F.greatest(F.lit(0.0), (z["n"] - z["d"]) / (z["n"] + z["d"]))).otherwise(0.0))

        return let(start, part)

    same = (a["lines"] == b["lines"]) & (a["pieces"] == b["pieces"]) & (a["wide"] == b["wide"])
    return F.when(same, 1.0).otherwise(let(F.struct(levels(level(a["lanes"])).alias("a"), levels(level(b["lanes"])).alias("b"), levels(level(either)).alias("d")), told))


def _search(bounds: Column, key: Column, most: int) -> Column:
    """The number of ascending bounds, most at most, that aren't above key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    fits = lambda at: (at <= F.size(bounds)) & F.coalesce(F.get(bounds, F.least(at, F.size(bounds)) - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(fits(at + s), at + s).otherwise(at))


def blocks(docs: DataFrame, n: int) -> list:
    """The least key (doc_id, hash of the text) of each of up to n ranges that hold about as many rows each."""
    keys = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"))
    least = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    return [r["key"] for r in least.orderBy("key").collect()]


def followed(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of docs (doc_id, text: '' for null) in blocks, and the window in which lead() of a column is that of the next row
    by doc_id, hash of the text and text (null ids first; the first row after the last). Where guest isn't 0 the row
    stands in for the first of the block behind and must go in the end.

    Only keys are sorted over all. Each row finds its block among the blocks' least keys (MOST_BLOCKS at most, by halving
    twice) and is shuffled once; the first of each block is also sent to the block before."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    least = blocks(rows, min(MOST_BLOCKS, BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = f"struct<doc_id:{kind},h:long>"
    width = max(1, math.isqrt(max(0, len(least) - 1)) + 1)
    if least:
        first = F.array(*[F.struct(F.lit(k["doc_id"]).cast(kind).alias("doc_id"), F.lit(k["h"]).alias("h")) for k in least[::width]])
    else:
        first = F.array().cast(f"array<{key}>")
    inner = spark.createDataFrame([(c, least[c * width : (c + 1) * width]) for c in range(-(-len(least) // width))], f"part int, inner array<{key}>")
    heads = spark.createDataFrame([(k["doc_id"], k["h"], (i - 1) % len(least)) for i, k in enumerate(least)], f"head_id {kind}, head_h long, before int")
    own = F.struct("doc_id", "h")
    rows = rows.withColumn("part", _search(first, own, MOST_BLOCKS) - 1).join(F.broadcast(inner), "part", "left")  # both have a row for each block at most
    rows = rows.withColumn("block", F.col("part") * width + _search(F.col("inner"), own, width) - 1).drop("part", "inner")
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")), "left")
    at = lambda block, guest: F.struct(F.col(block).alias("block"), F.lit(guest).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(at("block", 0))).otherwise(F.array(at("block", 0), at("before", 1)))))
    return rows.select("doc_id", "text", "h", "at.*"), Window.partitionBy("block").orderBy("guest", "doc_id", "h", "text")


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Edited is the text with its last quarter of code points (rounded down) replaced by as many of the first of the next
    text, or all that it has; next is the row behind by ascending doc_id, null ids first, then by the text's hash; behind the last is the
    first. near_edited, near_next: the likeness of the text's fingerprint to that of its edited text, and of the next. A null text is
    an empty one, without paragraphs; empty ones are alike fully. Repeated rows follow each other, so all of them but one have
    themselves as next. An empty table gives no rows. Other columns are not read.
    """
    rows, order = followed(docs)
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("own", fingerprint(F.col("text")))
    rows = rows.withColumn("next_own", F.lead("own").over(order)).where("guest = 0")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.left("text", n - cut), F.left("next", cut)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", fingerprint(F.col("edited")).alias("changed"))
    own, changed = F.col("own"), F.col("changed")
    return rows.select("doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, F.col("next_own")).alias("near_next"))
