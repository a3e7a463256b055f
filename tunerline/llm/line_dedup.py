"""Line dedup by content-defined chunks of lines: a rolling hash over line hashes sets their ends."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, unused, worker_state

#: Each of these numbers of lines rolls over the text by itself and sets boundaries of its own.
WIDTHS = (1, 2)
#: A chunk can't begin before lines whose rolling hash has so many low bits set, nor end after those with the next so many set.
BITS = 2
#: Only chunks of so many lines that aren't blank are compared.
LEAST_LINES = 2
#: A chunk that is found again is extended by so many lines to either side, where these are equal too.
REACH = 2
_ALL = (1 << 64) - 1
_KEYS = ["doc_id", "text_hash"]


def _turn(x: int, by: int) -> int:
    by &= 63
    return (x << by | x >> (64 - by)) & _ALL if by else x


def boundaries(hashes: list[int], width: int) -> list[int]:
    """Places between lines, the text's beginning and end among them, that a cyclic polynomial over width line hashes sets: it
    rolls over the lines, and its value says whether a chunk can begin before them and whether one can end after them.

    So a boundary depends on the lines that follow it or on those before it alone, and lines added or lost elsewhere shift it along."""
    out, rolling, low = {0, len(hashes)}, 0, (1 << BITS) - 1
    for i, h in enumerate(hashes):
        rolling = _turn(rolling, 1) ^ h
        if i >= width:
            rolling ^= _turn(hashes[i - width], width)
        if i >= width - 1:
            if ~rolling & low:
                out.add(i + 1 - width)
            if ~rolling >> BITS & low:
                out.add(i + 1)
    return sorted(out)


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk, ascending: from each boundary to the next one of the same width that leaves LEAST_LINES lines that aren't blank."""
    hashes, full = [xxhash.xxh3_64_intdigest(x.encode("utf-8")) for x in lines], [0]
    for x in lines:
        full.append(full[-1] + bool(x.strip()))
    out = set()
    for width in WIDTHS:
        at = boundaries(hashes, width)
        end = 0
        for first in at:
            while end < len(at) and full[at[end]] - full[first] < LEAST_LINES:
                end += 1
            if end == len(at):
                break
            out.add((first, at[end] - first))
    return sorted(out)


def _key(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - (1 << 63), (x & _ALL) - (1 << 63)


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, lines, k1, k2: the comparable chunks of each text, with the 128-bit hash of their bytes."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        worker_state("")
        for b in batches:
            row, first, n, k1, k2 = [], [], [], [], []
            for r, text in enumerate(b.column("text")):
                lines = (text.as_py() or "").split("\n")
                if len(lines) < LEAST_LINES:
                    continue
                for at, size in chunks(lines):
                    key = _key("\n".join(lines[at : at + size]).encode("utf-8"))
                    row.append(r)
                    first.append(at)
                    n.append(size)
                    k1.append(key[0])
                    k2.append(key[1])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(at), "text_hash": b.column("text_hash").take(at), "first": pa.array(first, pa.int32()), "lines": pa.array(n, pa.int32()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64())})

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, first int, lines int, k1 long, k2 long")


def _same_row(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on the row's key (names __d and __h in b), ids null-safe."""
    return a.join(b, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), how)


def _bytes_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """k1, k2, bytes, before, after: the text of the chunks at places (__d, __h, at: array of first, lines, k1, k2) and up to REACH lines to either side."""

    def run(batches):
        for b in batches:
            k1, k2, data, before, after = [], [], [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
                lines = text.split("\n")
                for x in at:
                    k1.append(x["k1"])
                    k2.append(x["k2"])
                    first, end = x["first"], x["first"] + x["lines"]
                    data.append("\n".join(lines[first:end]).encode("utf-8"))
                    before.append(lines[max(0, first - REACH) : first])
                    after.append(lines[end : end + REACH])
            yield pa.RecordBatch.from_pydict({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "bytes": pa.array(data, pa.binary()), "before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string()))})

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return _same_row(rows, places, "inner").select("text", "at").mapInArrow(run, "k1 long, k2 long, bytes binary, before array<string>, after array<string>").dropDuplicates(["k1", "k2"])


def dedup(docs: DataFrame, counts: tuple[str, str, str] = ("__n_lines", "__n_removed", "__n_chunks")) -> DataFrame:
    """All rows and columns of docs, text without the chunks that came before, and counts: lines, removed lines, removed chunks.

    A chunk whose bytes are those of an earlier one, in the order of doc_id (null first), the hash of the text, and the
    line, is removed, and with it up to REACH lines on either side that equal those beside the first; the first stays.
    Which runs of lines are chunks is up to the boundaries: a repeated run of m lines goes if at least LEAST_LINES lines
    in it lie between two of them, which short runs may miss. Chunks overlap: lines of a first copy
    go if they came before in another chunk, but of each removed line an earlier equal one stays. A hash of 128 bits
    finds the candidates, and each goes only if its bytes equal the kept chunk's. A text that loses all its lines becomes empty; null and empty texts
    stay. Rows that equal another in id and text count as one place: each loses the same. Tables may be empty, and
    further columns may have any names; those with the names of counts are replaced.

    Counting by chunk adds up in tasks first. Joins by chunk go through a broadcast where the written table is small by
    its measured size; else they shuffle, and runtime skew splitting takes care of frequent chunks. The texts are shuffled once, by row.
    """
    found = Settled(chunk_table(docs), "chunks")
    place = F.struct("doc_id", "text_hash", "first")
    kept = Settled(found.df.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep"), F.min_by("lines", place).alias("lines")).where("n > 1"), "repeated", share=4)
    again = found.df.join(kept.side().select("k1", "k2", "keep"), ["k1", "k2"]).where(~place.eqNullSafe(F.col("keep"))).select(*_KEYS, "first", "lines", "k1", "k2").distinct()
    sources = kept.df.groupBy(F.col("keep.doc_id").alias("__d"), F.col("keep.text_hash").alias("__h")).agg(F.collect_list(F.struct(F.col("keep.first").alias("first"), "lines", "k1", "k2")).alias("at"))
    sources = Settled(sources, "chunk-sources", share=4)
    texts = Settled(_bytes_of(docs, sources.side()), "chunk-bytes")
    plan = again.join(texts.side(), ["k1", "k2"]).groupBy(*[F.col(k).alias(n) for k, n in zip(_KEYS, ("__d", "__h"), strict=True)]).agg(F.collect_list(F.struct("first", "lines", "bytes", "before", "after")).alias("__drop"))
    plan = Settled(plan, "chunk-removals")
    for x in (found, kept, sources, texts):
        x.drop()
    return _cut(docs, plan.df, list(counts))  # the removed bytes are in it: its size follows the input's, so the texts are shuffled to it


def _beside(lines: list[str], span: range, before: list[str], after: list[str]) -> list[int]:
    """The lines next to a span that equal those next to the kept chunk."""
    out = []
    for step, first, others in ((-1, span.start - 1, before[::-1]), (1, span.stop, after)):
        for i, x in enumerate(others):
            at = first + step * i
            if not 0 <= at < len(lines) or lines[at] != x:
                break
            out.append(at)
    return out


def _cut(docs: DataFrame, plan: DataFrame, extra: list[str]) -> DataFrame:
    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in extra}]
    k, d, h, drop = unused(docs, "__text_hash", "__d", "__h", "__drop")
    rows = docs.select(*names).withColumn(k, F.xxhash64("text"))
    plan = plan.select(F.col("__d").alias(d), F.col("__h").alias(h), F.col("__drop").alias(drop))
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(h)), "left").select(*names, drop)
    schema = docs.select(*names).schema
    for c in extra:
        schema = schema.add(c, "long")

    def run(batches):
        for b in batches:
            texts, counts = [], ([], [], [])
            drops = b.column(drop)
            for r, text in enumerate(b.column("text").to_pylist()):
                lines, gone, cut = (text or "").split("\n") if text else [], set(), 0
                for x in drops[r].as_py() or ():
                    span = range(x["first"], x["first"] + x["lines"])
                    if "\n".join(lines[span.start : span.stop]).encode("utf-8") == x["bytes"]:
                        gone.update(span, _beside(lines, span, x["before"], x["after"]))
                        cut += 1
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
                for c, v in zip(counts, (len(lines), len(gone), cut), strict=True):
                    c.append(v)
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c, pa.int64()) for c in counts], names=names + extra)

    return rows.mapInArrow(run, schema)
