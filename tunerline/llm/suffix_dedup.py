"""Suffix-array dedup of repeated byte strings: a sparse set of suffixes, mergesorted by hashed comparisons and checked by bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, joined_bytes, worker_state

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of the grams whose least hash marks a suffix: each string of LENGTH bytes holds a marked place, the same one in each of its copies.
GRAM = 256
#: Places in a string where its mark can be, and the bytes kept before a mark.
PLACES = LENGTH - GRAM + 1
LEFT = PLACES - 1
#: Different suffixes that are sorted together in one task; a larger group is split by the bytes that follow and precede its gram.
BUCKET = 1_024
#: Whole groups are gathered to about so many suffixes, which are sorted at once.
SORTED = 8_192
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 18) - 1)
_powers: list[np.ndarray] = []


def _power() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, enough for a block with its margins."""
    if not _powers:
        _powers[:] = [np.cumprod(np.full(BLOCK + 2 * LENGTH, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def marks(data: np.ndarray) -> np.ndarray:
    """Ascending places of the marked suffixes of a text: for each string of LENGTH bytes the place of the least gram
    hash in it, the leftmost of equals."""
    (up, down), found = _power(), []
    for lo in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[lo : lo + BLOCK + LENGTH - 1].astype(np.uint64)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=prefix[1:])
        gram = (prefix[GRAM:] - prefix[:-GRAM]) * down[: len(part) - GRAM + 1]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < PLACES:
            least = np.minimum(least[: width - PLACES], least[PLACES - width :])
        at = (least & _LOW).astype(np.int64)
        found.append(lo + at[np.flatnonzero(np.diff(at, prepend=-1))])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))


class Suffixes:
    """Byte strings with polynomial hashes of all their prefixes, sorted by groups. A common extension is found by binary
    search over the prefix hashes, so a comparison takes a logarithm of the length; all of a mergesort's steps of one
    kind are done at once. The bytes of neighbours are compared at the end: a collision can't pass."""

    def __init__(self, rows: np.ndarray, size: np.ndarray):
        """rows: (n, width) bytes, of which the first size count."""
        self.rows, self.size = rows, size
        self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * _power()[0][: rows.shape[1]], axis=1, out=self.hashes[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that strings i and j begin with alike, by their hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(self.rows.shape[1].bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.hashes[i, mid] == self.hashes[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _next(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The byte at a place, plus 1; 0 after the end."""
        return np.where(at < self.size[i], self.rows[i, np.minimum(at, self.rows.shape[1] - 1)].astype(np.int16) + 1, 0)

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Negative, 0 or positive as i comes before j, equals it or comes after it."""
        n = self.common(i, j)
        return self._next(i, n) - self._next(j, n)

    def _merged(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        order = np.arange(len(first))
        at, width = order - first, 1
        while width < count.max():
            run = at // width
            other = (run ^ 1) * width  # where the run to merge with begins
            lo, hi = np.zeros(len(at), np.int64), np.clip(count - other, 0, width)
            ask = np.flatnonzero(lo < hi)
            while len(ask):  # how many of that run come before each string
                mid = (lo[ask] + hi[ask]) >> 1
                c = self.compare(order[first[ask] + other[ask] + mid], order[ask])
                less = (c < 0) | ((c == 0) & (run[ask] & 1 == 1))
                lo[ask], hi[ask] = np.where(less, mid + 1, lo[ask]), np.where(less, hi[ask], mid)
                ask = ask[lo[ask] < hi[ask]]
            to = np.empty_like(order)
            to[first + (run & ~1) * width + at - run * width + lo] = order
            order, width = to, 2 * width
        return order

    def _shared(self, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the order the bytes shared with the string before (-1 for a group's first), by the bytes themselves, and whether the two are in order."""
        a, b = order[:-1], order[1:]
        differ = self.rows[a] != self.rows[b]
        n = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
        n = np.minimum(n, np.minimum(self.size[a], self.size[b]))
        head = first[1:] == np.arange(1, len(order))
        fine = head | (self._next(a, n) <= self._next(b, n))
        return np.concatenate([[-1], np.where(head, -1, n)]), np.concatenate([[True], fine])

    def sort(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """order, shared: the rows of each group in order, and the bytes that each shares with the one before (-1: none
        before). first, count: for each row the first row of its group, whose rows are side by side, and their number."""
        order = self._merged(first, count)
        shared, fine = self._shared(order, first)
        if not fine.all():  # hashes collided: those groups are sorted by their bytes
            for lo in np.unique(first[~fine]).tolist():
                own = range(lo, lo + int(count[lo]))
                order[lo : own.stop] = sorted(own, key=lambda i: self.rows[i, : self.size[i]].tobytes())
            shared, _ = self._shared(order, first)
        return order, shared


def repeated(left: Suffixes, right: Suffixes, first: np.ndarray, count: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(n, PLACES) booleans: whether the string with a context's mark at a place occurs twice. left: bytes before the
    marks, from there backwards; right: bytes from the marks on; weight: how often a context occurs; low, high: places asked for.

    Both sides are sorted. Contexts with equal strings are those that share enough bytes to the left and to the right,
    so two neighbours in the orders part the contexts of each place into classes, whose weights are added up."""
    out = np.zeros((len(first), PLACES), bool)
    low, high = np.maximum(low, LENGTH - right.size), np.minimum(high, left.size)
    sides = []
    for side in (left, right):
        order, shared = side.sort(first, count)
        most = np.zeros(len(order), np.int64)
        most[order] = np.maximum(shared, np.append(shared[1:], -1))  # with the nearest others
        sides.append((order, shared, np.where(weight > 1, 1 << 30, most)))
    (left_order, left_shared, left_most), (right_order, right_shared, right_most) = sides
    low, high = np.maximum(low, LENGTH - right_most), np.minimum(high, left_most)
    lone = (count == 1) & (weight > 1)
    at = np.arange(PLACES)
    out[lone] = (at >= low[lone, None]) & (at <= high[lone, None])
    open_ = np.flatnonzero((low <= high) & (count > 1))
    classes = [np.empty(len(first), np.int64) for _ in range(2)]
    for place in range(int(low[open_].min()), int(high[open_].max()) + 1) if len(open_) else ():
        x = open_[(low[open_] <= place) & (place <= high[open_])]
        if len(x):
            classes[0][left_order] = np.cumsum(left_shared < place)
            classes[1][right_order] = np.cumsum(right_shared < LENGTH - place)
            _, same = np.unique(classes[0][x] * (len(first) + 1) + classes[1][x], return_inverse=True)
            out[x, place] = np.bincount(same, weight[x])[same] > 1
    return out


def _matrices(ctx: pa.Array, before: np.ndarray) -> tuple[Suffixes, Suffixes]:
    """The bytes before the marks, backwards, and from the marks on."""
    data, ends = joined_bytes(ctx)
    mark = ends[:-1] + before
    back = data[np.maximum(mark[:, None] - 1 - np.arange(LEFT), 0)]
    on = data[np.minimum(mark[:, None] + np.arange(LENGTH), len(data) - 1)]
    return Suffixes(back, before), Suffixes(on, ends[1:] - mark)


_ID = ("gram", "h1", "h2")


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """gram, h1, h2, parts (spans relative to the mark): the contexts of groups (k1, k2) of bounded size, sorted within each."""

    def gathered(batches):
        held, n = [], 0
        for b in batches:
            k = np.stack([b.column(c).to_numpy() for c in ("k1", "k2")], 1)
            if held and n >= SORTED:  # what has ended goes; the last group may go on
                last = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("k1", "k2")]
                other = (k != last).any(1)
                cut = int(other.argmax()) if other.any() else len(k)
                held.append(b.slice(0, cut))
                if cut == len(k):
                    continue
                yield pa.Table.from_batches(held)
                b, held, n = b.slice(cut), [], 0
            held.append(b)
            n += b.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        small = (b.slice(i, SORTED) for b in batches for i in range(0, b.num_rows, SORTED))
        for table in gathered(small):
            t = table.combine_chunks()
            k = np.stack([t.column(c).to_numpy() for c in ("k1", "k2")], 1)
            heads = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
            group = np.cumsum(heads) - 1
            first = np.flatnonzero(heads)[group]
            count = np.bincount(group)[group]
            weight, before, low, high = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "before", "low", "high"))
            ctx = t.column("ctx").combine_chunks()
            left, right = _matrices(ctx.chunk(0) if isinstance(ctx, pa.ChunkedArray) else ctx, before)
            ok = repeated(left, right, first, count, weight, low, high)
            edge = np.zeros((len(ok), 1), bool)
            turns = np.diff(np.concatenate([edge, ok, edge], 1).astype(np.int8), axis=1)
            row, a = np.nonzero(turns == 1)
            z = np.nonzero(turns == -1)[1] - 1  # both in the order of rows and places
            hit = np.unique(row)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ok))[hit])])
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(-z, pa.int64()), pa.array(LENGTH - a, pa.int64())], names=["lo", "hi"]))
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[hit]) for c in _ID] + [parts], names=[*_ID, "parts"])

    return rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, "gram long, h1 long, h2 long, parts array<struct<lo:long,hi:long>>")


def _halved(rows: DataFrame) -> DataFrame:
    """The contexts of large groups, once for each half of their places that they can have, cut to the bytes that strings
    with such places cover and grouped anew (k1, k2) by the bytes that all of these share. up, up1, up2 name the whole context."""

    def run(batches):
        for b in batches:
            take, k, h, befores, parts, lows, highs = [], [], [], [], [], [], []
            for i, (before, ctx, low, high) in enumerate(zip(*[b.column(c).to_pylist() for c in ("before", "ctx", "low", "high")], strict=True)):
                mid = (low + high) // 2
                for lo, hi in ((low, mid), (mid + 1, high)):
                    if before >= lo and len(ctx) - before >= LENGTH - hi:
                        own = min(before, hi)
                        part = ctx[before - own : before + LENGTH - lo]
                        take.append(i)
                        k.append(xxhash.xxh3_128_digest(ctx[before - lo : before + LENGTH - hi], seed=lo * LENGTH + hi))
                        h.append(xxhash.xxh3_128_digest(part, seed=(lo * LENGTH + hi) * LENGTH + own))
                        befores.append(own)
                        parts.append(part)
                        lows.append(lo)
                        highs.append(hi)
            if take:
                at = pa.array(take, pa.int64())
                (k1, k2), (h1, h2) = _halves(k), _halves(h)
                up = {x: b.column(c).take(at) for x, c in (("up", "gram"), ("up1", "h1"), ("up2", "h2"), ("n", "n"))}
                yield pa.RecordBatch.from_pydict(up | {"gram": k1, "h1": h1, "h2": h2, "before": pa.array(befores, pa.int32()), "ctx": pa.array(parts, pa.binary()), "k1": k1, "k2": k2, "low": pa.array(lows, pa.int32()), "high": pa.array(highs, pa.int32())})

    return rows.mapInArrow(run, "up long, up1 long, up2 long, n long, gram long, h1 long, h2 long, before int, ctx binary, k1 long, k2 long, low int, high int")


def marked(texts: DataFrame) -> DataFrame:
    """gram, tid, pos, w: the marked suffixes of texts (tid, w, text), by the hash of the marked gram."""

    def run(batches):
        worker_state("")
        for b in batches:
            tid, w, row, pos, grams = b.column("tid"), b.column("w"), [], [], []
            for r, text in enumerate(b.column("text")):
                data = text.as_py().encode("utf-8")
                at = marks(np.frombuffer(data, np.uint8))
                row.append(np.full(len(at), r))
                pos.append(at)
                grams += [xxhash.xxh3_64_intdigest(data[i : i + GRAM]) for i in at.tolist()]
            rows = pa.array(np.concatenate(row) if row else [], pa.int64())
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.array(grams, np.uint64).view(np.int64)), "tid": tid.take(rows), "pos": pa.array(np.concatenate(pos) if pos else [], pa.int64()), "w": w.take(rows)})

    return texts.select("tid", "w", "text").mapInArrow(run, "gram long, tid long, pos long, w long")


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, h1, h2 (the context's name: hashes of its gram and of all of it), before, ctx, tid, pos, w: LEFT bytes at
    most before, and LENGTH at most from each place of wanted (tid, at: array of pos) on.

    A text of one letter has a mark at each place, and few different contexts: of one that comes
    again only the first two places carry its bytes and weight, which show that it is repeated."""

    def run(batches):
        out = [[] for _ in range(7)]
        for b in batches:
            for tid, w, text, at in zip(*[b.column(c) for c in ("tid", "w", "text", "at")], strict=True):
                tid, w, data, seen = tid.as_py(), w.as_py(), text.as_py().encode("utf-8"), {}
                for p in at.as_py():
                    before = min(p, LEFT)
                    ctx = data[p - before : p + LENGTH]
                    n = seen[before, ctx] = seen.get((before, ctx), 0) + 1
                    if len(seen) > SORTED:
                        seen.clear()
                    for x, v in zip(out, (xxhash.xxh3_64_intdigest(data[p : p + GRAM]), xxhash.xxh3_128_digest(ctx, seed=before), before, ctx if n < 3 else None, tid, p, w if n < 3 else 0), strict=True):
                        x.append(v)
                    if len(out[0]) >= 8_192:
                        yield made(out)
                        out = [[] for _ in range(7)]
        if out[0]:
            yield made(out)

    def made(out):
        gram, digest, before, ctx, tid, pos, w = out
        h1, h2 = _halves(digest)
        return pa.RecordBatch.from_pydict({"gram": pa.array(np.array(gram, np.uint64).view(np.int64)), "h1": h1, "h2": h2, "before": pa.array(before, pa.int32()), "ctx": pa.array(ctx, pa.binary()), "tid": pa.array(tid, pa.int64()), "pos": pa.array(pos, pa.int64()), "w": pa.array(w, pa.int64())})

    rows = texts.join(wanted, "tid").select("tid", "w", "text", "at")
    return rows.mapInArrow(run, "gram long, h1 long, h2 long, before int, ctx binary, tid long, pos long, w long")


def verdicts(found: DataFrame) -> Settled:
    """gram, h1, h2, parts: the repeated spans of each context that has any, relative to its mark. found: as from contexts.

    Groups of up to BUCKET contexts are sorted. Larger ones are halved by places: a half has less of each context, so
    that more of them are equal and count as one; with a single place left all of a group are. Verdicts then go back up."""
    rows = found.where("ctx is not null").groupBy(*_ID, "before", "ctx").agg(F.sum("w").alias("n"))
    rows = rows.select("*", F.col("gram").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    levels, halves = [], []
    while True:
        own = Settled(rows, f"contexts-{len(levels)}")
        large = Settled(own.df.where("low < high").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BUCKET).drop("m"), "large-groups", few=True)
        split = not large.df.isEmpty()
        levels.append(Settled(_sorted_groups(own.df.join(large.side(), ["k1", "k2"], "left_anti") if split else own.df), "sorted"))
        if split:
            halves.append(Settled(_halved(own.df.join(large.side(), ["k1", "k2"])), "halves"))
            rows = halves[-1].df.groupBy(*_ID, "before", "ctx", "k1", "k2", "low", "high").agg(F.sum("n").alias("n"))
        own.drop()
        large.drop()
        if not split:
            break
    out = levels.pop()
    while levels:
        half, below = halves.pop(), out
        risen = half.df.select("up", "up1", "up2", *_ID).join(below.side(), list(_ID)).select(F.col("up").alias("gram"), F.col("up1").alias("h1"), F.col("up2").alias("h2"), "parts")
        out = Settled(levels[-1].df.unionByName(risen).groupBy(*_ID).agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts")), "verdicts")
        for x in (half, below, levels.pop()):
            x.drop()
    return out


def repeats(texts: DataFrame) -> DataFrame:
    """tid, spans: for each of texts (tid, w, text: distinct ones with their number) that has any, the sorted spans (lo, hi)
    of strings of LENGTH bytes that also start elsewhere."""
    every = Settled(marked(texts), "marks")
    twice = Settled(every.df.groupBy("gram").agg(F.sum("w").alias("n")).where("n > 1").select("gram"), "grams")
    wanted = Settled(every.df.join(twice.side(), "gram").groupBy("tid").agg(F.collect_list("pos").alias("at")), "wanted")
    every.drop()
    twice.drop()
    found = Settled(contexts(texts, wanted.df), "contexts")
    wanted.drop()
    sure = verdicts(found.df)
    spans = found.df.select(*_ID, "tid", "pos").join(sure.side(), list(_ID)).select("tid", F.explode(F.transform("parts", lambda x: F.struct((F.col("pos") + x["lo"]).alias("lo"), (F.col("pos") + x["hi"]).alias("hi")))).alias("s"))
    out = Settled(spans.groupBy("tid").agg(F.sort_array(F.collect_set("s")).alias("spans")), "spans")
    found.drop()
    sure.drop()
    return out.df


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes if asked for.

    Removed is each byte inside a string of LENGTH bytes that also starts anywhere else in the input, in the same text
    or another, all copies included; what remains is joined. Texts are their UTF-8 bytes; strings never cross texts;
    null and empty texts, and those under LENGTH bytes, lose nothing. A removal may cut inside a character. Repeated
    rows are copies of each other. Other columns are not read.

    Equal texts are one text with a number, grouped by the text itself. Only marked suffixes (about one in 73) whose gram
    occurs twice are sorted; equal contexts are added up first, by their bytes. A group of suffixes beyond BUCKET is split
    by further bytes, which makes more of them equal, until it is small; no task gathers an unbounded group. Hashes deal rows
    out and name contexts (192 bits) and texts (SHA-256); what is equal is decided by bytes.
    """
    own = docs.select("doc_id", "text")
    long_ = F.octet_length("text") >= LENGTH
    texts = own.where(long_).groupBy("text").agg(F.count(F.lit(1)).alias("w")).select("text", "w", F.monotonically_increasing_id().alias("tid"))
    texts = Settled(texts, "texts")

    def run(batches):
        for b in batches:
            key, gone, runs, sha, kept = [], [], [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans"), strict=True):
                data = text.encode("utf-8")
                parts, end, n, cut = [], 0, 0, -1
                for s in spans.as_py():
                    lo, hi = s["lo"], s["hi"]
                    if lo > cut:  # a new run; touching ones are one
                        parts.append(data[end:lo])
                        n += 1
                        end = cut = hi
                    elif hi > cut:
                        end = cut = hi
                parts.append(data[end:])
                left = b"".join(parts)
                key.append(hashlib.sha256(data).hexdigest())
                gone.append(len(data) - len(left))
                runs.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = {"key": pa.array(key, pa.string()), "gone": pa.array(gone, pa.int64()), "runs": pa.array(runs, pa.int64()), "sha": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    cut = texts.df.join(repeats(texts.df), "tid").select("text", "spans").mapInArrow(run, "key string, gone long, runs long, sha string" + ", kept binary" * with_text)
    cut = Settled(cut, "cut-texts")
    texts.drop()
    data = F.coalesce("text", F.lit(""))
    rows = own.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("own"), *([F.encode(data, "UTF-8").alias("all")] if with_text else []))
    rows = rows.join(cut.side(), F.col("own") == F.col("key"), "left")
    out = rows.select("doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"), *([F.coalesce("kept", "all").alias("kept_bytes")] if with_text else []))
    return out
