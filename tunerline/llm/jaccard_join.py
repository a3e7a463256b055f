"""N-gram Jaccard join: size-banded tiles of documents that share a rare shingle, bitmaps that bound overlaps, exact intersections of sorted arrays, checked word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunerline.llm.common import Settled, joined_bytes, unused, worker_state
from tunerline.llm.components import components

#: Words of a shingle.
WORDS = 5
#: Least similarity, as a ratio of whole numbers: NUM * union <= DEN * intersection.
NUM, DEN = 4, 5
#: Bits of the bitmap that every document has; candidates get one of WIDE bits or more for each shingle, up to MOST_BITS.
BITS = 1024
WIDE, MOST_BITS = 4, 1 << 18
#: The shingles counted as frequent: at most so many, the most frequent ones. They come last in the order of prefixes,
#: which only saves work; every order gives the same links. Shingles are counted by portions of so many.
FREQUENT, PORTION = 100_000, 1 << 21
#: Tasks among which the rows of a frequent shingle are dealt.
SALTS = 64
#: Ratio of sizes that have a leader in common.
BAND = 1.1
#: Documents of a tile.
TILE = 4_096
#: Bytes whose words are hashed at once; words from LONG bytes on are hashed one by one.
BLOCK, LONG = 1 << 18, 1_024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOW = np.frombuffer(_LOWER, np.uint8)
_BLANK = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_ALL = (1 << 64) - 1
#: Two sets of random odd factors for the bytes of a word by their place, and for the words of a shingle by theirs.
_BYTES = np.random.default_rng(41).integers(0, 1 << 63, (2, LONG), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(43).integers(0, 1 << 63, (2, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(2, n) hashes of words: sums of bytes times the factor of their place in the word."""
    out, i = np.zeros((2, len(starts)), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        if j > i + 1 or ends[i] - lo < LONG:
            part = low[lo : ends[j - 1]]
            value = part.astype(np.uint64) + np.uint64(1)
            value[_BLANK[part]] = 0
            s = starts[i:j] - lo
            at = np.arange(len(part)) - np.repeat(s, np.diff(np.append(s, len(part))))
            np.minimum(at, LONG - 1, out=at)
            for k in range(2):
                out[k, i:j] = np.add.reduceat(value * _BYTES[k][at], s)
        i = j
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        x = xxhash.xxh3_128_intdigest(low[starts[i] : ends[i]].tobytes())
        out[:, i] = x & _ALL, x >> 64
    return _mix(out)


class Words:
    """The words of some texts that lie side by side in low (lower-cased bytes), with two hashes of each shingle."""

    def __init__(self, low: np.ndarray, bounds: np.ndarray):
        """bounds: where each text starts, and the end of the last."""
        self.low = low
        blank, edge = _BLANK[low], np.zeros(len(low) + 1, bool)
        edge[bounds] = True
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1] | edge[1:-1]
        last[:-1] &= blank[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hashes = _word_hashes(low, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, bounds)
        self.shingles = self._combined(0, len(self.starts), WORDS)

    def _combined(self, a: int, b: int, width: int) -> np.ndarray:
        out = np.full((2, max(0, b - a - width + 1)), width, np.uint64)
        for k in range(width if out.size else 0):
            out += self.hashes[:, a + k : b - width + 1 + k] * _PLACES[:, k : k + 1]
        return _mix(out)

    def width(self, text: int) -> int:
        """Words of the text's shingles: WORDS, or all that it has if these are fewer."""
        return min(WORDS, int(self.at[text + 1] - self.at[text]))

    def raw(self, text: int) -> np.ndarray:
        """(2, n) hashes of the text's shingles in their order."""
        a, b = self.at[text], self.at[text + 1]
        return self.shingles[:, a : b - WORDS + 1] if b - a >= WORDS else self._combined(a, b, b - a) if b > a else self.shingles[:, :0]

    def words(self, text: int, numbers: dict[bytes, int]) -> np.ndarray:
        """The words of a shingle of each place, as numbers that are equal for equal words."""
        a, b = self.at[text], self.at[text + 1]
        words = self.low[self.starts[a] : self.ends[b - 1]].tobytes().split()
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        return np.lib.stride_tricks.sliding_window_view(ids, self.width(text))

    def distinct(self, text: int) -> np.ndarray:
        """Where the distinct shingles start (the first of equal ones), by their first hash. What is distinct is decided by the words: two shingles of one hash both stay."""
        h = self.raw(text)[0]
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            return order
        words = self.words(text, {})
        if (words[order[1:][same]] == words[order[:-1][same]]).all():
            return order[np.concatenate([[True], ~same])]
        seen: set[bytes] = set()
        return order[np.array([not (t in seen or seen.add(t)) for t in (words[i].tobytes() for i in order.tolist())])]

    def set(self, text: int) -> tuple[np.ndarray, bytes]:
        """Ascending 64-bit hashes, one for each distinct shingle of a text, and 128 bits that stand for the set, made of 128 bits of each shingle."""
        h, g = self.raw(text)
        s = np.sort(h)
        if (s[1:] == s[:-1]).any():
            at = self.distinct(text)
            s, g = h[at], g[at]
        return s, xxhash.xxh3_128_digest(s.tobytes() + g.sum(dtype=np.uint64).tobytes())


def shingled(column: pa.Array):
    """Of each text of an Arrow column the distinct shingles' hashes and the 128 bits of the set (Words.set); null texts have none."""
    data, ends = joined_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        w = Words(_LOW[data[ends[i] : ends[j]]], ends[i : j + 1] - ends[i])
        for k in range(j - i):
            yield w.set(k)
        i = j


def overlap(one: bytes, other: bytes) -> tuple[int, int, int]:
    """Shingles of two texts, and how many both have: sorted arrays of hashes are intersected, then the words are compared."""
    w = Words(_LOW[np.frombuffer(one + other, np.uint8)], np.array([0, len(one), len(one) + len(other)]))
    (a, b), (hx, hy) = (w.distinct(0), w.distinct(1)), (w.raw(0)[0], w.raw(1)[0])
    if w.width(0) != w.width(1) or not w.width(0):
        return len(a), len(b), 0
    hx, hy = hx[a], hy[b]
    plain = not ((hx[1:] == hx[:-1]).any() or (hy[1:] == hy[:-1]).any())
    numbers: dict[bytes, int] = {}
    x, y = w.words(0, numbers), w.words(1, numbers)
    if plain:
        _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
        plain, both = bool((x[a[i]] == y[b[j]]).all()), len(i)
    if not plain:  # a hash stands for two shingles
        both = len({x[p].tobytes() for p in a.tolist()} & {y[q].tobytes() for q in b.tolist()})
    return len(a), len(b), both


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "big", signed=True)


def bitmap(hashes: np.ndarray, size: int = BITS) -> bytes:
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def wide_bitmap(hashes: np.ndarray) -> bytes:
    """The least power of two bits that is WIDE for each shingle."""
    return bitmap(hashes, min(MOST_BITS, 1 << max(6, (WIDE * len(hashes) - 1).bit_length())))


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (shingles), node and check (128-bit digest of the set), bits (bitmap), and frequent: now and
    then the shingles found twice or more in a portion (array of h, n)."""
    kind = dict(docs.dtypes)["doc_id"]

    def count(portion):
        h, n = np.unique(np.concatenate(portion), return_counts=True)
        keep = n > 1
        return [{"h": a, "n": b} for a, b in zip(h[keep].view(np.int64).tolist(), n[keep].tolist(), strict=True)]

    def run(batches):
        worker_state("")
        portion, held = [], 0
        for b in batches:
            n, node, check, bits, frequent = [], [], [], [], []
            for h, x in shingled(b.column("text")):
                n.append(len(h))
                node.append(_node(x))
                check.append(int.from_bytes(x[8:], "big", signed=True))
                bits.append(bitmap(h))
                frequent.append(None)
                portion.append(h)
                held += len(h)
                if held > PORTION:
                    frequent[-1], portion, held = count(portion), [], 0
            if portion and n:
                frequent[-1], portion, held = (frequent[-1] or []) + count(portion), [], 0
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "check": pa.array(check, pa.int64()), "bits": pa.array(bits, pa.binary()), "frequent": pa.array(frequent, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))})

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node long, check long, bits binary, frequent array<struct<h:long,n:long>>")


def named_apart(classes: DataFrame) -> dict[tuple[int, int], int]:
    """(node, check) -> another node, for classes that share the 64 bits of node with another; none share it afterwards.

    Nodes are as good as random, so of N classes about N * N / 2**64 are concerned: some hundred of 5e10."""
    own: dict[tuple[int, int], int] = {}
    turn = 0
    while True:
        turn += 1
        now = classes.select("node", "check", _renamed(own)) if own else classes.select("node", "check", F.col("node").alias("now"))
        twice = now.join(now.groupBy("now").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("now"), "now").select("node", "check").collect()
        if not twice:
            return own
        for r in twice:
            own[r["node"], r["check"]] = xxhash.xxh3_64_intdigest(f"{r['node']},{r['check']}", seed=turn) - (1 << 63)


def _renamed(own: dict[tuple[int, int], int]):
    """The column now: node, or the other node of named_apart."""
    out = F.col("node")
    for (node, check), other in own.items():
        out = F.when((F.col("node") == node) & (F.col("check") == check), F.lit(other)).otherwise(out)
    return out.alias("now")


def prefixes(docs: DataFrame, frequent: np.ndarray, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """h, node, n, hot (whether h is among the frequent): for each document the rarest shingles, so many that any set similar enough has one of them among its own.

    A set of n needs an overlap of ceil(NUM * n / DEN), so n minus that, plus one, first shingles do. Copies within a
    partition are given once."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, renamed))

    def run(batches):
        worker_state("")
        order, other = shared.value  # most frequent first
        by_hash = np.argsort(order, kind="stable")
        known = order[by_hash]
        seen: set[bytes] = set()
        for b in batches:
            hs, nodes, ns, hot = [], [], [], []
            for h, x in shingled(b.column("text")):
                if not len(h) or x in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(x)
                node = _node(x)
                if other:
                    node = other.get((node, int.from_bytes(x[8:], "big", signed=True)), node)
                n = len(h)
                k = n - -(-NUM * n // DEN) + 1
                many = n
                if len(known):
                    at = np.searchsorted(known, h)
                    at[at == len(known)] = 0
                    common = known[at] == h
                    rare = h[~common]
                    many = len(rare)
                    if many < k:
                        late = h[common][np.argsort(-by_hash[at[common]], kind="stable")]
                        rare = np.concatenate([rare, late])
                    h = rare
                hs.append(h[:k])
                hot.append(np.arange(k) >= many)
                nodes.append(np.full(k, node, np.int64))
                ns.append(np.full(k, n, np.int64))
            if hs:
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(hs).view(np.int64)), "node": pa.array(np.concatenate(nodes)), "n": pa.array(np.concatenate(ns)), "hot": pa.array(np.concatenate(hot))})

    return docs.select("text").mapInArrow(run, "h long, node long, n long, hot boolean")


def shared_prefixes(prefix: DataFrame) -> DataFrame:
    """h, node, n: the rows whose shingle another row has too, and all of hot shingles, which are dealt into SALTS tasks
    each. Rows of a shingle pass by in order; none is gathered."""

    def run(batches):
        last, first = None, None  # the last row so far, and whether it is the first of its shingle
        for b in batches:
            t = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "node", "n", "hot")]
            if last is not None:
                t = [np.concatenate([x, y]) for x, y in zip(last, t, strict=True)]
            if not len(t[0]):
                continue
            same = t[0][1:] == t[0][:-1]
            keep = t[3].copy()
            keep[:-1] |= same
            keep[1:] |= same
            if last is not None and not first:
                keep[0] = True
            first = not bool(keep[-1])
            last = [x[-1:] for x in t]
            out = keep[:-1]
            yield pa.RecordBatch.from_pydict({c: pa.array(x[:-1][out]) for c, x in zip(("h", "node", "n"), t)})
        if last is not None and not first:
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("h", "node", "n"), last)})

    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = prefix.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h").select("h", "node", "n", "hot")
    return dealt.mapInArrow(run, "h long, node long, n long").distinct()


def leaders(shared: DataFrame) -> DataFrame:
    """a, b: each document with the leaders of its tiles, those of its own size (by powers of BAND) and of the sizes next
    to it. A leader is the document with the least share of prefix shingles that nobody else has: what others were copied from."""
    own = shared.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    own = own.select("node", (F.col("c") / (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).alias("shared"))
    rows = shared.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int"))
    lead = rows.join(Settled(own, "shares").side(), "node").groupBy("h", "band").agg(F.max_by("node", F.struct("shared", "node")).alias("lead"))
    near = lead.select("h", "lead", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = rows.select("h", "node", "band").join(near, ["h", "band"]).where("node <> lead")
    return pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _bound(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether the bitmaps (rows of uint64) allow an overlap that is enough: shingles that only one set has leave bits that only one bitmap has."""
    apart = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    overlap = (nx + ny - apart) // 2
    return DEN * overlap >= NUM * (nx + ny - overlap)


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of size bytes out of a larger one: hashes keep their low bits."""
    return np.bitwise_or.reduce(x.reshape(-1, size), 0)


def bounded(pairs: DataFrame) -> DataFrame:
    """a, b: the pairs (a, b, na, nb, xa, xb: sizes and bitmaps) that the bitmaps don't rule out."""

    def run(batches):
        for b in batches:
            ok = []
            for na, nb, x, y in zip(*[b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                ok.append(bool(_bound(_fold(x, size), _fold(y, size), na, nb)))
            yield pa.RecordBatch.from_pydict({c: b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def tiles(rows: DataFrame) -> DataFrame:
    """a, b: pairs of different components within the tiles that the bitmaps don't rule out. rows: h, tile (a band of
    sizes), s, t (parts of a tile), sub (s or t), home (whether the tile is of the document's own band), node, n, comp,
    bits. In a tile of two parts only pairs across them are compared; two guests meet in another tile."""

    def whole(batches):
        key, held = None, []
        for b in batches:
            k = list(zip(*[b.column(c).to_pylist() for c in ("h", "tile", "s", "t")], strict=True))
            i = 0
            while i < len(k):
                j = i
                while j < len(k) and k[j] == k[i]:
                    j += 1
                if k[i] != key:
                    if held:
                        yield key, pa.Table.from_batches(held)
                    key, held = k[i], []
                held.append(b.slice(i, j - i))
                i = j
        if held:
            yield key, pa.Table.from_batches(held)

    def run(batches):
        a = set()
        for (_, _, s, t), table in whole(batches):
            n, comp, node, sub, home = (table.column(c).to_numpy() for c in ("n", "comp", "node", "sub", "home"))
            bits = _words(table.column("bits"))
            for i in range(len(n)):
                ok = (n[i + 1 :] * NUM <= n[i] * DEN) & (n[i] * NUM <= n[i + 1 :] * DEN) & (comp[i + 1 :] != comp[i])
                if not home[i]:
                    ok &= home[i + 1 :]
                if s != t:
                    ok &= sub[i + 1 :] != sub[i]
                at = np.flatnonzero(ok) + i + 1
                if len(at):
                    at = at[_bound(bits[at], bits[i], n[at], n[i])]
                    a.update((min(x, int(node[i])), max(x, int(node[i]))) for x in node[at].tolist())
                if len(a) > 100_000:
                    yield out(a)
                    a = set()
        yield out(a)

    def out(a):
        rows = sorted(a)
        return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in rows], pa.int64()), "b": pa.array([x[1] for x in rows], pa.int64())})

    keys = ("h", "tile", "s", "t")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _made(docs: DataFrame, nodes: DataFrame, what: str, make) -> DataFrame:
    """node, n and what: size and make(text, hashes) of the named documents (nodes: node, __d, __h)."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            node, n, made = [], [], []
            for k, t, (h, _) in zip(b.column("node").to_pylist(), b.column("text"), shingled(b.column("text")), strict=True):
                if k not in seen:  # else a repeated row
                    seen.add(k)
                    node.append(k)
                    n.append(len(h))
                    made.append(make(t, h))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), what: pa.array(made, pa.binary())})

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(nodes, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))).select("node", "text")
    return rows.mapInArrow(run, f"node long, n long, {what} binary")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> Settled:
    """a, b: the pairs that are similar enough. Only documents in pairs are hashed again: first for wide bitmaps, which
    rule out most pairs, then the texts of what is left meet, whose sorted arrays are intersected and compared by words."""

    def named(p: Settled) -> Settled:
        nodes = p.df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return Settled(nodes.join(classes.select("node", F.col("rep.doc_id").alias("__d"), F.col("rep.text_hash").alias("__h")), "node"), "candidate-nodes", few=True)

    pairs = Settled(pairs.distinct(), "candidates", few=True)
    nodes = named(pairs)
    bits = Settled(_made(docs, nodes.side(), "wide", lambda t, h: wide_bitmap(h)), "wide-bitmaps")
    narrow = lambda p: bits.df.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("wide").alias(f"x{p}"))
    close = Settled(bounded(narrow("a").join(pairs.side(), "a").join(narrow("b"), "b")).distinct(), "close-pairs", few=True)
    for x in (nodes, bits, pairs):
        x.drop()
    nodes = named(close)
    texts = Settled(_made(docs, nodes.side(), "text", lambda t, h: t.as_py().encode("utf-8")), "pair-texts")
    nodes.drop()

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                nx, ny, both = overlap(x.as_py(), y.as_py())
                ok.append(DEN * both >= NUM * (nx + ny - both))
            yield pa.RecordBatch.from_pydict({c: b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")})

    side = lambda p, x: texts.df.select(F.col("node").alias(p), F.col("text").alias(x))
    full = side("a", "x").join(close.side(), "a").join(side("b", "y").join(close.side().select("b").distinct(), "b", "left_semi"), "b")
    out = Settled(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links", few=True)
    close.drop()
    texts.drop()
    return out


def join(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, class_size, text_hash, component.

    Documents link when their sets of shingles have DEN * intersection >= NUM * union; component_id is the smallest
    doc_id (nulls aside) that links reach, component a number of its own for each component (null without shingles), class_size the number of documents with the very same set. Texts without a
    word, null ones too, have no shingles and link with nothing; they are their own component. Texts of fewer words
    have one shingle. Repeated rows are copies of each other. Other columns of docs are not read.

    Copies become one node. A shingle that nodes share in their prefixes makes tiles, one for each band of sizes that can
    link with one another. First each node is compared with leaders of like size, which joins large groups of near copies
    by about as many comparisons as they have members. Then all pairs across what is still apart are compared within
    tiles; large tiles are split by a hash of the node and each pair of parts is a task, so no frequent shingle gathers
    in one. Bitmaps rule out most pairs, small ones in the tiles and wide ones after, before the exact intersection.
    Hashes of 64 bits only find candidates: what is distinct in a text, and what two texts share, is compared word by
    word. Equal sets are told by 128 bits of each shingle.
    """
    own = Settled(sets(docs), "sets")
    classes = own.df.where("n > 0").groupBy("node", "check").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("class_size"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    classes = Settled(classes, "classes")
    renamed = named_apart(classes.df)
    if renamed:
        for x in (own, classes):
            x.df = x.df.withColumn("node", _renamed(renamed))
    heavy = own.df.where("frequent is not null").select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n").alias("n")).where("n > 8")
    heavy = np.array([r["h"] for r in heavy.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    shared = Settled(shared_prefixes(prefixes(docs, heavy, renamed)), "shared-prefixes")
    tried = Settled(leaders(shared.df), "leader-pairs", few=True)
    bits = lambda p: classes.df.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("bits").alias(f"x{p}"))
    links = verified(docs, bounded(bits("a").join(tried.side(), "a").join(bits("b"), "b")), classes.df)
    comps = components(links.df)
    label = shared.df.join(comps.side(), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    label = Settled(label, "labelled")
    # a document is at home in its own band and a guest in the one above: sets that link differ in size by DEN / NUM at most
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")
    placed = label.df.withColumn("place", F.explode(F.array(F.struct(band.alias("tile"), F.lit(True).alias("home")), F.struct((band + 1).alias("tile"), F.lit(False).alias("home"))))).select("h", "node", "n", "comp", "place.tile", "place.home")
    # tiles of two are open too, if their sizes allow a link: leaders have tried those of like size only
    # shingles with the same members, as those of a passage have, make one tile: they are told by hashes of the members
    mark = F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"), F.sum(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 32))).alias("x3")
    open_ = placed.groupBy("h", "tile").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("some"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("n1"), F.max("n").alias("n2"), *mark).where(f"some and c1 <> c2 and (m > 2 or n2 * {NUM} <= n1 * {DEN})")
    open_ = open_.groupBy("tile", "m", "n1", "n2", "x1", "x2", "x3").agg(F.min("h").alias("h")).select("h", "tile", F.ceil(F.col("m") / TILE).cast("int").alias("parts"))
    rows = placed.join(Settled(open_, "open-tiles", few=True).side(), ["h", "tile"]).join(classes.df.select("node", "bits"), "node")
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("node", "h"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("h", "tile", F.least("sub", "other").alias("s"), F.greatest("sub", "other").alias("t"), "sub", "home", "node", "n", "comp", "bits")
    more = verified(docs, tiles(rows).distinct().join(tried.side(), ["a", "b"], "left_anti"), classes.df)
    if not more.df.isEmpty():  # join the components that the new links connect
        first, side = comps, comps.side()
        bridge = more.df.join(side.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(side.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        merged = components(bridge.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        moved = merged.side().select("node", F.col("comp").alias("next"))
        old = first.df.join(moved.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
        fresh = merged.df.join(first.df.select("node"), "node", "left_anti")
        comps = Settled(old.unionByName(fresh), "joined-components", few=True)
        first.drop()
        merged.drop()
    label = classes.df.select("node", "check", "class_size", "least").join(comps.side(), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    label = Settled(label, "class-components")
    least = Settled(label.df.groupBy("comp").agg(F.min("least").alias("component_id")), "component-ids", few=True)
    final = Settled(label.df.join(least.side(), "comp").select("node", "check", "class_size", "component_id", F.col("comp").alias("component")), "class-ids")
    rows = own.df.select("doc_id", "text_hash", "n", "node", "check").join(final.side(), ["node", "check"], "left")
    for x in (classes, shared, tried, label, least, links, more, comps):
        x.drop()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "text_hash", "component")


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay, of found = join(docs): of each component one row, that of the smallest doc_id (null
    last), then of the least hash of the text; all rows without shingles. Of rows that repeat in id and text one stays;
    which one isn't defined where they differ in further columns."""
    d, h, k = unused(docs, "__d", "__h", "__k")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(place).alias("p"))
    first = first.select(F.col("p.doc_id").alias(d), F.col("p.text_hash").alias(h))
    none = found.where("component is null").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    kept = Settled(first.unionByName(none).distinct(), "kept")
    again = found.where("component is not null").groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).count().where("count > 1").drop("count")
    again = Settled(again, "repeated-rows", few=True)
    rows = docs.withColumn(k, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(k) == F.col(h))
    rows = rows.join(kept.side(), same, "left_semi")
    if again.df.isEmpty():
        return rows.drop(k)
    one = rows.join(again.side(), same, "left_semi").groupBy("doc_id", k).agg(F.first(F.struct(*docs.columns)).alias(d)).select(f"{d}.*")
    return rows.join(again.side(), same, "left_anti").drop(k).unionByName(one)
