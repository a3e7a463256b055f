"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import uuid
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tunerline.llm.common import lean, worker_state

#: Entries of a worker's table of pre-tokens seen; beyond it the table starts anew, which bounds memory and changes no result.
CACHE = 800_000
#: Longer pre-tokens are merged each time and not kept.
CACHED_BYTES = 64


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals; O(n log n).

    The rank queue has a bucket of places for each rank, a heap, so that equal ranks come from left to right. Two levels
    of bits say which ranks have places: summary has a bit for each 256 ranks, words the bits of those. The lowest set
    bit of each level leads to the next rank. A place goes stale when a merge changes its pair; pair has the present rank.
    """
    get = ranks.get
    whole = get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    end = list(range(1, n + 1))  # the part that starts at i ends before end[i]: a linked list by start
    before = list(range(-1, n - 1))
    pair = [get(data[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    summary = 0
    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> 8
                words[w] = words.get(w, 0) | 1 << (r & 255)
                summary |= 1 << w
    while summary:
        low = summary & -summary
        w = low.bit_length() - 1
        bits = words[w]
        one = bits & -bits
        rank = (w << 8) + one.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) == 1:
            i = bucket[0]
            del buckets[rank]
            words[w] = bits = bits ^ one
            if not bits:
                summary ^= low
        else:
            i = heappop(bucket)
        if pair[i] != rank:
            continue
        j = end[i]
        k = end[j]
        end[i], pair[j] = k, -1
        h = before[i]
        if k < n:
            before[k] = i
            pair[i] = r = get(data[i : end[k]], -1)
        else:
            pair[i] = r = -1
        at = i
        while True:  # the pair that now starts at i, then the one that ends with it
            if r >= 0:
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    summary |= 1 << w
            if at == h or h < 0:
                break
            at = h
            pair[h] = r = get(data[h:k], -1)
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[data[i:j]])
        i = j
    return out


class _Seen(dict):
    """Pre-token -> its ids as text, filled as asked for; tokens: the bytes of an id, given as text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.tokens = ranks, {str(v): k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall

    def __missing__(self, text: str):
        data = text.encode("utf-8")
        made = " ".join(map(str, merge(data, self.ranks)))
        if len(data) <= CACHED_BYTES:
            self[text] = made
        return made


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and token_ids if asked for.

    Each match of pattern is encoded alone, without special tokens; the ids are then decoded again. The hashes are over
    the decimal ids joined by one space, and over the decoded bytes. A null text counts as empty: no tokens, hashes of
    nothing. Repeated rows and equal ids each give their row; no row is shuffled. Other columns of docs are not read.
    The vocabulary is broadcast; its size is that of the rank file, whatever the data's size.
    """
    lean(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), f"bpe:{uuid.uuid4().hex}"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        seen = worker_state(key, lambda: _Seen(*shared.value))
        sha, find, token = hashlib.sha256, seen.find, seen.tokens.__getitem__
        for b in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in b.column("text"):
                listed = " ".join([seen[t] for t in find(text.as_py() or "")])
                each = listed.split()
                n.append(len(each))
                ids_sha.append(sha(listed.encode()).hexdigest())
                text_sha.append(sha(b"".join(map(token, each))).hexdigest())  # decoded from the ids
                if with_ids:
                    ids.append(pa.array(list(map(int, each)), pa.int32()))
                if len(seen) > CACHE:
                    seen.clear()
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                offsets = [0]
                for a in ids:
                    offsets.append(offsets[-1] + len(a))
                cols["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Rows (doc_id, token_ids) -> (doc_id, text). Bytes that aren't UTF-8 become U+FFFD; null ids give a null text; an id outside the vocabulary is an error."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(ranks), dict(rows.dtypes)["doc_id"]

    def run(batches):
        tokens = {v: k for k, v in shared.value.items()}
        for b in batches:
            text = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(text, pa.string())})

    return rows.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")
