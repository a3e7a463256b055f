"""Plain versions of the operators, for small inputs. Rows are (doc_id, text)."""

import hashlib
import re
from collections import Counter

BLANK = re.compile("[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def jaccard(rows):
    """[(n_shingles, component_id)] by row: all pairs."""
    sets = []
    for _, text in rows:
        w = BLANK.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def contamination(rows, items):
    """[(n_words, n_hit, n_items, items_sha256, contaminated)] by row."""
    windows = {}
    for k, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        if k is not None:
            for i in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    out = []
    for _, text in rows:
        w, hit, found = TERM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeats(rows, length=400):
    """[(n_bytes, n_removed, n_spans, kept_sha256)] by row: every string of length bytes counted."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = b"\x01" * length
        runs = sum(c and (not i or not cut[i - 1]) for i, c in enumerate(cut))
        out.append((len(d), sum(cut), runs, sha(bytes(b for b, c in zip(d, cut, strict=True) if not c))))
    return out


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = BLANK.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def likelihood(rows, trusted, buckets, prior, scale, threshold, bucket):
    """[kept] by row, with bucket(list of words) -> list of n-gram buckets for a text."""
    import math

    grams = [bucket(BLANK.findall(t or "")) for _, t in rows]
    raw, target = [1] * buckets, [0] * buckets
    for (k, _), g in zip(rows, grams, strict=True):
        for x in g:
            raw[x] += 1
            target[x] += k in trusted
    n_raw, n_target = sum(raw), sum(target)
    ratio = [round(scale * math.log((t + prior * r / n_raw) / (n_target + prior) / (r / n_raw))) if n_target else 0 for r, t in zip(raw, target, strict=True)]
    return [not base_rules(t)[5] and sum(ratio[x] for x in g) >= round(threshold * scale) * len(g) for (_, t), g in zip(rows, grams, strict=True)]


def lines(rows, chunks, reach):
    """[text] by row, rows in the order of their ids: later copies of chunks of lines go, with equal lines beside them."""
    seen, out = {}, []
    for _, text in rows:
        x = (text or "").split("\n")
        gone = set()
        for at, n in chunks(x):
            part = "\n".join(x[at : at + n])
            if part in seen:
                y, first = seen[part]
                gone |= set(range(at, at + n))
                for step, i, j in ((-1, at - 1, first - 1), (1, at + n, first + n)):
                    for _ in range(reach):
                        if not (0 <= i < len(x) and 0 <= j < len(y) and x[i] == y[j]):
                            break
                        gone.add(i)
                        i, j = i + step, j + step
            else:
                seen[part] = (x, at)
        out.append("\n".join(v for i, v in enumerate(x) if i not in gone) if gone else text)
    return out


def line_chunks(lines, widths, bits, least):
    """(first line, number of lines): for each width the xor of so many lines' hashes, each turned left by its distance from
    the last, says whether a place before them and a place after them is a boundary: if not all of its own bits are set."""
    import xxhash

    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in lines]
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) % 2**64
    out = set()
    for width in widths:
        at = {0, len(lines)}
        for i in range(len(lines) - width + 1):
            value = 0
            for k in range(width):
                value ^= turn(h[i + k], width - 1 - k)
            at |= {i} if value % 2**bits != 2**bits - 1 else set()
            at |= {i + width} if value // 2**bits % 2**bits != 2**bits - 1 else set()
        for a in at:
            ends = [b for b in at if b > a and sum(bool(x.strip()) for x in lines[a:b]) >= least]
            out |= {(a, min(ends) - a)} if ends else set()
    return sorted(out)


def byte_ngrams(data, gram):
    """The n-grams of 1 to gram bytes, and of marks of a word said again at once."""
    words = data.split()
    again = [int(a == b) for a, b in zip(words, words[1:])]
    return {("b", tuple(data[i : i + n])) for n in range(1, gram + 1) for i in range(len(data) - n + 1)} | {("w", tuple(again[i : i + n])) for n in range(1, gram + 1) for i in range(len(again) - n + 1)}


def convolve(net, text, length, widths):
    """Probabilities of a text by plain loops over windows, places and filters."""
    import numpy as np

    p, total, n = net.params, 0.0, max(1, -(-len(text) // length))
    data = text + bytes(n * length + 3 - len(text))
    for k in range(n):
        x = p["E"][list(data[k * length : k * length + length + 3])].astype(float)
        tops = [max(sum(float(x[t + j] @ p[f"W{w}"][j][:, f]) for j in range(w)) for t in range(length)) for w in widths for f in range(p[f"W{w}"].shape[2])]
        logits = np.maximum(np.array(tops) + p["b"], 0) @ p["V"] + p["c"]
        logits = logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        total = total + min(length, len(text) - k * length) * logits
    out = np.exp((total - total.max()) / max(1, len(text)))
    return out / out.sum()


def spelling(rows, least_length=6, least=5, damage=199, ratio=5):
    """{word: (form, root, n, n_near, form_n)}: all pairs. Rows are (doc_id, text)."""
    import zlib

    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            n[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in around.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(around[w]), n.get(form.get(w)))
    return out


def collocations(rows, words=3, least=10, inside=50, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)], sorted. Rows are (lang, text)."""
    f, size = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    found, longer = [], {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            found.append((lang, w, a, f[lang, *w[:k]], f[lang, *w[k:]], score))
            for s in range(2, len(w)):
                for i in range(len(w) - s + 1):
                    longer[lang, *w[i : i + s]] = max(a, longer.get((lang, *w[i : i + s]), 0))
    found = [x for x in found if 100 * longer.get((x[0], *x[1]), 0) < inside * x[2]]
    out = []
    for lang in size:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[5], -x[2], " ".join(x[1]).encode()))
        out += [(lang, i + 1, " ".join(w), a, left, right, size[lang], score) for i, (_, w, a, left, right, score) in enumerate(own[:top])]
    return sorted(out)


def likeness(a, b):
    """Of the different pieces of both texts' lines those that are in both equally often, as a part of all."""
    a, b = (Counter(p for line in (x or "").split("\n") for p in re.findall(r"[^.!?]{0,119}[.!?]|[^.!?]{1,120}", line)) for x in (a, b))
    n, differ = len(a) + len(b), sum(a[p] != b[p] for p in a | b)
    return max(0, n - differ) / max(1, n + differ)
