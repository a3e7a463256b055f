"""Spelling variants, collocations and fingerprints against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tunerline.llm import collocations, fingerprints, spelling

DOCS = "doc_id long, text string, lang string, n long, word string, id long, block int, own string, h long, phrase string"
MORE = (1, "x", 2, 3, "y", 4, "z")


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, *MORE) for k, t, lang in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def words():
    """Families of words around roots, one letter apart, in texts of every kind; many occurrences, ties, runs cut by digits."""
    rng = random.Random(11)
    letters, vocabulary = "abcdéÀz×", []
    for _ in range(40):
        root = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        vocabulary += [root] * rng.choice([1, 8, 60])
        for _ in range(6):
            i = rng.randrange(len(root))
            vocabulary += [rng.choice([root[:i] + root[i + 1 :], root[:i] + rng.choice(letters) + root[i:], root[:i] + rng.choice(letters) + root[i + 1 :]])] * rng.choice([1, 1, 5])
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(120)]
    texts += [None, "", " ", "aaaaaa aaaaaaa aaaaa", "AAAAAA aaaaaab1aaaaab-aaaaab", "aaaaab " * 30, "日本語のテキスト", "ß" * 7, "x" * 3000]
    long_ = "".join(rng.choice(letters) for _ in range(200))  # words whose keys are hashes
    for w in (long_, long_[:50] + "y" + long_[51:], long_[:90] + long_[91:], "q" + long_[:63], long_[:63], long_[:64], long_[:65], long_[:63] + "y"):
        texts += [w + " " + w] * 3
    texts += [long_] * 40
    return [(i if i != 5 else None, t, None) for i, t in enumerate(texts)] + [(9, texts[9], None)] * 3


def _spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling(spark, words, monkeypatch):
    docs, want = _docs(spark, words), brute.spelling([(k, t) for k, t, _ in words])
    assert _spelled(spelling.group(docs)) == want
    assert sum(bool(x[0]) for x in want.values()) > 5 and any(len(w) > 66 and x[0] for w, x in want.items())
    monkeypatch.setattr(spelling, "HELD", 2)
    monkeypatch.setattr(spelling, "BATCH", 3)
    assert _spelled(spelling.group(docs)) == want
    assert spelling.group(docs.limit(0)).collect() == [] and spelling.group(docs.where("text is null")).collect() == []


def test_spelling_roots_over_many_steps(spark):
    """Each word five times as often as the one before and one letter apart: one root for all."""
    texts = [(i, " ".join(["b" * k + "aaaaaaa"[k:]] * (5 ** (k + 1))), None) for i, k in enumerate(range(6))]
    got = _spelled(spelling.group(_docs(spark, texts)))
    assert got == brute.spelling([(k, t) for k, t, _ in texts])
    assert len({x[1] for x in got.values()}) <= 2  # but for words of lost letters


def test_names_of_long_words_agree():
    rng = random.Random(3)
    for n in (spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, 200):
        w = "".join(rng.choice("ab") for _ in range(n))
        names = list(spelling.deletions(w))
        assert names == [next(spelling.own_name(x)) for x in dict.fromkeys(w[:i] + w[i + 1 :] for i in range(n))]
        v = w[:40] + "c" + w[41:]
        assert len(set(spelling.wildcards(w)) & set(spelling.wildcards(v))) == 1 and len(set(spelling.wildcards(w))) == n


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(12)
    vocabulary = ["New", "york", "city", "of", "the", "é", "日本", "\x00", "-", "A", "b\x0bc"]
    texts = []
    for i in range(90):
        w = []
        for _ in range(rng.randint(0, 150)):
            w += ["new", "York", "CITY"] if rng.random() < 0.1 else [rng.choice(vocabulary)]
            w[-1] += rng.choice(["", "", "", "", ".", ",", "\n", "?!", "\t"])
        texts.append((i, " ".join(w), ["en", "fr", None, "und", ""][i % 5]))
    return texts + [(200, None, "en"), (201, "", "xx"), (202, " \t ", None), (None, "of the of the " * 50, "de"), (3, texts[3][1], texts[3][2]), (204, "w" * 5000 + " of the", "en"), (205, "a b a b a b " * 2000, "en")]


def _mined(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations(spark, phrases, monkeypatch):
    docs, rows = _docs(spark, phrases), [(lang, t) for _, t, lang in phrases]
    want = brute.collocations(rows)
    assert _mined(collocations.mine(docs)) == want and len(want) > 100
    for words, least, top in ((2, 3, 7), (5, 4, 2000)):
        assert _mined(collocations.mine(docs, words, least, top)) == brute.collocations(rows, words, least, top=top)
    monkeypatch.setattr(collocations, "SHARD", 50)  # texts of several shards too
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr(collocations, "BATCH", 7)
    assert _mined(collocations.mine(docs)) == want
    assert collocations.mine(docs.limit(0)).collect() == [] and collocations.mine(docs.where("text is null")).collect() == []


def test_full_filter_changes_nothing(spark, phrases, monkeypatch):
    """All bits are set: no phrase is ruled out before it is counted."""
    monkeypatch.setattr(collocations, "pair_filter", lambda pairs: spark.sparkContext.broadcast(np.full(collocations.FILTER_BITS >> 6, (1 << 64) - 1, np.uint64)))
    assert _mined(collocations.mine(_docs(spark, phrases))) == brute.collocations([(lang, t) for _, t, lang in phrases])


def test_scores_are_exact(spark):
    """Counts whose products pass 64 and 100 bits."""
    a, left, right = 10**15 - 11, 10**15 - 3, 10**15 - 1
    rows = [("en", "x y", a, 2), ("en", "x", left, 1), ("en", "y", right, 1), ("en", "y x", 3 * 10**9, 2)]
    got = {r["phrase"]: r["score"] for r in collocations.score(spark.createDataFrame(rows, "lang string, phrase string, n long, words int")).collect()}
    assert got == {"x y": 10**6 * a * a // (left * right), "y x": 10**6 * 9 * 10**18 // (left * right)}


@pytest.mark.parametrize("most", [1, 2, 3, 5, 8])
def test_suffix_array(most):
    rng = random.Random(most)
    for _ in range(30):
        ids = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 60))] + [0], np.int32)
        tail = lambda i: [x for x in ids[i : i + list(ids[i:]).index(0)].tolist()][:most]
        order = collocations.suffix_array(ids, most)
        assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()
        width = 1 << (most - 1).bit_length()
        full = lambda i: ids[i : i + list(ids[i:]).index(0)].tolist()[:width]
        assert [full(i) for i in order] == sorted(full(i) for i in order)
        lcp = collocations.common(ids, order, most).tolist()
        for x, y, n in zip(order, order[1:], lcp[1:]):
            a, b = tail(x), tail(y)
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    line = lambda: " ".join(rng.choice(["ka.", "lo", "mé!", "ti", "Ru?", "日本"]) for _ in range(rng.randint(1, 30)))
    out = [None, "", "\n", "a", "ab", "abcd", "abcde", "é" * 9, "x" * 3000, "spam.\n" * 500, "b\na", "a\nb"]
    out += ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [(100 - i if i != 20 else None, t, "en") for i, t in enumerate(out)] + [(40, out[60], "en")]


@pytest.mark.parametrize("wide", [1, 3, 1 << 16])
def test_edited_texts(spark, texts, monkeypatch, wide):
    monkeypatch.setattr(fingerprints, "MOST_BLOCKS", wide)
    own = sorted(((k is not None, k, t or "") for k, t, _ in texts), key=lambda x: (x[0], x[1] or 0))
    want = []
    for i, (_, k, t) in enumerate(own):
        follows, n = own[(i + 1) % len(own)][2], len(t) // 4
        edited = t[: len(t) - n] + follows[:n]
        want.append((k, len(t), brute.sha(edited), brute.likeness(t, edited), brute.likeness(t, follows), t == edited, t == follows))
    got = sorted(fingerprints.judge(_docs(spark, texts)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    if [r for r in got if r["doc_id"] == 40][0]["edited_sha256"] != [x for x in want if x[0] == 40][0][2]:  # two rows of one id, in the order of their hashes
        got = got[:-1]
    for r in got:
        options = [x for x in want if x[0] == r["doc_id"]]
        if r["doc_id"] in (39, 40):
            continue
        (x,) = options
        assert (r["n_chars"], r["edited_sha256"]) == x[1:3]
        assert abs(r["near_edited"] - x[3]) < 0.25 and abs(r["near_next"] - x[4]) < 0.25 or x[5] or x[6] or not r["n_chars"]
        assert not x[5] or r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprints.judge(_docs(spark, texts).limit(0)).collect() == []
    (one,) = fingerprints.judge(_docs(spark, texts[:11]).where("text = 'abcde'")).collect()
    assert one["near_next"] == 1 and one["edited_sha256"] == brute.sha("abcda")


def test_fingerprints_add_up(spark):
    """Order doesn't matter; paragraphs come and go; what differs differs."""
    rng = random.Random(14)
    rows = []
    for _ in range(30):
        lines = ["".join(rng.choice("ab. ") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(2, 30))]
        k = rng.randrange(1, len(lines))
        turned = lines[k:] + lines[:k]
        rows.append(("\n".join(lines), "\n".join(turned), "\n".join(lines[:k]), "\n".join(lines[k:]), "\n".join([*lines[:-1], lines[-1] + "!"])))
    rows = [r for r in rows if all(r)]
    own = lambda c: fingerprints.fingerprint(F.col(c))
    df = spark.createDataFrame(rows, "t string, turned string, head string, tail string, other string")
    for r in df.select(
        own("t").alias("t"), own("turned").alias("turned"), own("other").alias("other"), own("head").alias("head"), fingerprints.insert(own("head"), own("tail")).alias("whole"),
        fingerprints.delete(own("t"), own("tail")).alias("less"), fingerprints.written(own("t")).alias("text"), fingerprints.written(own("other")).alias("other_text"), fingerprints.likeness(own("t"), own("turned")).alias("same"),
    ).collect():
        assert r["t"] == r["turned"] == r["whole"] and r["head"] == r["less"] and r["other"] != r["t"] and r["same"] == 1
        assert r["text"] != r["other_text"] and set(r["text"]) <= set("0123456789abcdef") and len(r["text"]) == 16 + 8 * fingerprints.WIDE + 7 * len(r["t"]["lanes"])


def test_boundaries_decide_what_lines_go(spark, monkeypatch):
    """Passages of 2 to 9 lines in other surroundings: without the boundaries none goes; with fewer, fewer do; never a line that didn't come before."""
    from tunerline.llm import line_dedup

    rng, rows = random.Random(21), []
    pool = [f"pool {i}" for i in range(200)]
    for k in range(150):
        i, n = rng.randrange(190), rng.randint(2, 9)
        rows.append((k, "\n".join([f"own {k} {j}" for j in range(rng.randint(1, 4))] + pool[i : i + n] + [f"end {k} {j}" for j in range(rng.randint(1, 4))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for k, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, k)

    def gone():
        got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup(df).collect()}
        out = {(k, x) for k, t in rows for x in t.split("\n") if x not in got[k]}
        assert all(first[x] < k for k, x in out)
        return len(out)

    every = gone()
    table = line_dedup.chunk_table  # only the beginnings of texts are left as boundaries
    monkeypatch.setattr(line_dedup, "chunk_table", lambda docs: table(docs).where("first = 0"))
    assert gone() < every / 2
