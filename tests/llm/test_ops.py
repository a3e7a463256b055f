import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import brute
from tunerline.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, quality_model, quality_rules, suffix_dedup, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, n long, gram long, spans string"


def _texts():
    """Null, empty, tiny, long, tied, repeated and accented texts, near copies, shared passages and lines, odd blanks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "lo", "mé", "ti", "Ru", "ß"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(90)
    out = [None, "", " ", "\n\n", "one", "One", "a b c d e", "A B C D E", "☃ 日本語", "x" * 5000, "spam " * 300, "spam " * 301, base, base, base.upper()]
    for _ in range(12):  # near copies around the threshold
        w = base.split(" ")
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [prose(30) + " " + passage + " " + prose(rng.randint(1, 60)) for _ in range(8)]
    shared = "\n".join(prose(6) for _ in range(12))
    out += [prose(8) + "\n" + shared + "\n" + prose(8) for _ in range(5)] + [shared, shared + "\n" + shared]
    out += [prose(rng.randint(1, 80)) + "\x0b\t\r\n" + prose(10) for _ in range(15)] + [prose(3000)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i if i != 7 else None, t) for i, t in enumerate(_texts())]
    return out + [out[12], out[30]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(k, t, ["en", "fr", None][i % 3], None, len(t or ""), 1, 2, 3, "x") for i, (k, t) in enumerate(rows)], DOCS)
    return df.repartition(3)


def _by_row(df, rows, *cols):
    """Values of cols for each of rows; equal ids have equal texts here."""
    got = {}
    for r in df.select("doc_id", *cols).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    assert sum(map(len, got.values())) == len(rows)
    assert all(len(set(v)) == 1 for v in got.values())
    return [got[k][0] for k, _ in rows]


def test_jaccard(docs, rows, monkeypatch):
    want = brute.jaccard(rows)
    assert _by_row(jaccard_join.join(docs), rows, "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard_join, "TILE", 2)  # many parts of tiles
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "_node", lambda d: d[0] & 7)  # most sets share their node's bits
    assert _by_row(jaccard_join.join(docs), rows, "n_shingles", "component_id") == want
    assert jaccard_join.join(docs.limit(0)).collect() == []


@pytest.mark.parametrize("short", [True, False])
def test_jaccard_of_words_that_collide(spark, short):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever its base."""
    w = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    w = w[:1000] if short else w  # words of one kind are hashed together, long ones one by one
    cases = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w.upper())]
    assert _by_row(jaccard_join.join(spark.createDataFrame(cases, "doc_id long, text string")), cases, "n_shingles", "component_id") == [(1, 1), (1, 2), (1, 1)]


def test_overlaps_are_of_words(monkeypatch):
    texts = ["a b c d e f a b c d e", "a b c d e g", "b a", "B A", " a\tb\n", "", "x", "x" * 3000 + " y", "a b c d é", "A b  c d é"] + [" ".join(random.Random(i).choices("ab", k=40)) for i in range(3)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (brute.BLANK.findall(t.translate(brute.LOWER)) for t in texts)]
    for broken in (False, True):
        if broken:  # all shingles of a text have one hash
            monkeypatch.setattr(jaccard_join, "_PLACES", np.zeros_like(jaccard_join._PLACES))
        for x, a in zip(texts, sets, strict=True):
            for y, b in zip(texts, sets, strict=True):
                assert jaccard_join.overlap(x.encode(), y.encode()) == (len(a), len(b), len(a & b))
        column = pa.array([None, *texts, None])
        for part in (column, column.slice(3, 5)):
            got = [len(h) for h, _ in jaccard_join.shingled(part)]
            assert got == [len(sets[texts.index(t)]) if t is not None else 0 for t in part.to_pylist()]


def test_shingles_by_blocks(monkeypatch):
    column = pa.array([" ".join(random.Random(i).choices(["one", "two", "é", "four" * 300], k=30 * i)) for i in range(6)])
    want = [x for _, x in jaccard_join.shingled(column)]
    for block in (1, 50, 3000):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert [x for _, x in jaccard_join.shingled(column)] == want and len(set(want)) == 6


def test_jaccard_threshold_is_exact(spark):
    a = [f"w{i}" for i in range(49)]  # 45 shingles
    cases = []
    for cut in range(1, 12):
        cases += [(2 * cut, " ".join([f"p{cut}"] + a)), (2 * cut + 1, " ".join([f"p{cut}"] + a[: 49 - cut] + [f"q{cut}{i}" for i in range(cut)]))]
    assert _by_row(jaccard_join.join(spark.createDataFrame(cases, "doc_id long, text string")), cases, "n_shingles", "component_id") == brute.jaccard(cases)


def test_jaccard_of_sizes_that_differ(spark):
    """A text and itself with more words at its end: nobody else shares their rare shingles, and no leader has both sizes' band."""
    cases = []
    for n, more in ((100, 15), (100, 20), (100, 25), (100, 26), (60, 13), (60, 15), (60, 16), (401, 90)):
        a = [f"t{len(cases)}w{i}" for i in range(n + 4)]
        k = len(cases)
        cases += [(k, " ".join(a)), (k + 1, " ".join(a + [f"t{k}x{i}" for i in range(more)]))]
    want = brute.jaccard(cases)
    assert len({c for _, c in want}) == 8 + 2  # 100 with 126, and 60 with 76, are too far apart
    assert _by_row(jaccard_join.join(spark.createDataFrame(cases, "doc_id long, text string")), cases, "n_shingles", "component_id") == want


def test_suffixes(docs, rows, monkeypatch):
    want = brute.repeats(rows)
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert _by_row(suffix_dedup.dedup(docs), rows, *cols) == want
    assert sum(x[1] for x in want) > 1000
    kept = _by_row(suffix_dedup.dedup(docs, with_text=True), rows, "kept_bytes", "kept_sha256")
    assert all(brute.sha(bytes(a)) == b for a, b in kept)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1)  # all groups are split, down to single places
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    monkeypatch.setattr(suffix_dedup, "SORTED", 3)
    assert _by_row(suffix_dedup.dedup(docs), rows, *cols) == want
    assert suffix_dedup.dedup(docs.limit(0)).collect() == []


def test_suffixes_of_edited_passages(spark, monkeypatch):
    """One passage of 700 bytes in 40 texts, edited and cut in other places in each: strings that overlap it in every way."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    cases = []
    for i in range(40):
        p = list(passage)
        for _ in range(rng.choice([0, 0, 1, 2])):
            p[rng.randrange(len(p))] = rng.choice("XYZ")
        lo, hi = rng.choice([(0, 700), (rng.randrange(200), 700), (0, 700 - rng.randrange(200)), (150, 560)])
        cases.append((i, "".join(rng.choice("ijkl\x00é") for _ in range(rng.randrange(60))) + "".join(p[lo:hi]) + "".join(rng.choice("mnop") for _ in range(rng.randrange(60)))))
    d = spark.createDataFrame(cases, "doc_id long, text string")
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.repeats(cases)
    assert len({x[1] for x in want}) > 10
    for bucket in (suffix_dedup.BUCKET, 7):
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
        assert _by_row(suffix_dedup.dedup(d), cases, *cols) == want


def test_suffixes_of_periodic_texts(spark):
    """Every place of a text of one letter is marked; its contexts are few."""
    cases = [(1, "x" * 60_000), (2, "ab" * 1_000), (3, "abc" * 150 + "d" + "abc" * 140), (4, "x" * 399), (5, "y" * 400), (6, "y" * 401), (7, "z" + "ab" * 200)]
    d = spark.createDataFrame(cases, "doc_id long, text string")
    assert _by_row(suffix_dedup.dedup(d), cases, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(cases)
    texts = spark.createDataFrame([(0, 1, "x" * 60_000)], "tid long, w long, text string")
    found = suffix_dedup.contexts(texts, suffix_dedup.marked(texts).groupBy("tid").agg(F.collect_list("pos").alias("at")))
    assert found.count() > 50_000 and found.where("ctx is not null").count() < 2_000


def _suffixes(parts):
    width = max(1, max(map(len, parts)))
    return suffix_dedup.Suffixes(np.array([list(p.ljust(width, b"\0")) for p in parts], np.uint8), np.array([len(p) for p in parts]))


def test_hashed_sort():
    rng = random.Random(9)
    groups = [[bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(9))) for _ in range(n)] for n in (1, 2, 3, 17, 64, 5)]
    parts = [p for g in groups for p in g]
    first = np.concatenate([np.full(len(g), sum(map(len, groups[:i]))) for i, g in enumerate(groups)])
    count = np.concatenate([np.full(len(g), len(g)) for g in groups])
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    for broken in (False, True):
        s = _suffixes(parts)
        if broken:
            s.hashes[:] = 0  # all prefixes collide
        order, shared = s.sort(first, count)
        got = [parts[i] for i in order]
        assert got == [p for g in groups for p in sorted(g)]
        assert shared.tolist() == [-1 if i == first[i] else common(got[i - 1], got[i]) for i in range(len(got))]


def test_decontamination(spark, docs, rows):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[28].split()[35:60])), (2, "one"), (3, None), (4, "!!"), (None, "lone item"), (5, " ".join(texts[28].split()[40:52])), (6, "Spam, spam; SPAM"), (10, "spam spam spam")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(rows, items)
    assert any(w[4] for w in want) and _by_row(decontaminate.judge(docs, bench), rows, *cols) == want
    assert _by_row(decontaminate.judge(docs, bench.limit(0)), rows, *cols) == brute.contamination(rows, [])
    assert decontaminate.judge(docs.limit(0), bench).collect() == []


def test_decontamination_without_broadcast(docs, rows, spark, monkeypatch):
    from tunerline.llm import common

    items = [(1, "spam spam spam"), (2, "a b c d e")]
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = _by_row(decontaminate.judge(docs, spark.createDataFrame(items, "item_id long, text string")), rows, "n_hit")
    assert got == [(w[1],) for w in brute.contamination(rows, items)]


@pytest.mark.parametrize("every", [True, False])
def test_decontamination_filter_may_err(docs, rows, spark, monkeypatch, every):
    """A filter that lets every word pass, or the Bloom filter of a large benchmark, changes nothing."""
    monkeypatch.setattr(decontaminate, "filter_of", (lambda terms: None) if every else lambda terms: urls.BlockedBloom(terms.df.select(F.xxhash64("term").alias("key")), 2))
    items = [(1, "spam spam spam"), (2, "a b c d e")]
    got = _by_row(decontaminate.judge(docs, spark.createDataFrame(items, "item_id long, text string")), rows, "n_hit")
    assert got == [(w[1],) for w in brute.contamination(rows, items)]


def test_index_is_by_term(spark):
    d = spark.createDataFrame([(1, "b a B"), (2, "b a B"), (3, None)], "doc_id long, text string")
    texts, postings = decontaminate.index(d)
    assert sorted((r["doc_id"], r["n_words"]) for r in texts.df.collect()) == [(1, 3), (2, 3), (3, 0)]
    assert sorted((r["term"], r["positions"]) for r in postings.df.collect()) == [("a", [1]), ("b", [0, 2])]


def test_proximity(spark):
    texts = [(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (None, "x x x beta alpha"), (5, "alpha"), (6, ""), (7, "alpha x beta x x gamma " * 50), (8, "gamma x x x alpha beta")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    docs, postings = decontaminate.index(d)
    asked = {"two": ["alpha", "beta"], "one": ["alpha"], "none": ["delta"], "three": ["alpha", "beta", "gamma"], "empty": []}
    queries = spark.createDataFrame(list(asked.items()), "item string, picked array<string>")
    got = {(r["item"], r["doc_id"]) for r in decontaminate.proximity_matches(postings.df, queries, 4, 3).join(docs.df, "key").collect()}
    place = lambda w, t: [i for i, x in enumerate(w) if x == t]
    near = lambda w, q: any(all(any(abs(p - o) < 4 for o in place(w, t)) for t in q[1:]) for p in place(w, q[0])) if q else False
    assert got == {(k, i) for k, q in asked.items() for i, t in texts if near(t.split(), q)}


def test_near_items(spark):
    d = spark.createDataFrame([(1, "rare words stand here together"), (2, "rare x x x x x words x here"), (3, "common common common"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare words stand here"), (2, "unseen common"), (None, "common")], "item_id int, text string")
    got = sorted((r["n_words"], r["n_hit"], r["n_near_items"]) for r in decontaminate.judge(d, bench, near=5).collect())
    assert got == [(0, 0, 0), (3, 0, 1), (5, 4, 1), (9, 0, 0)]


def test_lines(docs, rows):
    chunks = lambda x: brute.line_chunks(x, line_dedup.WIDTHS, line_dedup.BITS, line_dedup.LEAST_LINES)
    assert all(sorted(line_dedup.chunks(x)) == chunks(x) for _, t in rows for x in [(t or "").split("\n")])
    want = brute.lines(sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)), chunks, line_dedup.REACH)
    by_id = dict(zip([k for k, _ in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))], want, strict=True))
    out = line_dedup.dedup(docs)
    assert _by_row(out, rows, "text") == [(by_id[k],) for k, _ in rows]
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sum(r["__n_removed"] for r in out.collect()) > 0
    assert line_dedup.dedup(docs.limit(0)).collect() == []


def test_lines_with_clashing_columns(spark):
    names = ["__d", "__h", "__drop", "__text_hash", "__N_LINES", "k1", "first", "bytes", "at"]
    text = "one line\ntwo lines\nthree lines"
    d = spark.createDataFrame([(i, text, *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.dedup(d, ("a", "b", "c")).orderBy("doc_id").collect()
    assert [(r["text"], r["a"], r["b"]) for r in out] == [(text, 3, 0), ("", 3, 3), ("", 3, 3)]
    assert all([r[n] for n in names] == list(range(len(names))) for r in out)


def test_recall_of_line_dedup(spark):
    """Of the lines in runs of two or more lines that came before, as plain neighbours tell them, nearly all go."""
    rng = random.Random(12)
    pool = [f"pool line {i}" for i in range(300)]
    rows = []
    for k in range(120):
        i, n = rng.randrange(290), rng.choice([1, 2, 2, 3, 5, 8])
        rows.append((k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(4))] + pool[i : i + n] + [f"end {k} {j}" for j in range(rng.randrange(4))])))
    seen, want, total = set(), {}, 0
    for k, t in rows:
        x = t.split("\n")
        want[k] = {j for i in range(len(x) - 1) if (x[i], x[i + 1]) in seen for j in (i, i + 1)}
        seen |= set(zip(x, x[1:]))
        total += len(want[k])
    got = {r["doc_id"]: set(r["text"].split("\n")) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = sum(t.split("\n")[i] not in got[k] for k, t in rows for i in want[k])
    assert total > 100 and gone >= 0.99 * total


def test_chunks_resist_shifts():
    lines = [f"line {i} {i * 7919 % 13}" for i in range(200)]
    cut = lambda x: {"\n".join(x[a : a + n]) for a, n in line_dedup.chunks(x)}
    assert len(cut(lines) & cut(["new"] + lines[:90] + ["mid"] + lines[90:])) > len(cut(lines)) * 0.8


def test_short_passages_of_lines(spark):
    """Passages of 2 to 6 lines, some with blank ones, between lines of their own go from all texts but the first."""
    rows, want = [], {}
    for n in (2, 3, 4, 5, 6):
        for k in range(6):
            passage = [f"passage {n} {k} line {i}" for i in range(n)]
            if k % 2:
                passage.insert(1, "")
            for copy in range(2):
                before, after = [[f"{side} {n} {k} {copy} {i}" for i in range(k % 4)] for side in ("before", "after")]
                want[len(rows)] = "\n".join(before + after if copy else before + passage + after)
                rows.append((len(rows), "\n".join(before + passage + after)))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == want


def test_no_line_is_lost(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x for r in out for x in r["text"].split("\n")} - {""} == {x for _, t in rows for x in t.split("\n")}


def test_quality_rules(spark, docs, rows):
    got = _by_row(quality_rules.judge(docs, docs.where("doc_id % 2 = 0").select("doc_id")), rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [g[:6] for g in got] == [brute.base_rules(t) for _, t in rows]
    pairs = lambda e: list(zip(e, e[1:], strict=False))
    ends = {w for _, t in rows for w in brute.BLANK.findall(t or "")}
    h = {r["e"]: r["h"] for r in spark.createDataFrame([(e,) for e in ends], "e string").select("e", F.xxhash64("e").alias("h")).collect()}
    two = {p for _, t in rows for p in pairs([h[w] for w in brute.BLANK.findall(t or "")])}
    b = {(r["a"], r["b"]): r["x"] for r in spark.createDataFrame(list(two), "a long, b long").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(quality_rules.BUCKETS)).alias("x")).collect()}
    bucket = lambda e: [h[x] % quality_rules.BUCKETS for x in e] + [b[p] for p in pairs([h[x] for x in e])]
    trusted = {k for k, _ in rows if k is not None and k % 2 == 0}
    q = quality_rules
    assert [g[6] for g in got] == brute.likelihood(rows, trusted, q.BUCKETS, q.PRIOR, q.SCALE, q.THRESHOLD, bucket)
    none = quality_rules.judge(docs, docs.limit(0).select("doc_id")).where("not base_failed and not kept")
    assert none.isEmpty() and quality_rules.judge(docs.limit(0), docs.select("doc_id")).collect() == []


def test_bpe(docs, rows):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("lib", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [lib.encode_ordinary(t or "") for _, t in rows]
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=True)
    got = _by_row(out.withColumn("ids", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ")), rows, "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    assert got == [(len(i), brute.sha(" ".join(map(str, i))), brute.sha(t or ""), " ".join(map(str, i))) for i, (_, t) in zip(ids, rows, strict=True)]
    assert _by_row(bpe.decode(out, ranks), rows, "text") == [(t or "",) for _, t in rows]
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []
    assert bpe.decode(out.limit(0), ranks).collect() == []
    broken = {k: v + 1 if v > 300 else v for k, v in ranks.items()} | {b" qzx": 301}  # other ids, which decode alike
    assert _by_row(bpe.encode(docs, broken, public_tokenizers.PATTERN), rows, "decoded_sha256") == [(brute.sha(t or ""),) for _, t in rows]


def test_merges_of_long_pieces():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("lib", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 20_000):
        s = "".join(rng.choice("aab the éß") for _ in range(n))
        assert bpe.merge(s.encode(), ranks) == lib.encode_ordinary(s)


def test_token_counts(docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    lib = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(split=True, prepend_scheme="always")
    got = _by_row(tokens.count(docs, tokens.load_pieces(path)), rows, "n_tokens")
    assert got == [(len(lib.encode(t or "", add_special_tokens=False).ids),) for _, t in rows]
    assert tokens.count(docs.limit(0), tokens.load_pieces(path)).collect() == []


def test_scores_of_segmentations(spark):
    """n_tokens and score against all segmentations of short texts."""
    pieces = [("▁", -1.0), ("▁a", -2.5), ("a", -1.5), ("ab", -2.0), ("b", -3.0), ("ba", -2.25), ("▁ab", -2.75)]
    score = dict(pieces)

    def best(word):
        every = [(0.0, 0)] if not word else []
        for n in range(1, len(word) + 1):
            if word[:n] in score:
                every += [(score[word[:n]] + s, k + 1) for s, k in best(word[n:])]
        return every

    texts = ["", "a", "ab", "aba b", "abab baba", "b  a"]
    out = {r["doc_id"]: r for r in tokens.count(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), pieces).collect()}
    for i, t in enumerate(texts):
        found = [best("▁" + w) for w in t.split(" ")] if t else []
        counts = [{k for v, k in x if v == max(x)[0]} for x in found]
        assert abs(out[i]["score"] - sum(max(x)[0] for x in found)) < 1e-9
        assert sum(map(min, counts)) <= out[i]["n_tokens"] <= sum(map(max, counts))


def test_token_count_ties():
    c = tokens.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("aaa", -3.0)])
    assert c.viterbi("▁aaa") == (2, -4.0)  # equal scores: the last piece that starts first stays
    assert c.viterbi("▁é")[0] == 3  # a mark and two bytes


def test_language_id(spark):
    rng = random.Random(3)
    syl = {"en": ["th", "ing", "er", "and "], "fr": ["eau", "é", "oi", "les "], "de": ["sch", "ü", "ung", "der "]}
    text = lambda k: "".join(rng.choice(syl[k]) for _ in range(rng.randint(20, 300)))
    rows = [(i, text(k), k) for i, k in enumerate(["en", "fr", "de"] * 60)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !!", "de"), (None, text("fr"), None), (1003, text("de") * 50, None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and sum(got[k]["lang_pred"] == lang for k, _, lang in held) >= 0.95 * len(held)
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "fr" and got[1003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(d.limit(0)).collect() == []


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than the sample has places for: one document of each is kept."""
    monkeypatch.setattr(langid, "SAMPLES", 40)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    d = spark.createDataFrame([(i, f"text {i % 70} " * 9, f"l{i % 70:02d}", 1, "x") for i in range(700)], "doc_id long, text string, lang string, count int, rank string")
    assert langid.fit(d).languages == [f"l{i:02d}" for i in range(70)]
    assert langid.sample(d).count() == 70


def test_predictions_against_a_plain_convolution():
    rng = random.Random(2)
    net = langid.Net(["a", "b", "c"])
    net.params["b"] += 0.1
    net.params["c"] += np.array([0.1, -0.2, 0.3], np.float32)
    net.tables()
    for n in (1, 3, langid.LENGTH, langid.LENGTH + 1, 3 * langid.LENGTH + 7):
        text = bytes(rng.randrange(256) for _ in range(n))
        assert np.allclose(net.predict(text), brute.convolve(net, text, langid.LENGTH, langid.WIDTHS), atol=1e-4)


def test_gradients():
    """Against differences of the loss in some parameters of each kind."""
    net, rng = langid.Net(["a", "b"]), np.random.default_rng(0)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x = rng.integers(0, 256, (5, langid.LENGTH + 3)).astype(np.uint8)
    y = np.array([0, 1, 1, 0, 1])

    def loss():
        p, out = net.params, 0.0
        for row, label in zip(x, y, strict=True):
            top = np.concatenate([sum((p["E"] @ p[f"W{w}"][k])[row[k : k + langid.LENGTH]] for k in range(w)).max(0) for w in langid.WIDTHS])
            z = np.maximum(top + p["b"], 0) @ p["V"] + p["c"]
            out += np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]
        return out / len(y)

    g = net._step(x, y)
    for name, at in (("V", (3, 1)), ("c", (0,)), ("b", (20,)), ("W3", (1, 2, 5)), ("E", (int(x[0, 0]), 4))):
        old = net.params[name][at]
        net.params[name][at] = old + 1e-5
        up = loss()
        net.params[name][at] = old - 1e-5
        down = loss()
        net.params[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_indicators_against_plain_ngrams(monkeypatch):
    monkeypatch.setattr(quality_model, "FEATURES", 1 << 17)
    seen = np.zeros(quality_model.FEATURES, bool)
    rng = random.Random(3)
    for text in (b"", b"a", b"the the the cat", "é ß é é".encode(), bytes(rng.randrange(97, 100) for _ in range(200)), b"x y " * 100_000):
        want = set()
        for kind, g in brute.byte_ngrams(text, quality_model.GRAM):
            key = 0
            for v in g:
                key = (key << (8 if kind == "b" else 1)) | v
            key += (len(g) << 40) + (kind == "w") * (1 << 44)
            want.add(key * 0x9E3779B97F4A7C15 % 2**64 >> 47)
        assert quality_model.features(text, seen).tolist() == sorted(want) and not seen.any()


def test_descent_against_a_plain_solver():
    """The dual of the hinge loss by projected gradients over all variables at once."""
    rng = np.random.default_rng(1)
    n, m = 40, 12
    dense = np.where(rng.random((n, m)) < 0.4, rng.normal(size=(n, m)), 0.0)
    labels = (dense[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [np.flatnonzero(r) for r in dense]
    y = 2.0 * labels - 1
    w, b = quality_model.Model._descend(rows, [r[i] for r, i in zip(dense, rows, strict=True)], y, np.arange(n))
    x = np.concatenate([dense, np.ones((n, 1))], 1) * y[:, None]
    limit = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum())) * quality_model.PENALTY
    gram, alpha = x @ x.T, np.zeros(n)
    for _ in range(60_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, limit)
    plain = x.T @ alpha
    objective = lambda v: 0.5 * v @ v + (limit * np.maximum(0, 1 - x @ v)).sum()
    assert objective(np.append(w[:m], b)) <= objective(plain) * 1.01


def test_models_with_clashing_columns_and_long_texts(spark):
    names = ["h", "rank", "quality", "count", "row", "held_out", "score", "lang_pred", "predicted"]
    rows = [(i, ("good words here " if i % 2 else "BAD!! ") * (200_000 if i == 3 else 9), ["en", "fr"][i % 2], *["x"] * len(names)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, i % 2, "x", "y") for i in range(60)], "doc_id long, quality int, h string, text string")
    got = {r["doc_id"]: r for r in quality_model.judge(d, labels).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(60)) and sorted(got[3].asDict()) == ["doc_id", "held_out", "predicted", "score"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d).collect()}
    assert all(got[i] == ["en", "fr"][i % 2] for i in range(60))


def test_quality_model(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "quiet", "morning"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["WIN!!", "cash$$$", "now***"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(200)]
    d = spark.createDataFrame(rows + [(500, None), (501, ""), (None, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(0, 0, 0), (900, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_model.judge(d, labels).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(200))
    assert got[500]["score"] == got[501]["score"] and 0 <= got[500]["score"] <= 1 and got[None]["predicted"] == 1
    assert {r["score"] for r in quality_model.judge(d, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in quality_model.judge(d, labels.where("quality = 1")).collect()} == {1}
    assert quality_model.judge(d.limit(0), labels).collect() == []


def test_urls(spark):
    pages = [
        (1, "http://www.a.example.com/en/1?x#y", "com/en/", "block"), (2, "https://Example.COM/en/7", "example.com/en/7", "allow"), (3, "https://b.example.net/de/8/z", "example.net/de/8", "block"),
        (4, "https://b.example.net/de/9", "net/de/", "allow"), (5, "http://x.spam-farm.example.org/fr/", None, "block"), (6, "http://notspam-farm.example.org/fr", None, "allow"), (7, None, None, "allow"),
        (8, "no scheme /en/", None, "allow"), (9, "http://org/es/", "org/es/", "block"), (10, "http://h?q=/en/", None, "allow"), (11, "", None, "allow"), (11, "://", None, "allow"), (12, "http://only.example.com/listed/index.html", None, "block"),
    ]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u, _, _ in pages], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([(x,) for x in [*urls.LISTED, "only.example.com/listed", None, urls.LISTED[0]]], "url string")
    got = urls.judge(df, listed).collect()
    assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in got) == sorted((k, r or "", v) for k, _, r, v in pages)
    assert {r["page_id"]: (r["host"], r["path"]) for r in got}[1] == ("www.a.example.com", "/en/1")
    assert {r["verdict"] for r in urls.judge(df.where("page_id = 5"), listed.limit(0)).collect()} == {"allow"}
    assert urls.judge(df.limit(0), listed).collect() == []


def test_large_list(spark):
    """100,000 listed hosts and pages; the filter lets few of the others pass, and none of those is blocked."""
    listed = spark.range(100_000).selectExpr("if(id % 2 = 0, concat('host', id, '.example.com/'), concat('pages.example.org/p', id)) as url")
    pages = spark.range(60_000).selectExpr("id as page_id", "case id % 4 when 0 then concat('http://WWW.host', id, '.example.com/en') when 1 then concat('http://pages.example.org/p', id, '/index.html?x') when 2 then concat('http://x.host', id, '.example.com') else concat('http://other', id, '.example.org/p', id) end as url")
    got = urls.judge(pages, listed, []).groupBy(F.col("page_id") % 4).pivot("verdict").count().collect()
    assert sorted((r[0], r["block"] or 0, r["allow"] or 0) for r in got) == [(0, 15_000, 0), (1, 15_000, 0), (2, 15_000, 0), (3, 0, 15_000)]
    bloom = urls.BlockedBloom(listed.select(F.xxhash64("url").alias("key")), 100_000)
    other = spark.range(50_000).select(F.xxhash64(F.concat(F.lit("o"), "id")).alias("key")).toPandas()["key"].to_numpy()
    assert bloom.may_hold(other).mean() < 0.02


def test_list_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# hosts\nSPAM.example.com\n\nhttp://www.a.example.org/x/index.html\n")
    assert sorted(r["url"] for r in urls.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a.example.org/x", "spam.example.com/"]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bloom = urls.BlockedBloom(keys, 5000)
    own = keys.toPandas()["key"].to_numpy()
    other = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("key")).toPandas()["key"].to_numpy()
    assert bloom.may_hold(own).all() and bloom.may_hold(other).mean() < 0.05


def test_operators_keep_id_types(spark):
    d = spark.createDataFrame([("a", "one two"), ("b", "one two")], T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())]))
    assert {r["component_id"] for r in jaccard_join.join(d).collect()} == {"a"}
    assert suffix_dedup.dedup(d).count() == 2 and line_dedup.dedup(d).count() == 2
