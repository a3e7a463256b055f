"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import os

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm import brute
from tunerline.llm import bpe, line_dedup, quality_rules

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import tiktoken

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, labels.where("quality = 1")).collect()}  # held against a plain version in test_ops
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [r for r in rows if verdict[r[0]]]
    assert all(not brute.base_rules(t)[5] for _, t in rows)
    texts = brute.lines(rows, lambda x: brute.line_chunks(x, line_dedup.WIDTHS, line_dedup.BITS, line_dedup.LEAST_LINES), line_dedup.REACH)
    rows = [(k, t) for (k, old), t in zip(rows, texts, strict=True) if t == old or brute.BLANK.search(t)]
    rows = [r for r, (_, c) in zip(rows, brute.jaccard(rows), strict=True) if c == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [r for r, x in zip(rows, brute.contamination(rows, items), strict=True) if not x[4]]
    lib = tiktoken.Encoding("lib", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {k: (len(i := lib.encode_ordinary(t)), brute.sha(" ".join(map(str, i)))) for k, t in rows}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(want) < docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    docs = docs.unionByName(odd).selectExpr("*", "1 as words", "2 as kept", "3 as node", "4 as __n_lines", "5 as __d", "6 as __h", "7 as __text_hash", "8 as __k", "9 as text_key", "10 as __drop", "11 as lines", "12 as key")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.selectExpr(*[f"{c} as c{i}" for i, c in enumerate(docs.columns[5:])]).distinct().count() == 1, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (2, long + " x"), (None, "other words here"), (None, "other words here"), (3, None), (3, None), (4, ""), (1, "quite another text of the same id")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, extra int")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, DATA).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=repr)
    assert got == sorted([(1, long), (None, "other words here"), (3, None), (3, None), (4, ""), (1, "quite another text of the same id")], key=repr)
    assert {r["extra"] for r in out if r["text"] == long} <= {0, 1}


def test_scratch_tables_go(spark):
    from tunerline.llm.common import Scratch, Settled

    with Scratch() as scratch:
        kept = scratch.keep(Settled(spark.range(3), "kept"))
        gone = Settled(spark.range(3), "gone")
    assert kept.df.count() == 3 and kept.bytes() > 0
    fs, path = gone._fs()
    assert not fs.exists(path)


def test_copies_of_lines_leave_no_empty_documents(spark):
    text = "\n".join(f"line {i} of a text that is there three times" for i in range(8))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nand one line more"), (4, ""), (5, None), (6, " \n ")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, DATA).collect()}
    assert out == {1: text, 3: "and one line more", 4: "", 5: None, 6: " \n "}
