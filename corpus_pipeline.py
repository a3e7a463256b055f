"""Training-text pipeline: each stage works on what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunerline.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from tunerline.llm.common import Scratch, Settled, unused


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The trusted target is the documents labelled good."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    ratios = quality_rules.fit(docs, trusted)
    return quality_rules.score(docs, ratios, row=True).where("kept").select("__row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; n_chars follows the text. A document that has no word left goes: all its lines came before."""
    counts = unused(docs, "lines", "removed", "chunks")
    out = line_dedup.dedup(docs, tuple(counts)).where((F.col(counts[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the smallest doc_id (null ids last); repeated rows are copies."""
    return jaccard_join.representatives(docs, Settled(jaccard_join.join(docs), "components").df)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    found = decontaminate.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    (key,) = unused(docs, "text_key")
    bad = Settled(found.where("contaminated").select(F.col("key").alias(key)).distinct(), "contaminated", few=True)
    return docs.join(bad.side(), decontaminate.text_key(docs["text"]) == F.col(key), "left_anti")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and the hashes of the ids and of the decoded text."""
    return bpe.encode(docs, bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and its scratch tables deleted. The last
    one gives ids and hashes, without the lists of ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:
            docs = scratch.keep(Settled(stage(spark, docs, sf_dir), f"stage-{name}")).df
    return STAGES[-1][1](spark, docs, sf_dir).drop("token_ids")
