"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.

Language ID drops documents without a language or of none that it knows; near-dedup keeps one document of each group; decontamination drops
documents that hold benchmark items; PII masks spans; BPE encodes what is left. Stages 1 to 4 return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm import bpe, decontam, langid, minhash, pii_semicrf
from logweft.llm.common import table, written
from logweft.llm.queries import RANKS_FILE

#: Documents whose best language has a smaller share of the score go, and those without the evidence of ``langid``.
LEAST_SCORE = 0.3
#: Shingles of five words, similarity 0.8.
WIDTH, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_rows(docs, langid.train(docs, F.lit(True), gate=True), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept_rows(docs, WIDTH, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii_semicrf.masked_rows(docs, pii_semicrf.train(docs))
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", mask_pii),
    ("bpe", tokenize),
]

#: Segmentation, sampling and byte-pair merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
