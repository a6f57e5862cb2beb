"""The document pipeline: language ID, n-gram Jaccard join, decontamination, PII, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes each result as Parquet
under the shared folder and gives the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import stages
from basalt.llm.text import stored

STAGES = [
    ("language_id", stages.language_id),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("pii", stages.pii),
    ("bpe_codec", stages.bpe_codec),
]

#: SQL cannot express these stages (learned models, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
