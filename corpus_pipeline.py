"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.llm import stages
from girder.llm.storage import materialize

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.drop_benchmark_leaks),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: SQL can't express the stages (a learned grammar, hashed signatures, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
