"""The corpus pipeline: five of the operators in a row, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, jaccard_join, quality_rules, sp_codec, suffix_dedup
from folioscope.llm.common import written

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("jaccard_join", jaccard_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontam.stage),
    ("sentencepiece", sp_codec.stage),
]

#: Suffix order, latent retrieval and tokenisation have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
