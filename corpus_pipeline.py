"""The corpus pipeline: quality rules, exact and near duplicates, mixing sources, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm.shared import written
from driftwell.llm.stages import STAGES

#: Near duplicates and pieces cannot be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table of documents; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
