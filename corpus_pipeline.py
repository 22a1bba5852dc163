"""A training-data pipeline over ``documents``, stage by stage; every stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketmill.llm import stages

STAGES = [
    ("language", stages.identify_language),
    ("lines", stages.drop_lines),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("tokens", stages.encode),
]

#: Patience alignment, alignment of near copies and merge-list tokens have no SQL form; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run_stages(STAGES, spark, sf_dir)
