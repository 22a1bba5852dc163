"""Label index: number classes by frequency, encode and decode by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.operators.corpus import class_frequency
from ticketmill.operators.numbering import number_rows
from ticketmill.session import join_lookup


def label_index(df: DataFrame, group: str, job_id: str) -> DataFrame:
    """``job_id, label, group, n``: 0-based by descending frequency, ties by name; the order of StringIndexer."""
    counts = class_frequency(df.where(F.col(group).isNotNull()), group).withColumnRenamed(group, "group")
    numbered = number_rows(counts, [F.col("n").desc(), F.col("group").asc()], "label", start=0)
    return numbered.select(
        F.lit(job_id).alias("job_id"), F.col("label").cast("double").alias("label"), "group", "n"
    )


def encode(df: DataFrame, index: DataFrame, group: str) -> DataFrame:
    """Add ``label`` for the class in ``group``; null where the index does not know it."""
    return join_lookup(df, index.select(F.col("group").alias(group), "label"), group, "left")


def decode(df: DataFrame, index: DataFrame, label: str, out: str) -> DataFrame:
    """Add the class name ``out`` of the index in ``label``."""
    return join_lookup(df, index.select(F.col("label").alias(label), F.col("group").alias(out)), label, "left")
