"""Numeric feature files and the array features of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NUMERIC_SCHEMA = "f0 double, f1 double, f2 double, f3 double, label double"


def read_numeric(spark: SparkSession, path: str) -> DataFrame:
    """Four features and a label, comma separated; a malformed line stops the job."""
    return spark.read.schema(NUMERIC_SCHEMA).option("mode", "FAILFAST").csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label, features``. Give ``num_features`` for large files: it saves the pass that counts them."""
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", num_features)
    return reader.load(path)
