"""Quality of predictions as aggregates over ``label`` and ``prediction``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame) -> DataFrame:
    """``n, n_correct, accuracy``; overall precision is the same number."""
    hit = F.count_if(F.col("label") == F.col("prediction"))
    return df.agg(F.count("*").alias("n"), hit.alias("n_correct"), (hit / F.count("*")).alias("accuracy"))


def _missed():
    """A row without label or prediction is a miss, so that hits and misses add up to all rows."""
    return ~F.coalesce(F.col("label") == F.col("prediction"), F.lit(False))


def misclassified(df: DataFrame) -> DataFrame:
    return df.where(_missed())


def test_error(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``n, n_wrong, test_error``."""
    df = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    miss = F.count_if(_missed())
    return df.agg(F.count("*").alias("n"), miss.alias("n_wrong"), (miss / F.count("*")).alias("test_error"))


test_error.__test__ = False


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion counts alone."""
    cells = confusion(df)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given"),
                 hit.cast("long").alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")),
    )
    sums = cells.select(F.inline(roles)).groupBy("class").agg(
        F.sum("actual").alias("n_actual"), F.sum("given").alias("n_predicted"), F.sum("hit").alias("n_correct")
    )
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
    return sums.select(
        "class",
        "n_actual",
        "n_predicted",
        "n_correct",
        safe(F.col("n_correct"), F.col("n_predicted")).alias("precision"),
        safe(F.col("n_correct"), F.col("n_actual")).alias("recall"),
        safe(2 * F.col("n_correct"), F.col("n_actual") + F.col("n_predicted")).alias("f1"),
    )
