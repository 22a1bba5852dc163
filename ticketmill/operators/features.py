"""Feature vectors: hashed term frequencies, assembled numeric columns, sparse vectors as rows."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.functions.tokens import inlined, token_counts


def hashed_tf(df: DataFrame, tokens_col: str, num_features: int, out: str = "features") -> DataFrame:
    return HashingTF(inputCol=tokens_col, outputCol=out, numFeatures=num_features).transform(df)


def sparse_entries(vector: str) -> Column:
    """``array<struct<bucket, tf>>`` of a sparse vector column, without leaving the JVM or going dense."""
    plain = F.unwrap_udt(F.col(vector))
    return F.arrays_zip(plain["indices"].alias("bucket"), plain["values"].alias("tf"))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def array_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def bucket_words(df: DataFrame, tokens: Column, num_features: int, most: int = 3) -> DataFrame:
    """``feature, place, word, n, share``: the most frequent words that fall into each hashed feature, and their share of its occurrences.

    Words are counted in their rows first, so that one row of a word and document is shuffled; the hash is that of the model's own
    stage. Of equally frequent words the one that sorts first comes first.
    """
    counts = inlined(df, [], token_counts(tokens), "n").groupBy("word").agg(F.sum("n").alias("n"))
    hashed = hashed_tf(counts.withColumn("_word", F.array("word")), "_word", num_features, "_vector")
    placed = hashed.select("word", "n", F.unwrap_udt("_vector")["indices"][0].alias("feature"))
    by_feature = Window.partitionBy("feature").orderBy(F.desc("n"), "word")
    totals = placed.groupBy("feature").agg(F.sum("n").alias("_all"))
    ranked = placed.withColumn("place", F.row_number().over(by_feature)).where(F.col("place") <= most)
    return ranked.join(totals, "feature").select("feature", "place", "word", "n", (F.col("n") / F.col("_all")).alias("share"))


def named_features(importances: DataFrame, words: DataFrame) -> DataFrame:
    """``feature, importance, words``: an importance table with the words of :func:`bucket_words`, most frequent first."""
    listed = words.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("place", "word", "share"))).alias("_words"))
    names = F.transform("_words", lambda w: F.struct(w["word"].alias("word"), w["share"].alias("share"))).alias("words")
    return importances.join(listed, "feature", "left").select("feature", "importance", names)
