"""Joins that split frequent keys: the sketch's bounds, the rows, and how they are dealt out."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketmill.operators.skew import cut_down, frequent_keys, join_split
from ticketmill.session import join_lookup


def test_summaries_keep_their_bounds():
    rng = random.Random(1)
    for _ in range(300):
        size, rows = rng.choice([1, 3, 10]), [rng.choice([0, 0, 1, rng.randrange(60)]) for _ in range(rng.randrange(1, 300))]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(rows), 17):  # put together part by part
            part = np.array(rows[at : at + 17])
            keys, counts = cut_down(np.concatenate([keys, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), size)
        true, found = collections.Counter(rows), dict(zip(keys.tolist(), counts.tolist()))
        assert len(found) <= size
        for k, n in true.items():
            assert n - len(rows) / size <= found.get(k, 0) <= n


def test_frequent_keys_of_a_table(spark):
    df = spark.range(0, 20_000, 1, 7).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("k"))
    found = frequent_keys(df, F.col("k"), 40)
    assert 9_500 <= found[5] <= 10_000 and len(found) <= 40


@pytest.fixture
def tables(spark):
    rows = [(i, "hot" if i % 2 else f"k{i % 50}" if i % 7 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(5)
    other = spark.createDataFrame([("hot", 1), ("k3", 2), ("k4", 3), ("k4", 4), (None, 5), ("none", 6)], "k string, v int")
    return df, other


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(tables, how):
    df, other = tables
    assert sorted(map(str, join_split(df, other, "k", how, parts=8).collect())) == sorted(map(str, df.join(other, "k", how).collect()))
    assert sorted(map(str, join_lookup(df, other, "k", how, max_rows=0, split=True).collect())) == sorted(map(str, df.join(other, "k", how).collect()))
    assert join_split(df.limit(0), other, "k", how, parts=8).count() == 0


def test_no_task_gets_a_hot_key(spark, tables):
    """A key with half of the rows: no task has more than three times the median's rows."""
    df, other = tables
    df = df.where("k IS NOT NULL")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    for key, value in zip(keys, ("-1", "false", "12")):
        spark.conf.set(key, value)
    try:
        names = df.select("k").distinct().withColumn("v", F.lit(1))
        split = join_split(df, names, "k", "inner").groupBy(F.spark_partition_id()).count().collect()
        plain = df.join(names, "k").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
    sizes, whole = sorted(r["count"] for r in split), [r["count"] for r in plain]
    assert sum(sizes) == sum(whole) == df.count()
    assert max(whole) >= 3000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
