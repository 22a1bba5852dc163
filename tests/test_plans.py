"""What the physical plans must not hold, and what the scans must read."""

import re

import pytest
from conftest import DATA

import __spark_entry__ as entry_points
from ticketmill.session import CHECKPOINT_KEY, fits_broadcast, shared_dir, spread

QUERIES = entry_points.queries()
# Queries that return a lazy plan over the tables; the others store results on the way.
LAZY = [
    "tokenize", "term_frequency", "tf_total", "hashing_tf", "stopword_removal", "drop_by_nature", "segment_max_match",
    "segment_all_matches", "segment_protected", "segment_ambiguity", "prepare_text", "class_profile",
    "corpus_profile", "hash_split", "eval_accuracy", "eval_confusion", "eval_per_class", "drop_singleton_classes",
    "stopword_table_removal",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_slow_operators(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "SortAggregate", "InPandas", "Window"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", ["tokenize", "segment_all_matches", "prepare_text", "stopword_removal"])
def test_text_queries_shuffle_nothing_but_small_scans(spark, name):
    exchanges = re.findall(r"Exchange (\w+)", plan_of(QUERIES[name](spark, DATA)))
    assert exchanges in ([], ["RoundRobinPartitioning"])


@pytest.mark.parametrize(
    "name, columns",
    [("hash_split", {"doc_id"}), ("class_profile", {"source"}), ("tokenize", {"doc_id", "text"}),
     ("eval_confusion", {"quality", "toxic"}), ("drop_singleton_classes", {"doc_id", "n_chars"})],
)
def test_scans_read_only_needed_columns(spark, name, columns):
    for fields in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, DATA))):
        assert {f.split(":")[0] for f in fields.split(",")} == columns


def test_preparation_moves_no_text(spark):
    plan = plan_of(QUERIES["prepare_split"](spark, DATA))
    # A small input is spread once below the plan; nothing else carries a text.
    for line in plan.splitlines():
        if "Exchange" in line and "RoundRobinPartitioning" not in line:
            assert "Broadcast" in line or "text" not in line, line
    assert "SortMergeJoin" not in plan


def test_lookups_are_measured_in_partial_sums(spark, monkeypatch):
    """No task counts the rows of all others: what meets in one partition is a sum from each."""
    df = spark.range(100)
    plans = []
    first = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: (plans.append(plan_of(self)), first(self))[1])
    fits_broadcast(df)
    assert "Limit" not in plans[0] and "partial_count" in plans[0]


def test_generated_rows_add_no_filter_below_the_spread(spark):
    """A filter on the array's size would compute the tokens once more in the scan stage."""
    assert "size(regexp_extract_all" not in plan_of(QUERIES["term_frequency"](spark, DATA))


def test_spread_leaves_many_splits_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=2 * cores)).rdd.getNumPartitions() == 2 * cores
    assert "Exchange" not in plan_of(spread(spark.range(10, numPartitions=2 * cores)))
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 2 * cores


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_KEY)
