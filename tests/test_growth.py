"""Jobs that are seen at once, sketches that merge, vocabularies that grow, windows that close, features by name."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from ticketmill.functions.tokens import whitespace_tokens
from ticketmill.operators import corpus
from ticketmill.operators.features import bucket_words, named_features
from ticketmill.sinks.jobs import JobTables, load_committed, read_manifest
from ticketmill.sources.saved import load_job_table
from ticketmill.streaming import windows


def tokens():
    return whitespace_tokens(F.col("t"))


def test_a_job_is_seen_when_all_its_tables_are_there(spark, tmp_path):
    out = str(tmp_path / "out")

    def run(n, tables):
        job = JobTables(spark, out, "7")
        for name in tables:
            job.put(spark.range(n), name)
        return job

    run(1, ["a"])  # ends between two tables
    assert read_manifest(spark, out, "7") is None and load_committed(spark, out, "a", "7") is None
    run(2, ["a", "b"]).commit()
    assert [load_job_table(spark, f"{out}/{t}", "7").count() for t in ("a", "b")] == [2, 2]
    run(3, ["a"])  # a rerun that ends too early changes nothing
    assert load_job_table(spark, f"{out}/a", "7").count() == 2
    run(4, ["a", "b"]).commit()
    rows = load_job_table(spark, f"{out}/b", "7")
    assert rows.count() == 4 and rows.columns == ["id", "job_id"] and rows.first()["job_id"] == "7"
    assert load_committed(spark, out, "c", "7") is None
    with pytest.raises(ValueError):
        JobTables(spark, out, "a/b")


def test_merged_sketches_are_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(k % 3, rng.choice("xyz"), " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60)))) for k in range(400)]
    df = spark.createDataFrame(rows, "part int, g string, t string").repartition(5)
    by_part = corpus.profile_sketches(df, "g", "t", tokens(), F.col("part")).cache()
    assert by_part.count() == 9
    merged = {r["kind"]: r for r in corpus.merged_profile(by_part).collect()}
    whole = {r["kind"]: r for r in corpus.merged_profile(corpus.profile_sketches(df, "g", "t", tokens(), F.lit(0))).collect()}
    exact = {r["kind"]: r for r in corpus.corpus_profile(df, "g", "t", tokens()).collect()}
    for kind, r in exact.items():
        assert (merged[kind]["n_rows"], merged[kind]["n_chars"]) == (r["n_rows"], r["n_chars"])
        assert merged[kind]["n_distinct"] == whole[kind]["n_distinct"]
        assert abs(merged[kind]["n_distinct"] - r["n_distinct"]) <= 0.03 * r["n_distinct"] + 1
    lengths = sorted(len(w) for _, _, t in rows for w in set(t.split()))
    assert abs(merged["word"]["median_chars"] - lengths[len(lengths) // 2]) <= 1


def test_vocabulary_in_batches_is_that_of_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(6)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, t string").repartition(3)
    path = str(tmp_path / "v")
    for low, high in ((0, 20), (20, 21), (21, 60), (30, 60)):  # the last one holds nothing new
        grown = corpus.grow_vocabulary(path, df.where(F.col("doc_id").between(low, high - 1)), "doc_id", tokens())
    at_once = {r["word"]: r["idx"] for r in corpus.vocab_index(df, "doc_id", tokens()).collect()}
    assert {r["word"]: r["idx"] for r in grown.collect()} == at_once


def test_closed_windows_and_late_rows(spark, tmp_path):
    """Files in a random order, one a batch: windows hold the rows in time, and each row that came too late is counted."""
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    batches = [[(start + datetime.timedelta(minutes=rng.randrange(60 * k, 60 * k + 200)), rng.choice("ab")) for _ in range(25)] for k in range(8)]
    rng.shuffle(batches)
    batches.append([(start + datetime.timedelta(days=30), "a")])
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, key string").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        part = next((tmp_path / f"part{k}").glob("*.parquet"))
        target = tmp_path / "in" / f"{k}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = spark.readStream.schema("ts timestamp, key string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for query in windows.write_closed(rows, "ts", "key", "1 hour", "90 minutes", str(tmp_path / "out"), str(tmp_path / "progress")):
        query.awaitTermination()
    mark, in_time, late = None, {}, {}
    for k, part in enumerate(batches):
        for ts, key in part:
            window = ts.replace(minute=0)
            to = late if mark and window + datetime.timedelta(hours=1) <= mark else in_time
            name = (k, window, key) if to is late else (window, key)
            to[name] = to.get(name, 0) + 1
        newest = max(ts for ts, _ in part) - datetime.timedelta(minutes=90)
        mark = max(mark, newest) if mark else newest
    closed = {(r["window_start"], r["key"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out/closed").collect()}
    assert closed == {k: n for k, n in in_time.items() if k[0] + datetime.timedelta(hours=1) <= mark}
    found = {(r["batch"], r["window_start"], r["key"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out/late").collect()}
    assert found == late and late


def test_features_have_names(spark):
    df = spark.createDataFrame([("a b c a",), ("a d e f g h",), ("",)], "t string")
    words = bucket_words(df, tokens(), 3, most=2).collect()
    assert {r["feature"] for r in words} <= {0, 1, 2}
    top = {}
    for r in words:
        top.setdefault(r["feature"], []).append((r["place"], r["word"], r["n"], r["share"]))
    for rows in top.values():
        rows.sort()
        assert [p for p, *_ in rows] == list(range(1, len(rows) + 1)) and rows[0][2] >= rows[-1][2]
        assert sum(s for *_, s in rows) <= 1
    assert [r for rows in top.values() for r in rows if r[1] == "a"][0][2] == 3
    report = spark.createDataFrame([(0, 0.7), (1, 0.3), (99, 0.0)], "feature int, importance double")
    named = {r["feature"]: r["words"] for r in named_features(report, spark.createDataFrame(words)).collect()}
    assert set(named) == {0, 1, 99} and named[99] is None
