"""Registered queries against DuckDB on the smallest data folder."""

import datetime
import os

import duckdb
import pytest
from conftest import DATA
from pyspark.ml import PipelineModel

import __spark_entry__ as entry_points
from ticketmill.config import ForestParams
from ticketmill.operators import models
from ticketmill.plans import queries

TABLES = ["documents", "labels", "embeddings", "events", "conversations", "benchmark", "pages"]
ORACLE = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.10g}"
    return value.isoformat() if isinstance(value, datetime.datetime) else repr(value)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    result = QUERIES[name](spark, DATA)
    columns = sorted(result.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in result.collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


# Trained at full size; too slow for a test.
SLOW = {"forest_text_full"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_of_other_queries(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_stream_and_batch_scores_agree(spark):
    batch = QUERIES["score_batch"](spark, DATA).select("doc_id", "prediction").collect()
    stream = QUERIES["score_stream"](spark, DATA).select("doc_id", "prediction").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The data folder with its tables as folders of part files."""
    out = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["stream_rows", "windowed_counts"])
def test_streams_read_files_and_folders(spark, folders, name):
    rows = [sorted(map(str, QUERIES[name](spark, d).collect())) for d in (DATA, folders)]
    assert rows[0] == rows[1] and rows[0]


def test_every_call_does_its_work(spark):
    """A second call trains again: it leaves a newer model."""
    path = queries.model_path(spark, DATA, "logistic")
    stamps = []
    for _ in range(2):
        QUERIES["logreg_text"](spark, DATA).count()
        stamps.append(os.stat(path.removeprefix("file:") + "/metadata").st_mtime_ns)
    assert stamps[0] < stamps[1]


def test_saved_model_scores_alike(spark):
    assert [r["same"] for r in QUERIES["model_roundtrip"](spark, DATA).collect()] == [True]


def test_roundtrip_trains_and_both_models_go_the_whole_way(spark, monkeypatch):
    """Every call fits, even with a saved model at hand; the loaded pipeline starts from the text, as the trained one does."""
    rows = [(i, ["red bell and light", "old rim", "light pump spoke", "saddle post"][i % 4], "abcd"[i % 4], "s", 9) for i in range(80)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(queries, "table", lambda spark, folder, name: documents)
    monkeypatch.setattr(queries, "FOREST", ForestParams(num_trees=3, max_depth=3))
    fits, scored = [], []
    fit, transform = models.fit_text, PipelineModel.transform
    monkeypatch.setattr("ticketmill.plans.train.fit_text", lambda *a, **b: (fits.append(a), fit(*a, **b))[1])
    monkeypatch.setattr(PipelineModel, "transform", lambda self, df: (scored.append((self.uid, df.columns)), transform(self, df))[1])
    for _ in range(2):
        result = QUERIES["model_roundtrip"](spark, "/small").collect()
    assert len(fits) == 2 and [r["same"] for r in result] == [True]
    trained, loaded = scored[-2:]
    assert "text" in loaded[1] and "features" not in loaded[1] and loaded[0] == trained[0]


def test_the_text_forest_has_full_size(spark):
    """200 trees of depth 30 with 70 bins over 6,900 features, in ``forest_text`` and the queries that load its model."""
    forest = queries.trained_forest(spark, DATA).stages[-1]
    assert (forest.getNumTrees, forest.getMaxDepth(), forest.getMaxBins(), forest.numFeatures) == (200, 30, 70, 6900)
    words = QUERIES["named_feature_report"](spark, DATA)
    assert words.where("words is null").count() == 0 and words.agg({"feature": "max"}).first()[0] > 1000


def test_hashed_totals_are_token_counts(spark):
    buckets = QUERIES["hashing_tf"](spark, DATA).groupBy("doc_id").sum("tf").collect()
    totals = {r["doc_id"]: r["total"] for r in QUERIES["tf_total"](spark, DATA).collect()}
    assert {r[0]: r[1] for r in buckets} == {k: v for k, v in totals.items() if v}


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200
