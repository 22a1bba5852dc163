"""Train, save, load, score, evaluate; batch and stream."""

import os
import subprocess
import sys

import pytest
from conftest import DATA, TICKETS, WORDS
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketmill import PrepConfig, ScoreConfig, TrainConfig, prepare_text, score, train
from ticketmill.config import ForestParams
from ticketmill.operators import evaluate, labels, models
from ticketmill.operators.features import array_features, assemble, hashed_tf, sparse_entries
from ticketmill.plans.lexicon import Lexicon
from ticketmill.plans.score import scored_unlabelled
from ticketmill.session import shared_dir
from ticketmill.sinks.tables import save_stage
from ticketmill.sources import saved
from ticketmill.streaming.score import score_stream
from ticketmill.streaming.windows import latest, windowed_counts, write_updates

LEXICON = Lexicon(WORDS, ["了"])
SMALL = ForestParams(num_trees=5, max_depth=4, max_bins=16, impurity="entropy")


@pytest.fixture(scope="module")
def prepared(spark, tickets):
    return prepare_text(tickets, LEXICON, PrepConfig()).cache()


@pytest.fixture(scope="module")
def trained(spark, prepared, tmp_path_factory):
    out = tmp_path_factory.mktemp("train")
    config = TrainConfig("7", f"{out}/models", f"{out}/tables", num_features=256, forest=SMALL, fit_partitions=2)
    return config, train(prepared, prepared, config)


def test_train_job_writes_its_tables(spark, trained):
    config, result = trained
    index = saved.load_label_index(spark, f"{config.output_dir}/label_index", "7")
    assert index.count() == 4
    evaluated = saved.load_job_table(spark, f"{config.output_dir}/evaluated_predictions", "7")
    assert set(evaluated.columns) == {"group", "text", "orgtext", "label", "prediction", "job_id"}
    assert evaluated.count() == len(TICKETS)
    accuracy = saved.load_job_table(spark, f"{config.output_dir}/model_accuracy", "7").first()["model_accuracy"]
    metric = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(evaluated)
    assert accuracy == pytest.approx(metric)


def test_settings_reach_the_forest(trained):
    forest = trained[1].model.stages[-1]
    assert forest.getImpurity() == "entropy" and forest.getNumTrees == 5 and forest.getMaxDepth() == 4
    assert forest.getSeed() == 1234


def test_a_job_that_runs_again_replaces_its_rows(spark, prepared, tmp_path):
    config = TrainConfig("3", f"{tmp_path}/m", f"{tmp_path}/t", num_features=64, forest=SMALL)
    before = os.listdir(shared_dir(spark) + f"/ticketmill/{spark.sparkContext.applicationId}")
    for _ in range(2):
        train(prepared, prepared, config)
    assert os.listdir(shared_dir(spark) + f"/ticketmill/{spark.sparkContext.applicationId}") == before
    index = saved.load_label_index(spark, f"{config.output_dir}/label_index", "3")
    coded = labels.encode(prepared.select("doc_id", "group"), index, "group")
    assert labels.decode(coded, index, "label", "name").count() == len(TICKETS)
    assert saved.load_job_table(spark, f"{config.output_dir}/evaluated_predictions", "3").count() == len(TICKETS)
    train(prepared, prepared, TrainConfig("4", f"{tmp_path}/m", f"{tmp_path}/t", num_features=64, forest=SMALL))
    assert saved.load_label_index(spark, f"{config.output_dir}/label_index", "3").count() == 4


def test_missing_labels_are_misses(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (0.0, None), (0.0, 1.0)], "label double, prediction double")
    right, wrong = evaluate.accuracy(df).first(), evaluate.test_error(df).first()
    assert (right["n_correct"], wrong["n_wrong"]) == (1, 3) and right["accuracy"] + wrong["test_error"] == 1
    assert evaluate.misclassified(df).count() == 3


REPEATED = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from ticketmill.plans import queries
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
)
rows = queries.forest_numeric(spark, sys.argv[3]).collect() + queries.forest_binary(spark, sys.argv[3]).collect()
print("ROWS", hashlib.md5(str(sorted(map(str, rows))).encode()).hexdigest())
"""


def test_numeric_forests_are_the_same_in_two_processes(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import hashlib" + REPEATED
    found = {
        subprocess.run([sys.executable, "-c", code, root, str(tmp_path), DATA], capture_output=True, text=True, timeout=300).stdout
        for _ in range(2)
    }
    assert len(found) == 1 and found.pop().startswith("ROWS")


def test_model_path_carries_the_job(trained):
    config, _ = trained
    assert config.model_path.endswith("job_id=7")
    saved.load_pipeline_model(config.model_path)


def test_loaded_model_scores_alike(spark, trained, prepared):
    config, result = trained
    again = saved.load_pipeline_model(config.model_path)

    def scores(model):
        rows = model.transform(prepared).select("doc_id", vector_to_array("probability"), "prediction").collect()
        return sorted(tuple(r) for r in rows)

    assert scores(again) == scores(result.model)
    assert all(sum(p) == pytest.approx(1) for _, p, _ in scores(again))


def test_score_job_with_and_without_class(spark, trained, prepared, tmp_path):
    config, _ = trained
    for rows, labelled in ((prepared, True), (prepared.drop("group"), False)):
        out = str(tmp_path / str(labelled))
        score(rows, ScoreConfig("9", config.model_path, out))
        table = saved.load_job_table(spark, f"{out}/scored", "9")
        assert set(table.columns) == {"job_id", "text", "orgtext", "label", "prediction"}
        assert table.count() == len(TICKETS)
        assert table.where("label is null").count() == (0 if labelled else len(TICKETS))


def test_unknown_class_is_a_miss_not_an_error(spark, trained, prepared):
    rows = prepared.withColumn("group", F.lit("new"))
    scored = trained[1].model.transform(rows)
    assert evaluate.accuracy(scored).first()["accuracy"] == 0.0


def test_refit_gives_the_same_trees(spark, trained, prepared, tmp_path):
    config, result = trained
    again = TrainConfig("8", f"{tmp_path}/m", f"{tmp_path}/t", num_features=256, forest=SMALL, fit_partitions=2)
    other = train(prepared.repartition(5), prepared, again)

    def trees(model):
        return model.stages[-1].toDebugString.split("\n", 1)[1]

    assert trees(other.model) == trees(result.model)


def test_declared_classes_are_checked(spark, prepared, tmp_path):
    with pytest.raises(ValueError):
        train(prepared, prepared, TrainConfig("1", f"{tmp_path}/m", f"{tmp_path}/t", num_classes=2, forest=SMALL))
    with pytest.raises(ValueError):
        ForestParams(max_depth=31)


def test_forest_saves_and_reports(spark, trained, tmp_path):
    forest = trained[1].model.stages[-1]
    save_stage(forest, f"{tmp_path}/forest")
    again = saved.load_forest(f"{tmp_path}/forest")
    assert isinstance(again, RandomForestClassificationModel)
    report = {r["tree"]: r for r in models.tree_report(spark, f"{tmp_path}/forest").collect()}
    trees = dict(enumerate(zip(again.trees, again.treeWeights)))
    assert {i: (r["depth"], r["n_nodes"], r["weight"]) for i, r in report.items()} == {
        i: (t.depth, t.numNodes, w) for i, (t, w) in trees.items()
    }
    importance = {r["feature"]: r["importance"] for r in models.feature_report(spark, f"{tmp_path}/forest").collect()}
    known = again.featureImportances
    assert importance == pytest.approx({int(i): v for i, v in zip(known.indices, known.values)})


def test_hashing_goldens(spark):
    # Buckets of HashingTF with 6900 features.
    known = {"spark": 1086, "abcd": 5500, "x": 822}
    df = spark.createDataFrame([([w, w],) for w in known], "words array<string>")
    rows = hashed_tf(df, "words", 6900).select("words", F.inline(sparse_entries("features"))).collect()
    assert {r["words"][0]: (r["bucket"], r["tf"]) for r in rows} == {w: (b, 2.0) for w, b in known.items()}
    assert HashingTF(numFeatures=6900).indexOf("spark") == 1086


def test_logistic_pipeline_saves_fits_and_scores(spark, tmp_path):
    rows = [(0, "red bell and light", 1.0), (1, "old rim", 0.0), (2, "light pump spoke", 1.0), (3, "saddle post", 0.0)]
    data = spark.createDataFrame(rows, "id long, text string, label double")
    pipeline = models.text_pipeline()
    save_stage(pipeline, f"{tmp_path}/unfit")
    model = saved.load_pipeline(f"{tmp_path}/unfit").fit(data)
    save_stage(model, f"{tmp_path}/fit")
    save_stage(model, f"{tmp_path}/fit")
    test = spark.createDataFrame(
        [(4, "light frame"), (5, "chain"), (6, "saddle light"), (7, "post rim")], "id long, text string"
    )
    scored = scored_unlabelled(saved.load_pipeline_model(f"{tmp_path}/fit"), test, ["id"]).orderBy("id").collect()
    assert [r["id"] for r in scored] == [4, 5, 6, 7] and scored[3]["prediction"] == 0.0
    assert all(sum(r["probability"]) == pytest.approx(1) for r in scored)
    assert all(r["prediction"] == float(r["probability"][1] > 0.5) for r in scored)
    fitted = model.transform(data).where("prediction = label")
    assert fitted.count() == 4


def test_numeric_forest_decodes_labels(spark):
    rows = [(float(i % 7), float(i % 2) * 9, float(i % 3), 1.0, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, label double")
    df = assemble(df, ["f0", "f1", "f2", "f3"])
    df = df.withColumn("id", F.monotonically_increasing_id())
    scored = models.fit_numeric_forest(df, "label", "id").transform(df)
    assert scored.where("cast(predicted_label as double) = label").count() == 60
    assert evaluate.test_error(scored, "indexed_label").first()["n_wrong"] == 0
    rare = df.withColumn("label", F.when(F.col("id") == df.agg(F.max("id")).first()[0], 7.0).otherwise(F.col("label")))
    part = rare.where("label < 7")
    scored = models.fit_numeric_forest(part, "label", "id", rare).transform(rare)
    assert evaluate.test_error(scored, "indexed_label").first()["n_wrong"] == 1
    binary = models.fit_small_forest(df, "id")
    assert binary.getNumTrees == 3
    assert evaluate.test_error(binary.transform(df)).first()["test_error"] == 0.0


def test_metrics_by_hand(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    assert evaluate.accuracy(df).first()["accuracy"] == pytest.approx(0.5)
    assert evaluate.test_error(df).first()["n_wrong"] == evaluate.misclassified(df).count() == 3
    rows = {r["class"]: r for r in evaluate.per_class(df).collect()}
    assert rows[0.0]["precision"] == pytest.approx(0.5) and rows[0.0]["recall"] == pytest.approx(2 / 3)
    assert rows[2.0]["precision"] == 0.0 and rows[2.0]["f1"] == 0.0


def test_array_features(spark):
    df = spark.createDataFrame([([1.0, 2.5],)], "e array<float>")
    assert list(array_features(df, "e").first()["features"]) == [1.0, 2.5]


def test_stream_scores_like_batch(spark, trained, tickets, tmp_path):
    config, result = trained
    tickets.select("doc_id", "orgtext").repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("doc_id long, orgtext string").parquet(f"{tmp_path}/in")
    query = score_stream(
        result.model, rows, "5", f"{tmp_path}/out", f"{tmp_path}/ck", keep=("doc_id",),
        prepare=lambda df: prepare_text(df, LEXICON, PrepConfig()),
    )
    query.awaitTermination()
    streamed = {r["doc_id"]: r["prediction"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {r["doc_id"]: r["prediction"] for r in result.model.transform(prepare_text(tickets, LEXICON)).collect()}
    assert streamed == batch


def test_windows_over_several_batches(spark, tmp_path):
    events = spark.sql(
        "select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 10 as int)) as ts,"
        " if(id % 3 = 0, 'hot', concat('k', id % 5)) as kind from range(60)"
    )
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 20).parquet(f"{tmp_path}/in")
    reader = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1)
    rows = reader.parquet(f"{tmp_path}/in")
    counts = windowed_counts(rows, "ts", "kind", "1 hour", "1 day")
    write_updates(counts, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = latest(spark.read.parquet(f"{tmp_path}/out"), ["window_start", "kind"]).collect()
    want = windowed_counts(events, "ts", "kind", "1 hour", "1 day").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
