"""Train job: label index, fit, save, evaluate, put the result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.config import TrainConfig
from ticketmill.operators import evaluate
from ticketmill.operators.labels import label_index
from ticketmill.operators.models import class_names, fit_text, forest
from ticketmill.session import cut_lineage, scratch, stored
from ticketmill.sinks.jobs import JobTables
from ticketmill.sinks.tables import save_stage, write_table


@dataclass(frozen=True)
class TrainResult:
    model: PipelineModel
    label_index: DataFrame
    evaluated: DataFrame
    accuracy: DataFrame


# The columns of the result tables are those that readers of them expect.


def evaluated_predictions(model: PipelineModel, test: DataFrame, job_id: str) -> DataFrame:
    """``group, text, orgtext, label, prediction, job_id``; classes unseen in training count as misses."""
    scored = model.transform(test.where(F.col("group").isNotNull()))
    return scored.select("group", "text", "orgtext", "label", "prediction").withColumn("job_id", F.lit(job_id))


def model_accuracy(evaluated: DataFrame, job_id: str) -> DataFrame:
    return evaluate.accuracy(evaluated).select(
        F.col("accuracy").alias("model_accuracy"), F.lit(job_id).alias("job_id")
    )


def train(
    train_rows: DataFrame,
    test_rows: DataFrame,
    config: TrainConfig,
    target=None,
    id_col: str = "doc_id",
) -> TrainResult:
    """Fit on prepared ``group, text``, evaluate on held-out rows, save the model under its job id.

    All result tables are committed together, after the model has been saved: read them with ``load_job_table``. ``target`` may instead name
    for each table where else it goes (JDBC); then they are written one after the other. Predictions are stored once; the table
    written out and the accuracy both read that. Copies made on the way are gone when the job ends, and a job that runs again under
    its id replaces its rows.
    """
    spark = train_rows.sparkSession
    with scratch(spark):
        index = label_index(train_rows, "group", config.job_id)
        names = class_names(index, config.num_classes)
        model = fit_text(
            train_rows, forest(config.forest), names, config.num_features, id_col, config.fit_partitions
        )
        save_stage(model, config.model_path)
        evaluated = stored(evaluated_predictions(model, test_rows, config.job_id), "evaluated")
        accuracy = cut_lineage(model_accuracy(evaluated, config.job_id))
        tables = {"label_index": index.drop("n"), "evaluated_predictions": evaluated, "model_accuracy": accuracy}
        if target:
            for name, table in tables.items():
                write_table(table, target(config, name))
        else:
            job = JobTables(spark, config.output_dir, config.job_id)
            for name, table in tables.items():
                job.put(table, name)
            job.commit()
    return TrainResult(model, index, evaluated_predictions(model, test_rows, config.job_id), accuracy)
