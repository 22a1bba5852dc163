"""What earlier jobs stored: models, label indices, tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticketmill.sinks.jobs import load_committed


def load_pipeline_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def stage_path(path: str, model: PipelineModel, stage: int) -> str:
    """The folder of a stage of the pipeline saved at ``path``."""
    n = len(model.stages)
    return f"{path}/stages/{stage % n:0{len(str(n))}d}_{model.stages[stage].uid}"


def load_pipeline(path: str) -> Pipeline:
    return Pipeline.load(path)


def load_forest(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def load_job_table(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """The rows of one job: those it committed (:mod:`ticketmill.sinks.jobs`), or those in a table that is partitioned by ``job_id``, of which
    only its files are read."""
    folder, _, table = path.rstrip("/").rpartition("/")
    committed = load_committed(spark, folder, table, job_id)
    if committed is not None:
        return committed
    fields = spark.read.parquet(path).schema.fields
    schema = StructType([StructField(f.name, StringType()) if f.name == "job_id" else f for f in fields])
    return spark.read.schema(schema).parquet(path).where(F.col("job_id") == job_id)


def load_label_index(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return load_job_table(spark, path, job_id).select("label", "group")
