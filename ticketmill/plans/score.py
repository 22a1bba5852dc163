"""Score job: apply a saved pipeline to prepared rows, labelled or not."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.config import ScoreConfig
from ticketmill.operators.forests import with_predictions
from ticketmill.sinks.jobs import JobTables
from ticketmill.sinks.tables import write_table
from ticketmill.sources.saved import load_pipeline_model, stage_path


def scored_rows(model: PipelineModel, rows: DataFrame, job_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``job_id, text, orgtext, label, prediction``; ``label`` is null where the rows carry no class."""
    return score_columns(model.transform(rows), job_id, keep)


def score_columns(scored: DataFrame, job_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    label = F.col("label") if "label" in scored.columns else F.lit(None).cast("double")
    return scored.select(
        *keep, F.lit(job_id).alias("job_id"), "text", "orgtext", label.alias("label"), "prediction"
    )


def saved_scores(path: str, rows: DataFrame, job_id: str) -> DataFrame:
    """:func:`scored_rows` of the pipeline saved at ``path``. A forest at its end votes on blocks of rows, with the same result."""
    model = load_pipeline_model(path)
    if not isinstance(model.stages[-1], RandomForestClassificationModel) or model.stages[-1].isSet("thresholds"):
        return scored_rows(model, rows, job_id)
    hashed = PipelineModel(model.stages[:-1]).transform(rows)
    return score_columns(with_predictions(hashed, stage_path(path, model, -1)), job_id)


def scored_unlabelled(model: PipelineModel, rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """``id, text, probability, prediction`` with the probability as an array."""
    return model.transform(rows).select(
        *id_cols, "text", vector_to_array("probability").alias("probability"), "prediction"
    )


def score(rows: DataFrame, config: ScoreConfig, target=None) -> DataFrame:
    """Put the scored rows of prepared ``text, orgtext`` as the job's table ``scored``, or into ``target``; one narrow stage."""
    scored = saved_scores(config.model_path, rows, config.job_id)
    if target:
        write_table(scored, target)
    else:
        job = JobTables(rows.sparkSession, config.output_dir, config.job_id)
        job.put(scored, "scored")
        job.commit()
    return scored
