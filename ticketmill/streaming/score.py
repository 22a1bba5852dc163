"""Score a stream of rows with a fitted pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ticketmill.plans.score import scored_rows


def score_stream(
    model: PipelineModel,
    rows: DataFrame,
    job_id: str,
    path: str,
    checkpoint: str,
    keep: tuple[str, ...] = (),
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    once: bool = True,
    partitions: int | None = None,
) -> StreamingQuery:
    """Append scored rows to a Parquet table, exactly once; stateless, so any rate of input runs without shuffle.

    ``rows`` is any streaming source. ``once`` works off what is there and stops. ``partitions`` spreads the rows
    of a source with too few splits.
    """
    if partitions:
        rows = rows.repartition(partitions)
    writer = (
        scored_rows(model, prepare(rows), job_id, keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
