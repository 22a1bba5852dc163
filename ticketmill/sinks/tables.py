"""Put job results into tables, as Parquet partitioned by job or over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ParquetTarget:
    path: str


@dataclass(frozen=True)
class JdbcTarget:
    """Connection settings come from the caller; ``max_connections`` bounds the writers on the database."""

    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict)
    max_connections: int = 16


def write_table(df: DataFrame, target: ParquetTarget | JdbcTarget) -> None:
    """Add the rows of ``df``, which carries ``job_id``. In a Parquet table they replace the rows of the same job, so a job
    that runs again leaves each row once; JDBC tables are appended to, as Spark's writer cannot replace some rows."""
    if "job_id" not in df.columns:
        raise ValueError("result tables carry job_id")
    if isinstance(target, JdbcTarget):
        options = {**target.properties, "numPartitions": str(target.max_connections)}
        df.write.mode("append").jdbc(target.url, target.table, properties=options)
    else:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("job_id").parquet(target.path)


def save_stage(stage: MLWritable, path: str) -> None:
    """Save a fitted or unfitted pipeline or model, replacing what is there."""
    stage.write().overwrite().save(path)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """At most ``rows`` rows, for looking at a result."""
    return df.limit(rows)
