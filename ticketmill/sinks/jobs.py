"""The result tables of a job, seen all at once: they are put aside, and one small file, written last, names them.

Readers find a job's rows through that file alone. A job that ends in between leaves nothing to be seen, and one that runs again under
its id replaces all its tables in one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.session import read_text, remove, write_text

#: Names in an output folder; a leading underscore keeps them out of Spark's own listings.
MANIFESTS, RUNS = "_jobs", "_runs"


def manifest_path(output_dir: str, job_id: str) -> str:
    return f"{output_dir}/{MANIFESTS}/{job_id}.json"


def read_manifest(spark: SparkSession, output_dir: str, job_id: str) -> dict | None:
    """``run`` and ``tables`` of a job that has been committed, else None."""
    text = read_text(spark, manifest_path(output_dir, job_id))
    return None if text is None else json.loads(text)


class JobTables:
    """Put the tables of one run of a job, then commit them."""

    def __init__(self, spark: SparkSession, output_dir: str, job_id: str):
        if not job_id or "/" in job_id:
            raise ValueError("a job id names a file")
        self.spark, self.output_dir, self.job_id = spark, output_dir, job_id
        self.run, self.tables = uuid.uuid4().hex, []

    def put(self, df: DataFrame, table: str) -> None:
        """Write a table of the job, without showing it."""
        df.drop("job_id").write.parquet(f"{self.output_dir}/{RUNS}/{self.run}/{table}")
        self.tables.append(table)

    def commit(self) -> None:
        """Show all tables of this run in the place of those of the run before, whose files then go."""
        before = read_manifest(self.spark, self.output_dir, self.job_id)
        write_text(self.spark, manifest_path(self.output_dir, self.job_id), json.dumps({"run": self.run, "tables": self.tables}))
        if before:
            remove(self.spark, f"{self.output_dir}/{RUNS}/{before['run']}")


def load_committed(spark: SparkSession, output_dir: str, table: str, job_id: str) -> DataFrame | None:
    """The rows of a table of a committed job, with ``job_id``; None if the job, or the table, has not been committed."""
    found = read_manifest(spark, output_dir, job_id)
    if not found or table not in found["tables"]:
        return None
    return spark.read.parquet(f"{output_dir}/{RUNS}/{found['run']}/{table}").withColumn("job_id", F.lit(job_id))
