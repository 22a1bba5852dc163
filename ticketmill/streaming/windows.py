"""Counts per time window over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketmill.session import exists


def windowed_counts(rows: DataFrame, time_col: str, key: str, length: str, lateness: str) -> DataFrame:
    """``window_start, key, n``; works on batch and streaming frames. Rows later than ``lateness`` are dropped."""
    timed = rows.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if rows.isStreaming:
        timed = timed.withWatermark(time_col, lateness)
    return (
        timed.groupBy(F.window(time_col, length), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), key, "n")
    )


def write_updates(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the groups that each batch changed; state is bounded by the watermark.

    A batch that is run again replaces its own folder, so the table holds each batch once.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def latest(updates: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """The last written value of each group."""
    return updates.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def write_closed(rows: DataFrame, time_col: str, key: str, length: str, lateness: str, path: str, checkpoint: str, once: bool = True) -> list[StreamingQuery]:
    """Write each window of :func:`windowed_counts` once, when the watermark has passed its end, to ``path/closed``, and the rows that came too late
    for theirs, by batch, to ``path/late`` (batch, window_start, key, n).

    Two queries read the stream: one counts, in append mode; the other follows the same watermark, the latest time of the batches before less
    ``lateness``, which it keeps by batch beside its rows, so that a batch that is run again finds the same. Both cut the stream into the same
    batches if the source does (files: by their number, set on the source).
    """
    spark = rows.sparkSession
    closed = windowed_counts(rows, time_col, key, length, lateness).writeStream.outputMode("append").format("parquet")
    closed = closed.option("path", f"{path}/closed").option("checkpointLocation", f"{checkpoint}/closed")
    times = f"{path}/times"

    def late(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn(time_col, F.col(time_col).cast("timestamp")).persist()
        latest_time = timed.agg(F.max(time_col).alias("latest"))
        before = spark.read.parquet(times).where(F.col("batch") < batch_id) if exists(spark, times) else None
        mark = None if before is None else before.agg(F.max("latest")).first()[0]
        ends = timed.select(F.window(time_col, length).alias("w"), key)
        gone = ends.where("false") if mark is None else ends.where(F.col("w.end") <= F.lit(mark) - F.expr(f"INTERVAL {lateness}"))
        counted = gone.groupBy(F.col("w.start").alias("window_start"), key).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        latest_time.write.mode("overwrite").parquet(f"{times}/batch={batch_id}")
        timed.unpersist()

    watched = rows.select(time_col, key).writeStream.foreachBatch(late).option("checkpointLocation", f"{checkpoint}/late")
    # With several stateful operators in a query Spark drops late rows by the watermark of a batch earlier; this query has one.
    setting = "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return [w.trigger(availableNow=True).start() if once else w.start() for w in (closed, watched)]
    finally:
        spark.conf.set(setting, before)
