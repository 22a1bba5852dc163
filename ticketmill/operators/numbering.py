"""Row numbers in a global order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.session import cut_lineage

# monotonically_increasing_id() keeps the partition above this bit and the row within it below.
ROW_BITS = 33


def number_rows(df: DataFrame, order: list[Column], out: str, start: int = 1) -> DataFrame:
    """Add ``out``: the position of each row in ``order`` (which must be a total order), from ``start``.

    Range-partition and sort, store the result once so that its partitions stand still, then add to each row's
    place within its partition the number of rows in the partitions before. The offsets table has one row per
    partition, whatever the data size.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    partition = F.shiftright("_place", ROW_BITS)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + within + F.lit(start)).cast("long"))
        .drop("_part", "_place", "_offset")
    )


def first_seen_index(df: DataFrame, key: str, row: str, pos: str | None = None, out: str = "idx", start: int = 0) -> DataFrame:
    """Index, from ``start``, of the distinct values of ``key`` by first occurrence: by ``row``, then ``pos`` within it.

    ``df`` holds a key at most once per row. Occurrences are combined before the shuffle, so a hot key costs no
    more than others; plain longs (no struct) keep the aggregation hashed instead of sorted.
    """
    within = [F.min_by(pos, row).alias(pos)] if pos else []
    first = df.groupBy(key).agg(F.min(row).alias(row), *within)
    return number_rows(first, [F.col(row), *([F.col(pos)] if pos else [])], out, start)
