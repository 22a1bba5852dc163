"""Joins that split the keys many rows share: found by a sketch of frequent items, salted, and only those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch for each partition of a join: a key with a quarter of a partition's share cannot escape.
COUNTERS = 4
#: Salts for each partition's share of a key: small enough pieces that it does no harm if some meet in a task.
SALTS = 6
#: Pairs (key, count) that a task gathers before it cuts them down.
GATHERED = 200_000


def cut_down(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra and Gries: equal keys added up, and if more than ``size`` are left, the count of the next largest taken off all of them.

    What is taken off a key is at most the rows seen, over ``size``; summaries put together stay summaries.
    """
    keys, of = np.unique(keys, return_inverse=True)
    counts = np.bincount(of, counts, len(keys)).astype(np.int64)
    if len(keys) > size:
        counts = counts - np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def frequent_keys(df: DataFrame, key: Column, size: int) -> dict[int, int]:
    """Keys (64 bits) with lower bounds of their rows: at most ``size`` of them, each too low by at most the rows over ``size``.

    Every task sends a summary of at most ``size`` counters; they are put together in steps of a few hundred.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            own = batch["key"].to_numpy()
            keys.append(own)
            counts.append(batch["n"].to_numpy())
            held += len(own)
            if held > GATHERED:
                k, n = cut_down(np.concatenate(keys), np.concatenate(counts), size)
                keys, counts, held = [k], [n], 0
        k, n = cut_down(np.concatenate(keys), np.concatenate(counts), size)
        yield pa.record_batch([pa.array(k), pa.array(n)], ["key", "n"])

    schema = "key long, n long"
    found = df.select(key.alias("key"), F.lit(1).cast("long").alias("n")).mapInArrow(run, schema)
    found = found.repartition(8).mapInArrow(run, schema)
    table = found.toArrow()  # at most eight summaries
    keys, counts = cut_down(table["key"].to_numpy(), table["n"].to_numpy(), size)
    return dict(zip(keys.tolist(), counts.tolist()))


def join_split(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner", spread_by: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df.join(other, on, how)`` (inner, left, left_semi or left_anti) in which no key of ``df`` fills a task.

    Rows of a key with more than a partition's share of ``df`` are dealt out by ``spread_by`` (default: a hash of the row, so that
    a task that runs again deals them alike) to ``SALTS`` salts for each of the key's shares, and the rows of ``other`` with that key are
    given to each. All other keys join as they are. ``df`` is read once more for the sketch. Nulls join nothing and stay as they are.
    """
    from ticketmill.session import ship_package  # which uses this module

    on = [on] if isinstance(on, str) else list(on)
    session = df.sparkSession
    ship_package(session)
    parts = parts or int(session.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(*on)
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on))
    counts = frequent_keys(whole, key, COUNTERS * parts)
    # Lower bounds of the rows add up to at most all of them, so that there are few such keys.
    share = max(whole.count() / parts, 1)
    salts = {k: int(-(-(n + share / COUNTERS) * SALTS // share)) for k, n in counts.items() if n + share / COUNTERS >= share}
    if not salts:
        return df.join(other, on, how)
    table = F.broadcast(session.createDataFrame(list(salts.items()), "_hot long, _salts int"))  # fewer than COUNTERS * parts rows

    def salted(rows: DataFrame, salt: Column) -> DataFrame:
        return rows.withColumn("_key", key).join(table, F.col("_key") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_key", "_hot", "_salts")

    spread = F.xxhash64(*df.columns) if spread_by is None else F.xxhash64(spread_by)
    left = salted(df, F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0)))
    right = salted(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
