"""Session helpers: the shared folder, lineage cuts, scan parallelism, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.operators.skew import join_split

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A side of a join is broadcast only after it was measured and found within both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one named in ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a fresh temporary folder, removed when Python ends; on a cluster a missing
    setting is an error, since a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if context.getCheckpointDir():
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ticketmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(CHECKPOINT_KEY, folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/ticketmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *partition_by: str, outer: bool = False) -> DataFrame:
    """Like :func:`cut_lineage`, as a Parquet table: for wide rows that later steps read by column or partition.

    ``outer``: the copy is a result of the :func:`scratch` block it is made in, and goes with the block around that, if any.
    """
    path = shared_path(df.sparkSession, name)
    if len(_open) > outer:
        _open[-1 - outer].append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Copies that :func:`stored` makes inside the block are deleted when it ends; results must not depend on them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared storage, if it is there."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared storage, or None if it is not there."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in one step: readers see what was there before, or all of it."""
    system, place = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = system.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark._sc._gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, place, kinds)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table's path is a folder of part files (else it is one file)."""
    system, place = _file_system(spark, path)
    return system.getFileStatus(place).isDirectory()


def ship_package(spark: SparkSession) -> None:
    """Put this package on every Python worker, wherever the driver found it; once for an application."""
    context = spark.sparkContext
    if getattr(context, "_ticketmill_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ticketmill-code-"), "ticketmill_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._ticketmill_shipped = True


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row, whatever its columns hold; stored, so that the numbers stand still."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy row work enough tasks when a small input has fewer splits than two per core.

    Large inputs have far more splits than cores and pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * cores:
        return scan
    return scan.repartition(2 * cores)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition for row work that multiplies the data.

    The number of partitions is given, a multiple of the cores and of the session's setting: adaptive execution would
    merge them by the size before that work.
    """
    session = df.sparkSession
    wanted = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return df.repartition(wanted, key)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: its rows and bytes, summed up in partial aggregates."""
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, used = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and used <= max_bytes


def join_lookup(df: DataFrame, lookup: DataFrame, on, how: str, max_rows: int = BROADCAST_ROWS, split: bool = False) -> DataFrame:
    """Join a lookup table, broadcasting it only when its measured size is within bounds.

    Beyond them it is an equi-join, in which adaptive execution splits large partitions, or, with ``split``, one that finds the keys that many
    rows of ``df`` share and splits those (it reads ``df`` once more, with Python workers). The lookup is read once more for the
    measurement, so a computed one should be stored first.
    """
    if fits_broadcast(lookup, max_rows):
        return df.join(F.broadcast(lookup), on, how)
    if not split:
        return df.join(lookup, on, how)
    return join_split(df, lookup, on, how)
