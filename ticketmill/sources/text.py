"""Ticket CSV files, word lists and dictionaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.sources.records import read_records

# Charsets that Spark reads without further settings.
STANDARD_CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}

TICKET_COLUMNS = ["group", "orgtext"]


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    """Other Java charsets (GB2312, GBK) need a session setting, read when the scan runs."""
    if encoding.upper().replace("UTF8", "UTF-8") not in STANDARD_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_tickets(
    spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True
) -> DataFrame:
    """``group, orgtext`` from the first two CSV fields; missing fields become ''."""
    return read_numbered_tickets(spark, path, encoding, header).drop("doc_id")


def read_numbered_tickets(
    spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True
) -> DataFrame:
    """:func:`read_tickets` with ``doc_id``, the 1-based position in path and file order. Quoted fields may hold line breaks; files
    are read in parallel splits all the same (see :mod:`ticketmill.sources.records`)."""
    _allow_charset(spark, encoding)
    return read_records(spark, path, TICKET_COLUMNS, encoding, header)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", optional: bool = False) -> DataFrame:
    """``value``: the lines of a text file. A missing file is an error unless ``optional``."""
    try:
        if encoding.upper() in ("UTF-8", "UTF8"):
            return spark.read.text(path)
        _allow_charset(spark, encoding)
        # The text source knows UTF-8 only; a CSV of one field that nothing separates or quotes reads lines.
        reader = spark.read.schema("value string").option("encoding", encoding)
        return reader.option("sep", "\u0001").option("quote", "").csv(path)
    except AnalysisException as error:
        if optional and "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return spark.createDataFrame([], "value string")
        raise


def read_words(spark: SparkSession, path: str, encoding: str = "UTF-8", optional: bool = False) -> DataFrame:
    """``word``: distinct trimmed terms, one per line; byte-order mark and blank lines dropped."""
    lines = read_lines(spark, path, encoding, optional)
    word = F.regexp_replace("value", r"^[\s\x{feff}]+|[\s\x{feff}]+$", "").alias("word")
    return lines.select(word).where(F.col("word") != "").distinct()


def read_protected(
    spark: SparkSession, path: str, encoding: str = "UTF-8", optional: bool = False
) -> DataFrame:
    """``word, nature, priority``: phrases that segmentation keeps whole."""
    return read_words(spark, path, encoding, optional).withColumns({"nature": F.lit("n"), "priority": F.lit(1)})


def read_dictionary(
    spark: SparkSession, path: str, encoding: str = "UTF-8", optional: bool = False
) -> DataFrame:
    """``word, nature, priority`` from ``word [TAB nature]`` lines; the nature may be missing."""
    fields = F.split("word", "\t")
    return read_words(spark, path, encoding, optional).select(
        F.trim(fields[0]).alias("word"), F.trim(F.get(fields, F.lit(1))).alias("nature"), F.lit(0).alias("priority")
    )


def read_rules(spark: SparkSession, path: str, encoding: str = "UTF-8", optional: bool = False) -> DataFrame:
    """``phrase, parts``: ambiguity rules, tab-separated, plain or as the cells of a saved HTML table.

    A line is ``phrase TAB word TAB nature [TAB word TAB nature ...]``. Of several rules for a phrase the one with
    the fewest parts stays, then the one whose parts sort first: a choice that no order of files or tasks changes.
    """
    row = F.regexp_replace("value", r"^\s*<td[^>]*>|</td>\s*$", "")
    fields = F.transform(F.split(row, "\t"), lambda f: F.trim(f))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("fields") - 2, F.lit(2)),
        lambda i: F.struct(
            F.get(F.col("fields"), i).alias("word"), F.get(F.col("fields"), i + 1).alias("nature")
        ),
    )
    return (
        read_lines(spark, path, encoding, optional)
        .select(fields.alias("fields"))
        .where(F.size("fields") >= 3)
        .select(F.col("fields")[0].alias("phrase"), pairs.alias("parts"))
        .groupBy("phrase")
        .agg(F.min(F.struct(F.size("parts").alias("n"), "parts"))["parts"].alias("parts"))
    )
