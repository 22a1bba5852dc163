"""Records of delimited text whose quoted fields may hold line breaks, read in parallel splits.

Whether a line begins inside quotes depends on all lines before it, and a split starts at any line. So every split is first read as if
it began outside and as if it began inside quotes: it gives a function from one state to another, and these are composed along the
splits of each file, a row a split. A second pass over the lines then knows where records begin and which number they have; only
lines of records that go over several lines are moved.

Fields are parted as Python's ``csv`` does by default: a field that begins with a quote goes on to the closing one, a doubled quote
is a quote, what follows the closing quote belongs to the field, and quotes elsewhere are text. Records end with a line feed, or
a carriage return and a line feed. Empty lines between records are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketmill.session import cut_lineage, join_lookup, ship_package

UTF_8 = ("UTF-8", "UTF8")
#: Charsets in which a byte of another character can look like a line feed.
WIDE_CHARSETS = ("UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-32BE", "UTF-32LE")


class Dialect:
    """Patterns for one separator."""

    def __init__(self, sep: str):
        if len(sep) != 1 or sep in '"\r\n':
            raise ValueError("the separator is one character, no quote and no line break")
        other, rest = f"[^{re.escape(sep)}]*+", r'(?:[^"]++|"")*+"'
        field = f'(?:"{rest}{other}|(?!"){other})'
        more = f"(?:{re.escape(sep)}{field})*+\\Z"
        self.closed_outside, self.closed_inside = re.compile(field + more), re.compile(rest + other + more)
        self.field = re.compile(f'"((?:[^"]++|"")*+)(?:"({other}))?|({other})')

    def ends_inside(self, line: str) -> tuple[bool, bool]:
        """Whether a line ends inside quotes if it began outside, and if it began inside of them."""
        if '"' not in line:
            return False, True
        return not self.closed_outside.match(line), not self.closed_inside.match(line)

    def fields(self, record: str, n: int) -> list[str]:
        """The first ``n`` fields, '' where there are fewer."""
        out, at = [], 0
        while len(out) < n:
            found = self.field.match(record, at)
            quoted, after, plain = found.groups()
            out.append(plain if quoted is None else quoted.replace('""', '"') + (after or ""))
            at = found.end() + 1
            if at > len(record):
                break
        return out + [""] * (n - len(out))


class _Walk:
    """One split under one assumption: whether we are inside quotes, and how many records have begun."""

    def __init__(self, inside: bool):
        self.inside, self.records = inside, 0

    def step(self, blank: bool, after: tuple[bool, bool]) -> tuple[bool, int, bool]:
        """(inside before, records so far, inside after) of the next line."""
        before = self.inside
        if not before and not blank:
            self.records += 1
        self.inside = after[before]
        return before, self.records, self.inside


def read_lines_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, block (where its split begins) and line, parted at line feeds, in any charset that keeps ASCII's bytes to ASCII.

    The text source hands bytes on as they are, so that other charsets are decoded here, line by line.
    """
    if encoding.upper() in WIDE_CHARSETS:
        raise ValueError(f"{encoding} files cannot be parted at line feeds")
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper() in UTF_8 else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"))


def _walked(batches: Iterator[pa.RecordBatch], dialect: Dialect) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of lines with, for each line, its steps outside and inside, its number in its split, and whether it would end inside
    quotes if it began a record."""
    current, walks, n = None, (), 0
    for batch in batches:
        steps = []
        for file, block, line in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["line"].to_pylist()):
            if (file, block) != current:
                current, walks, n = (file, block), (_Walk(False), _Walk(True)), 0
            after, blank = dialect.ends_inside(line), line in ("", "\r")
            steps.append((walks[0].step(blank, after), walks[1].step(blank, after), n, after[0]))
            n += 1
        yield batch, steps


def split_functions(lines: DataFrame, sep: str = ",") -> DataFrame:
    """A row a split: file, block, its lines, and for either state at its start the state at its end and its records."""
    dialect = Dialect(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for batch, steps in _walked(batches, dialect):
            for file, block, (outside, inside, n, _) in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), steps):
                found[file, block] = (n + 1, outside[2], inside[2], outside[1], inside[1])
        if found:
            columns = [*zip(*found), *zip(*found.values())]
            yield pa.record_batch([pa.array(c) for c in columns], ["file", "block", "lines", "out_outside", "out_inside", "n_outside", "n_inside"])

    schema = "file string, block long, lines long, out_outside boolean, out_inside boolean, n_outside long, n_inside long"
    return lines.mapInArrow(run, schema)


def resolve_splits(functions: DataFrame) -> DataFrame:
    """A row a split: whether it starts and ends inside quotes, and how many records begin before it, in all files and in its own,
    and in how many files up to its own.

    The state at a split's start is that after the last split before it whose end does not depend on its start, turned as often
    as splits between them turn it. Files go by their path.
    """
    fixed, turns = F.col("out_outside") == F.col("out_inside"), (F.col("out_outside") & ~F.col("out_inside")).cast("long")
    own = Window.partitionBy("file").orderBy("block")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    turned = functions.withColumn("turned", F.sum(turns).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.coalesce(F.max("turned").over(earlier), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("turned")), ignorenulls=True).over(earlier), F.lit(0))
    last = F.coalesce(F.last(F.when(fixed, F.col("out_outside").cast("long")), ignorenulls=True).over(earlier), F.lit(0))
    known = turned.withColumn("inside", (last + since) % 2 == 1)
    known = known.withColumn("n", F.when(F.col("inside"), F.col("n_inside")).otherwise(F.col("n_outside")))
    known = known.withColumn("ends_inside", F.when(F.col("inside"), F.col("out_inside")).otherwise(F.col("out_outside")))
    known = known.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One row a file: what the files before it have.
    files = known.groupBy("file").agg(F.sum("n").alias("all"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        F.col("file").alias("_file"),
        F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"),
        (F.coalesce(F.sum((F.col("all") > 0).cast("long")).over(before), F.lit(0)) + 1).alias("file_no"),
    )
    joined = known.join(files, F.col("file") == F.col("_file"))
    return joined.select("file", "block", "lines", "inside", "ends_inside", "in_file", (F.col("before") + F.col("in_file")).alias("before"), "file_no")


def unclosed_files(splits: DataFrame) -> DataFrame:
    """Files that end inside quotes."""
    last = splits.groupBy("file").agg(F.max_by("ends_inside", "block").alias("open"))
    return last.where("open").select("file")


def read_records(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8", header: bool = True, sep: str = ",", strict: bool = True) -> DataFrame:
    """``doc_id`` and the first fields of each record, as strings ('' where a record has fewer).

    ``doc_id`` is the 1-based place of the record among those of all files, in path and file order. ``header``: the first record of each file
    is none. A file that ends inside quotes is an error, or, if not ``strict``, its last record goes to its end.
    """
    ship_package(spark)
    dialect, n = Dialect(sep), len(columns)
    lines = read_lines_of(spark, path, encoding)
    splits = cut_lineage(resolve_splits(split_functions(lines, sep)))
    if strict:
        wrong = [r[0] for r in unclosed_files(splits).limit(3).collect()]
        if wrong:
            raise ValueError(f"a quoted field is not closed in {', '.join(wrong)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, steps in _walked(batches, dialect):
            # A line that is a whole record, if it begins outside quotes, is parted at once.
            parted = [None if s[3] else dialect.fields(t.removesuffix("\r"), n) for t, s in zip(batch["line"].to_pylist(), steps)]
            arrays = [batch["file"], batch["block"], pa.array([s[2] for s in steps], pa.int64()), batch["line"], pa.array(parted, pa.list_(pa.string()))]
            names = ["file", "block", "n", "line", "fields"]
            for k, state in enumerate(("outside", "inside")):
                before, records, after = zip(*(s[k] for s in steps)) if steps else ((), (), ())
                arrays += [pa.array(before, pa.bool_()), pa.array(records, pa.int64()), pa.array(after, pa.bool_())]
                names += [f"before_{state}", f"records_{state}", f"after_{state}"]
            yield pa.record_batch(arrays, names)

    schema = "file string, block long, n long, line string, fields array<string>, " + ", ".join(
        f"before_{s} boolean, records_{s} long, after_{s} boolean" for s in ("outside", "inside")
    )
    walked = lines.mapInArrow(run, schema)
    starts = splits.select("file", "block", F.col("inside").alias("_in"), F.col("in_file").alias("_in_file"), F.col("before").alias("_before"), "file_no", "lines")
    placed = join_lookup(walked, starts, ["file", "block"], "left")
    # Both scans must cut the files alike; a split that the first one did not see, or saw shorter, is an error.
    same = F.col("lines").isNotNull() & (F.col("n") < F.col("lines"))
    begins = F.when(same, F.col("_in")).otherwise(F.raise_error(F.lit("the files have changed while they were read")).cast("boolean"))
    placed = placed.withColumn("_in", begins)
    pick = lambda c: F.when(F.col("_in"), F.col(f"{c}_inside")).otherwise(F.col(f"{c}_outside"))
    known = placed.select(
        "block", "n", "line", "fields", pick("before").alias("before"), pick("after").alias("after"),
        (F.col("_in_file") + pick("records")).alias("place"), (F.col("_before") + pick("records") - (F.col("file_no") if header else 0)).alias("doc_id"),
    ).where(F.col("before") | ~F.col("line").isin("", "\r"))
    if header:
        known = known.where("place > 1")
    whole = known.where(~F.col("before") & ~F.col("after")).select("doc_id", "place", "fields")
    parts = known.where(F.col("before") | F.col("after")).groupBy("doc_id", "place")
    record = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "line"))), lambda x: x["line"]), "\n").alias("record"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parted = [dialect.fields(t.removesuffix("\r"), n) for t in batch["record"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["place"], pa.array(parted, pa.list_(pa.string()))], ["doc_id", "place", "fields"])

    found = whole.unionByName(record.mapInArrow(part, "doc_id long, place long, fields array<string>"))
    # A byte-order mark may stand before the first record of a file.
    first = F.when(F.col("place") == 1, F.regexp_replace(F.col("fields")[0], r"^\x{feff}", "")).otherwise(F.col("fields")[0])
    return found.select("doc_id", first.alias(columns[0]), *[F.col("fields")[k].alias(c) for k, c in enumerate(columns) if k])
