"""Class frequencies, class filter, deterministic splits, vocabulary and document indices, corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.tokens import first_positions, inlined, joined
from ticketmill.operators.numbering import first_seen_index, number_rows
from ticketmill.session import BROADCAST_ROWS, cut_lineage, exists, join_lookup, numbered_rows


def class_frequency(df: DataFrame, group: str, min_rows: int = 1) -> DataFrame:
    """Rows per class; ``min_rows=2`` leaves out classes seen once."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_rows) if min_rows > 1 else counts


def drop_singleton_classes(
    df: DataFrame, group: str, id_col: str | None = None, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Keep the rows whose class has at least two rows; rows without class go too.

    The class table is computed once from the class column. Small enough, it is broadcast and the wide rows stay
    where they are. Otherwise rows and classes are joined by class, and a hot class is split by adaptive execution: it
    meets one row. Ids play no part, so repeated and null ones change nothing.
    """
    known = df.where(F.col(group).isNotNull())
    kept = cut_lineage(known.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group))
    # An inner join on distinct keys; unlike a semi join, adaptive execution can split its left side.
    return join_lookup(known, kept, group, "inner", max_rows, split=True).select(*df.columns)


def dense_from(df: DataFrame, id_col: str) -> int | None:
    """The smallest id if all ids are different and follow each other without a gap, else None. Reads the ids only."""
    low, high, n, different = df.agg(F.min(id_col), F.max(id_col), F.count("*"), F.count_distinct(id_col)).first()
    dense = n and isinstance(low, int) and high - low + 1 == n == different
    return low if dense else None


def modulo_split(df: DataFrame, id_col: str, group: str, mod: int) -> DataFrame:
    """``id_col, group, row_num, part``: every ``mod``-th row of the *unfiltered* order goes to 'test'.

    Only the key columns are read.
    """
    return with_parts(df.select(id_col, group), id_col, group, mod)


def with_parts(df: DataFrame, id_col: str, group: str, mod: int) -> DataFrame:
    """Add ``row_num`` and ``part`` to the rows of classes with two rows or more, by the order of the ids; null ids come last, and
    rows of one id follow each other.

    Ids without gaps, as :func:`read_numbered_tickets` gives, say the number themselves: no row moves. Otherwise ids and row
    numbers of our own are numbered, and joined to the rows, broadcast when measured small.
    """
    low = dense_from(df, id_col)
    if low is None:
        rows = numbered_rows(df, "_row")
        order = [F.col(id_col).asc_nulls_last(), F.col("_row")]
        numbers = number_rows(rows.select(id_col, "_row"), order, "row_num").select("_row", "row_num")
        numbered = join_lookup(rows, numbers, "_row", "inner")
    else:
        numbered = df.withColumn("row_num", (F.col(id_col) - low + 1).cast("long"))
    part = F.when(F.col("row_num") % mod == 0, "test").otherwise("train")
    return drop_singleton_classes(numbered, group).withColumn("part", part).select(*df.columns, "row_num", "part")


def hash_bucket(key: Column, buckets: int) -> Column:
    """A bucket that depends on the key alone, not on partitioning."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def hash_split(df: DataFrame, key: str, train_share: float) -> DataFrame:
    """Add ``bucket`` (0..9) and ``part``; shares are multiples of a tenth."""
    tenths = round(train_share * 10)
    if not 0 < tenths < 10:
        raise ValueError("train_share must be between 0.1 and 0.9")
    bucketed = df.withColumn("bucket", hash_bucket(F.col(key), 10))
    return bucketed.withColumn("part", F.when(F.col("bucket") < tenths, "train").otherwise("test"))


def word_firsts(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``id, word, pos``: each word once a document, with its first position."""
    return inlined(df, [id_col], first_positions(tokens), "pos")


def vocab_index(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``word, idx``: 0-based by first occurrence in (document, token) order.

    Each document sends a word once, with its first position.
    """
    return first_seen_index(word_firsts(df, id_col, tokens), "word", id_col, "pos").select("word", "idx")


def grow_vocabulary(path: str, df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """The vocabulary stored at ``path`` with the words of ``df`` that it lacks: ``word, idx, batch``.

    Words keep their numbers for good. New ones are numbered after the last, by first occurrence in the batch; they are written
    as one more part, so that a batch costs what it holds and a comparison with the words so far. A batch without new words adds nothing,
    and one that is run again changes nothing. Batches in document order give the index of :func:`vocab_index`.
    """
    spark = df.sparkSession
    firsts = word_firsts(df, id_col, tokens)
    start = batch = 0
    if exists(spark, path):
        known = spark.read.schema(VOCABULARY).parquet(path)
        last = known.agg(F.max("idx"), F.max("batch")).first()
        start, batch = (last[0] or -1) + 1 if last[0] is not None else 0, (last[1] if last[1] is not None else -1) + 1
        first = firsts.groupBy("word").agg(F.min(F.struct(id_col, "pos")).alias("_first"))
        firsts = first.join(known.select("word"), "word", "left_anti").select("word", F.col("_first")[id_col].alias(id_col), F.col("_first")["pos"].alias("pos"))
    new = first_seen_index(firsts, "word", id_col, "pos", start=start).select("word", "idx")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # what a broken attempt left goes
    return spark.read.schema(VOCABULARY).parquet(path)


VOCABULARY = "word string, idx long, batch int"


def distinct_doc_index(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``doc_id, idx``: 0-based index of the distinct segmented texts, by first document.

    Texts are compared by SHA-256 digest so that the shuffle moves 32 bytes a document.
    """
    digests = df.select(F.col(id_col), F.unhex(F.sha2(joined(tokens), 256)).alias("digest"))
    return first_seen_index(digests, "digest", id_col).select(id_col, "idx")


def profile_items(df: DataFrame, group: str, text: str, tokens: Column) -> DataFrame:
    """``kind, value, chars``: every row's class, its text's digest and each of its distinct words once."""

    def item(kind: str, value: Column, chars: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), chars.cast("long").alias("chars"))

    own = F.array(
        item("class", F.col(group), F.coalesce(F.length(group), F.lit(0)) + F.coalesce(F.length(text), F.lit(0))),
        item("text", F.sha2(F.col("joined"), 256), F.length("joined")),
    )
    words = F.transform(F.array_distinct("tokens"), lambda w: item("word", w, F.length(w)))
    others = [c for c in df.columns if c not in (group, text, "tokens")]
    rows = df.select(*others, group, text, tokens.alias("tokens")).withColumn("joined", joined(F.col("tokens")))
    return inlined(rows, others, F.concat(own, words), "kind")


def corpus_profile(df: DataFrame, group: str, text: str, tokens: Column) -> DataFrame:
    """One row per ``kind`` (class, text, word): distinct values, values on several rows, rows, characters.

    Every row sends its class, its text digest and each distinct word once, so one scan and one shuffle give all
    counts. ``n_rows`` of a word counts the documents that hold it; ``n_chars`` of a class counts label and text.
    """
    items = profile_items(df.select(group, text, tokens.alias("tokens")), group, text, F.col("tokens"))
    per_value = items.groupBy("kind", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return per_value.groupBy("kind").agg(
        F.count("*").alias("n_distinct"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.sum("n").alias("n_rows"),
        F.sum("chars").alias("n_chars"),
    )


#: Registers of the distinct-count sketches, as a power of two: a standard error of 0.8 %.
SKETCH_BITS = 14


def profile_sketches(df: DataFrame, group: str, text: str, tokens: Column, part: Column) -> DataFrame:
    """``part, kind, n_rows, n_chars, distinct, lengths``: mergeable sketches by part of the corpus, a few KB each.

    ``distinct`` is a HyperLogLog sketch of the values, ``lengths`` a quantile sketch of their characters. Only sketches are shuffled, whatever
    the number of words. Parts that are added later are sketched alone.
    """
    items = profile_items(df.select(group, text, tokens.alias("tokens"), part.alias("part")), group, text, F.col("tokens"))
    return items.groupBy("part", "kind").agg(
        F.count("*").alias("n_rows"),
        F.sum("chars").alias("n_chars"),
        F.hll_sketch_agg(F.coalesce("value", F.lit("")), F.lit(SKETCH_BITS)).alias("distinct"),
        F.kll_sketch_agg_bigint("chars").alias("lengths"),
    )


def merged_profile(sketches: DataFrame) -> DataFrame:
    """One row per ``kind`` from the sketches of any parts: estimated distinct values, exact rows and characters, and the median and the ninth
    decile of the characters. The same as if all parts had been sketched at once, but for the sketches' errors."""
    return (
        sketches.groupBy("kind")
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_chars").alias("n_chars"),
            F.kll_merge_agg_bigint("lengths").alias("_lengths"),
        )
        .select(
            "kind", "n_distinct", "n_rows", "n_chars",
            F.kll_sketch_get_quantile_bigint("_lengths", F.lit(0.5)).alias("median_chars"),
            F.kll_sketch_get_quantile_bigint("_lengths", F.lit(0.9)).alias("p90_chars"),
        )
    )
