"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item (an item of fewer words is one window). Contained windows
need all their words, so the necessary prefix of a window, its words ordered by rarity in the documents, is one
word: the rarest. Documents are joined on that word only; its offset in the window and the lengths bound the place,
and the words there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import join_by_row, prepare_session, store, text_hash
from ticketmill.session import join_lookup

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE = 13


def words(text: str = "text") -> Column:
    """Words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters; none for null.

    What parts the words is replaced and split at; extracting the words one by one takes several times as long.
    """
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(F.regexp_replace(lowered, NO_WORD, " "), " "), "")


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item_id, window): every run of ``size`` words, or all words of a shorter item."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        benchmark.select("item_id", words().alias("w"))
        .filter(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
        .distinct()
    )


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, items (sorted strings of the item ids), where
    ``n_hit`` counts the words inside any occurrence of a window.

    Null or empty texts have no words and no hits; repeated rows get the same result each; items without words
    match nothing; an empty benchmark hits nothing; a null item_id counts as hit words but names no item.
    """
    spark = documents.sparkSession
    prepare_session(spark)
    windows = store(item_windows(benchmark, size), "windows")
    listed = windows.select(F.explode("window").alias("w")).distinct()

    # Rarity over all documents, of the words that the benchmark has. A document sends a word once.
    seen = documents.select(F.explode(F.array_distinct(words())).alias("w"))
    rarity = store(join_lookup(seen, listed, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df")), "rarity")

    # The prefix of each window: its rarest word, with the offset of that word's first place in the window. A window
    # with a word that no document has cannot occur and goes.
    ranked = (
        windows.select("window")
        .distinct()
        .select("window", F.posexplode("window").alias("offset", "w"))
        .join(rarity, "w", "left")
        .groupBy("window")
        .agg(F.min(F.struct("df", "w", "offset")).alias("rarest"), F.count(F.when(F.col("df").isNull(), 1)).alias("missing"))
        .filter("missing = 0")
        .select("window", F.col("rarest.w").alias("w"), F.col("rarest.offset").alias("offset"))
    )
    prefixes = store(ranked, "prefixes")

    # Candidate places: every occurrence of a prefix word, where the window fits on its left. No text is carried.
    placed = documents.select("doc_id", text_hash(), F.posexplode(words()).alias("pos", "w")).withColumnRenamed("pos", "at")
    candidates = (
        join_lookup(placed, prefixes, "w", "inner")
        .filter(F.col("at") >= F.col("offset"))
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct((F.col("at") - F.col("offset")).alias("start"), F.col("window"))).alias("places"))
    )

    # Every document meets its places once; its words are split once and compared exactly.
    keyed = documents.select("doc_id", text_hash(), F.col("text"))
    joined = keyed.join(candidates.withColumnsRenamed({"doc_id": "c_id", "th": "c_th"}), keyed["doc_id"].eqNullSafe(F.col("c_id")) & (keyed["th"] == F.col("c_th")), "left")
    found = F.transform(
        F.array(words()),
        lambda ws: F.struct(
            F.size(ws).alias("n_words"),
            F.filter(F.coalesce("places", F.array()), lambda p: F.slice(ws, p["start"] + 1, F.size(p["window"])) == p["window"]).alias("hits"),
        ),
    )[0]
    checked = joined.select("doc_id", "th", found.alias("f")).select("doc_id", "th", "f.n_words", "f.hits")
    hits = store(
        checked.select("doc_id", "th", "n_words", _covered("hits").alias("n_hit"), F.array_distinct(F.col("hits.window")).alias("hit_windows")), "hits"
    )
    named = (
        join_lookup(hits.select("doc_id", "th", F.explode("hit_windows").alias("window")).distinct(), windows, "window", "inner")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .withColumnsRenamed({"doc_id": "i_id", "th": "i_th"})
    )
    return hits.join(named, hits["doc_id"].eqNullSafe(F.col("i_id")) & (hits["th"] == F.col("i_th")), "left").select(
        "doc_id", "th", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _covered(hits: str) -> Column:
    """Words in the union of the hits' places: one pass over them by start."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.size(h["window"])).alias("end"))))

    def add(done: Column, span: Column) -> Column:
        end = F.greatest(done["end"], span["end"])
        return F.struct(end.alias("end"), (done["n"] + end - F.least(F.greatest(done["end"], span["start"]), end)).cast("long").alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), add, lambda done: done["n"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one hit word, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = find_contamination(documents, benchmark, size)
    bad = found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "th").distinct()
    return join_by_row(documents, bad, "left_anti")
