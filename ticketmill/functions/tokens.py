"""Token columns: whitespace tokens, exact word filters, in-row term counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = r"[\p{P}\p{S}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whitespace_tokens(text: Column, keep_punctuation: bool = True) -> Column:
    """Lower-case tokens between runs of whitespace; no empty tokens, on request none that is all punctuation."""
    pattern = r"\S+" if keep_punctuation else rf"(?<!\S){PUNCTUATION}*+\S+"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def exploded(df: DataFrame, keep: list[str], items: Column, value: str) -> DataFrame:
    """One row per element of ``items``: its position ``pos`` and the element as ``value``.

    The plain generators make the optimizer add a filter on the size of the array, which computes an expensive
    array once more, below any repartitioning. The outer ones do not; rows without elements are dropped after.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias("pos", value))
    return rows.where(F.col("pos").isNotNull())


def inlined(df: DataFrame, keep: list[str], structs: Column, key: str) -> DataFrame:
    """One row per struct, its fields as columns; ``key`` is a field that is never null. See :func:`exploded`."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(key).isNotNull())


def without_words(tokens: Column, words: Iterable[str]) -> Column:
    """Drop tokens that equal a listed word. The list becomes a hash set inside the expression."""
    listed = sorted(set(words))
    if not listed:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(listed))


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def token_counts(tokens: Column) -> Column:
    """``array<struct<word, n>>`` of one row's tokens.

    Sorts the array and measures the runs of equal words, so a row is counted without a shuffle and in
    n log n.
    """

    def runs(words: Column) -> Column:
        size = F.size(words)
        begins = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )
        return let(
            begins,
            lambda b: F.transform(
                b,
                lambda start, k: F.struct(
                    F.get(words, start).alias("word"),
                    (F.coalesce(F.get(b, k + 1), size) - start).cast("long").alias("n"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<word:string,n:bigint>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(empty)


def first_positions(tokens: Column) -> Column:
    """``array<struct<word, pos>>``: each distinct token with its first position in the row."""

    def runs(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda p, i: (i == 0) | (p["word"] != F.get(pairs, i - 1)["word"]),
        )

    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("word"), i.cast("long").alias("pos")))
    return let(F.sort_array(pairs), runs)
