"""Corpus profile job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.config import PrepConfig
from ticketmill.operators.corpus import (
    class_frequency,
    corpus_profile,
    distinct_doc_index,
    merged_profile,
    profile_sketches,
    vocab_index,
)
from ticketmill.operators.segment import segment
from ticketmill.plans.lexicon import Lexicon
from ticketmill.session import stored


def profile(df: DataFrame, lexicon: Lexicon, config: PrepConfig = PrepConfig(), approximate: bool = False, part: str | None = None) -> dict[str, DataFrame]:
    """Counts, repeated classes, vocabulary and distinct-text index of a corpus, segmented once.

    ``approximate`` gives instead the estimated counts and the sketches they come from, by the column ``part`` if one is named: keep them,
    and merge those of further parts with :func:`merged_profile`.
    """
    tokens = segment(
        df, config.text_col, "tokens", lexicon.words, config.mode, lexicon.protected, lexicon.rules,
        config.keep_punctuation,
    )
    if approximate:
        by = F.lit(0) if part is None else F.col(part)
        sketches = stored(profile_sketches(tokens, config.group_col, config.text_col, F.col("tokens"), by), "sketches")
        return {"counts": merged_profile(sketches), "sketches": sketches}
    table = stored(tokens.select(config.id_col, config.group_col, config.text_col, "tokens"), "segmented")
    words = F.col("tokens")
    return {
        "counts": corpus_profile(table, config.group_col, config.text_col, words),
        "classes": class_frequency(table, config.group_col, min_rows=2),
        "vocabulary": vocab_index(table, config.id_col, words),
        "documents": distinct_doc_index(table, config.id_col, words),
    }
