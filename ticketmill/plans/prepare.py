"""Corpus preparation: segment, drop stop words, drop singleton classes, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.config import PrepConfig
from ticketmill.functions.tokens import joined
from ticketmill.operators.corpus import with_parts
from ticketmill.operators.segment import remove_words, segment
from ticketmill.plans.lexicon import Lexicon
from ticketmill.session import stored


def prepare_text(
    df: DataFrame, lexicon: Lexicon, config: PrepConfig = PrepConfig(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id, group, text, orgtext`` (``group`` if present), with ``text`` the kept tokens joined by spaces.

    ``keep`` names further columns to carry along.
    """
    tokens = segment(
        df,
        config.text_col,
        "tokens",
        lexicon.words,
        config.mode,
        lexicon.protected,
        lexicon.rules,
        config.keep_punctuation,
    )
    kept = remove_words(tokens, "tokens", lexicon.left_out())
    group = [F.col(config.group_col).alias("group")] if config.group_col in df.columns else []
    text = joined(F.col("tokens")).alias("text")
    return kept.select(config.id_col, *group, text, F.col(config.text_col).alias("orgtext"), *keep)


def usable(df: DataFrame, config: PrepConfig) -> DataFrame:
    """Rows with class and text."""
    return df.where(F.col(config.group_col).isNotNull() & F.col(config.text_col).isNotNull())


def dropped_rows(df: DataFrame, config: PrepConfig) -> DataFrame:
    """How many rows :func:`prepare` cannot use, by reason."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(config.group_col).isNull()).alias("n_without_group"),
        F.count_if(F.col(config.text_col).isNull()).alias("n_without_text"),
    )


def prepared_split(df: DataFrame, lexicon: Lexicon, config: PrepConfig) -> DataFrame:
    """``id, group, text, orgtext, part``. Rows are numbered before singleton classes go; dropped rows use up numbers.

    Numbers come with the ids and the class table is broadcast, so texts stay where they are read.
    """
    parts = with_parts(df, config.id_col, config.group_col, config.mod)
    return prepare_text(usable(parts, config), lexicon, config, keep=("part",))


def prepare(df: DataFrame, lexicon: Lexicon, config: PrepConfig) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: the split rows, segmented once and stored; inside :func:`session.scratch` the copy goes at the end."""
    table = stored(prepared_split(df, lexicon, config), "prepared", "part")
    return table.where("part = 'train'").drop("part"), table.where("part = 'test'").drop("part")
