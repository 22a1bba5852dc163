"""Segmentation and stop-word removal of a table, choosing the plan by dictionary size."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.functions.patterns import forks
from ticketmill.functions.segmentation import MODES, in_run, segment_tokens
from ticketmill.functions.tokens import without_words
from ticketmill.operators.spans import HELD_ROWS, learn_scores, segment_by_join
from ticketmill.session import by_key, cut_lineage, join_lookup, numbered_rows

# Words held inside one expression; longer lists are joined. The driver sees at most this many plus one.
IN_ROW_WORDS = 50_000
# The same for all matches of words that do not consist of run characters only: each place of a text is tried against every layer of the list.
IN_ROW_ANYWHERE = 100
# Protected phrases and rules held inside one expression.
IN_ROW_PHRASES = 1_000
# Groups that a pattern may nest: the pattern's compiler and matcher go down by one call a group.
IN_ROW_FORKS = 100


def listed_words(words: DataFrame | Iterable[str], limit: int = IN_ROW_WORDS) -> list[str] | None:
    """The distinct words when there are at most ``limit`` of them, else None."""
    if not isinstance(words, DataFrame):
        return sorted(set(words))
    rows = words.select("word").where(F.length("word") > 0).distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= limit else None


def phrase_table(spark: SparkSession, protected: DataFrame | Iterable[str], rules: DataFrame | Mapping[str, list[str]] | None) -> DataFrame | None:
    """``word, parts`` of protected phrases (parts of null) and rules; a phrase that is both is a rule. None if there are none."""
    schema = "word string, parts array<string>"
    if not isinstance(protected, DataFrame):
        protected = spark.createDataFrame([(p,) for p in protected], "word string") if (protected := list(protected)) else None
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(k, list(v)) for k, v in rules.items()], schema) if rules else None
    else:
        rules = rules.select(F.col("phrase").alias("word"), "parts")
    if protected is None:
        return rules
    whole = protected.select("word", F.lit(None).cast("array<string>").alias("parts"))
    return whole if rules is None else whole.unionByName(rules)


def few_phrases(phrases: DataFrame | None, limit: int) -> tuple[list[str], dict[str, list[str]]] | None:
    """The phrases that stay whole and those with parts, if there are at most ``limit``."""
    if phrases is None:
        return [], {}
    rows = phrases.where(F.length("word") > 0).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return [r["word"] for r in rows if r["parts"] is None], {r["word"]: r["parts"] for r in rows if r["parts"] is not None}


def segment(
    df: DataFrame,
    text_col: str,
    out_col: str,
    words: DataFrame | Iterable[str],
    mode: str = "finest",
    protected: DataFrame | Iterable[str] = (),
    rules: DataFrame | Mapping[str, list[str]] | None = None,
    keep_punctuation: bool = False,
    limit: int = IN_ROW_WORDS,
    held_rows: int = HELD_ROWS,
    phrase_limit: int = IN_ROW_PHRASES,
) -> DataFrame:
    """Add the token array ``out_col``, the same on each of three plans, for rows with any ids.

    Small dictionaries run as one expression, those measured within ``held_rows`` are held by the workers, and larger
    ones are joined with the stretches of text that probably are words. A small list whose words are prefixes of each other
    many times over takes the second plan, as does one of more than ``IN_ROW_ANYWHERE`` words for all matches, if not all are of run characters. Phrase lists go the same ways. ``protected`` is a list or a table (word), ``rules`` a
    mapping or a table (phrase, parts). The mode ``likeliest`` learns how frequent words are from the texts first, and has
    no one-expression plan.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = df.sparkSession
    given = isinstance(protected, DataFrame) or isinstance(rules, DataFrame)
    table = phrase_table(spark, protected, rules) if given else None
    few = few_phrases(table, phrase_limit) if given else (list(protected), dict(rules or {}))
    if few is not None and len(few[0]) + len(few[1]) > phrase_limit:
        few = None
    listed = listed_words(words, limit)
    slow = mode == "finest" and listed is not None and len(listed) > IN_ROW_ANYWHERE and not all(in_run(c) for w in listed for c in w.lower())
    if few is not None and listed is not None and mode != "likeliest" and not slow and forks(w.lower() for w in listed) <= IN_ROW_FORKS:
        return df.withColumn(out_col, segment_tokens(F.col(text_col), listed, mode, *few, keep_punctuation))
    if not isinstance(words, DataFrame):
        words = spark.createDataFrame([(w,) for w in listed or words], "word string")
    if table is None and (protected or rules):
        table = phrase_table(spark, protected, rules)
    unknown = 0
    if mode == "likeliest":
        words, unknown = learn_scores(df, text_col, words, held_rows)
    return segment_by_join(df, text_col, out_col, words, mode, table, keep_punctuation, held_rows, unknown)


def remove_words(
    df: DataFrame,
    tokens_col: str,
    stop: DataFrame | Iterable[str],
    limit: int = IN_ROW_WORDS,
) -> DataFrame:
    """Drop listed tokens (exact, case-sensitive), keeping order and repeats; null tokens go, a null array stays null.

    Lists beyond ``limit`` are joined with the tokens. The rows are partitioned by a number of their own first, so a
    broadcast list needs no shuffle of single tokens, and rows of one id stay apart.
    """
    listed = listed_words(stop, limit)
    if listed is not None:
        return df.withColumn(tokens_col, without_words(F.col(tokens_col), listed))
    if not isinstance(stop, DataFrame):
        stop = df.sparkSession.createDataFrame([(w,) for w in stop], "word string")
    # The other columns travel with the first token of a row, so that nothing has to be joined back.
    others = [c for c in df.columns if c != tokens_col]
    rest = F.struct(*[F.col(c) for c in others], F.col(tokens_col).isNull().alias("_none"))
    rows = by_key(numbered_rows(df, "_row"), "_row").select("_row", rest.alias("_rest"), F.posexplode_outer(tokens_col).alias("_pos", "word"))
    single = rows.withColumn("_rest", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_rest")))
    listed_stop = cut_lineage(stop.select("word").where(F.col("word").isNotNull()).distinct()).withColumn("_stop", F.lit(True))
    kept = F.when(F.col("_stop").isNull() & F.col("word").isNotNull(), F.struct("_pos", "word"))
    put_together = (
        join_lookup(single, listed_stop, "word", "left", split=True)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(kept))["word"].alias("_kept"), F.first("_rest", ignorenulls=True).alias("_rest"))
    )
    tokens = F.when(~F.col("_rest")["_none"], F.col("_kept")).alias(tokens_col)
    return put_together.select(*[F.col("_rest")[c].alias(c) for c in others], tokens).select(*df.columns)


def stop_natures(dictionary: DataFrame, natures: Iterable[str] = ("w", "nr")) -> DataFrame:
    """Dictionary words whose part of speech is to be dropped."""
    return dictionary.where(F.col("nature").isin(list(natures))).select("word").distinct()
