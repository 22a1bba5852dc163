"""What segmentation knows: dictionary, protected phrases, ambiguity rules, stop words, parts of speech to drop."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.operators.segment import listed_words, stop_natures

# Parts of speech that preparation drops: punctuation and personal names.
DROPPED_NATURES = ("w", "nr")


@dataclass(frozen=True)
class Lexicon:
    """``words`` may be a table with a ``nature``; words of ``dropped`` natures are segmented and then left out."""

    words: DataFrame | Iterable[str] = ()
    stop: DataFrame | Iterable[str] = ()
    protected: DataFrame | tuple[str, ...] = ()
    rules: DataFrame | Mapping[str, list[str]] = field(default_factory=dict)
    dropped: tuple[str, ...] = DROPPED_NATURES

    def left_out(self) -> DataFrame | list[str]:
        """Stop words, and the (lower-cased, as tokens are) words of dropped natures."""
        if not isinstance(self.words, DataFrame) or "nature" not in self.words.columns:
            return self.stop
        named = stop_natures(self.words, self.dropped).select(F.lower("word").alias("word")).distinct()
        if isinstance(self.stop, DataFrame):
            return self.stop.select("word").unionByName(named).distinct()
        few = listed_words(named)
        if few is not None:
            return sorted({*self.stop, *few})
        stop = named.sparkSession.createDataFrame([(w,) for w in self.stop], "word string")
        return stop.unionByName(named).distinct()


def make_lexicon(
    words: DataFrame | Iterable[str] = (),
    stop: DataFrame | Iterable[str] = (),
    protected: DataFrame | Iterable[str] = (),
    rules: DataFrame | None = None,
    dropped: tuple[str, ...] = DROPPED_NATURES,
) -> Lexicon:
    """Leave what is given as a table a table: dictionary, stop words, phrases (word) and rules (phrase, parts of word and nature).

    A rule's parts of dropped natures are left out of what the rule gives.
    """
    phrases = protected.select("word").distinct() if isinstance(protected, DataFrame) else tuple(sorted(set(protected)))
    parts: DataFrame | dict = {}
    if rules is not None:
        kept = F.filter("parts", lambda p: p["nature"].isNull() | ~p["nature"].isin(list(dropped)))
        parts = rules.select("phrase", F.transform(kept, lambda p: p["word"]).alias("parts"))
    return Lexicon(words, stop, phrases, parts, dropped)
