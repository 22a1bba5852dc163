"""Dictionary segmentation of whole texts as column expressions: no shuffle, no Python per row.

Two modes share one alphabet (a third, ``likeliest``, is in :mod:`ticketmill.operators.spans`). A *run* is a maximal stretch of Latin letters and digits; every other letter
or digit can stand alone.

* ``longest``: non-overlapping tokens, the longest dictionary word first at each position.
* ``finest``: every dictionary word at every position, overlapping, plus the runs, plus the characters that
  no word covers; ordered by start, longest first.

Protected phrases cut the text first and stay whole; ambiguity rules replace a protected phrase by parts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill.functions.patterns import prefix_layers, word_pattern
from ticketmill.functions.tokens import let

RUN = r"[\p{IsLatin}\p{M}0-9]"
LETTER = r"[\p{L}\p{N}]"
VISIBLE = r"[^\s\p{Z}]"

MODES = ("finest", "longest", "likeliest")


def normalized(text: Column) -> Column:
    """Lower case, '' for null."""
    return F.lower(F.coalesce(text, F.lit("")))


def single_class(keep_punctuation: bool) -> str:
    return VISIBLE if keep_punctuation else LETTER


def longest_tokens(text: Column, words: Iterable[str], keep_punctuation: bool = False) -> Column:
    """Forward maximum matching in one regular expression."""
    pattern = f"{word_pattern(words)}|{RUN}+|{single_class(keep_punctuation)}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def in_run(char: str) -> bool:
    """Whether ``RUN`` matches the character."""
    latin = "LATIN" in unicodedata.name(char, "") or char in "\u00aa\u00ba"
    return char in "0123456789" or latin or unicodedata.category(char).startswith("M")


def alone_patterns(keep_punctuation: bool) -> tuple[str, str]:
    """A whole run from its start, and a character that is not part of a run."""
    return f"(?<!{RUN}){RUN}+", f"(?!{RUN}){single_class(keep_punctuation)}"


def at_each_position(text: Column, pattern: str) -> Column:
    """What ``pattern`` matches at each code point of ``text``, '' where it does not."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern}|)).{{1}}"), F.lit(1))


def finest_tokens(text: Column, words: Iterable[str], keep_punctuation: bool = False) -> Column:
    """All dictionary words, runs and uncovered characters.

    The words at a position form a chain of prefixes, so one pattern per prefix depth finds them all.
    """
    listed = sorted({w for w in words if w})
    layers = [word_pattern(layer) for layer in reversed(prefix_layers(listed))]
    run, single = alone_patterns(keep_punctuation)
    if all(in_run(c) for w in listed for c in w):
        return _finest_in_runs(text, layers, word_pattern(listed), run, single)
    return _finest_anywhere(text, layers, max(map(len, listed)), f"{run}|{single}")


def _finest_in_runs(text: Column, layers: list[str], word: str, run: str, single: str) -> Column:
    """For dictionaries of run characters only: no word reaches beyond its run or covers another character.

    One pass replaces each position where something starts by what starts there, longest first; lookaheads read
    the overlapping words. A run that is itself a word is left to the words. No token has a blank, so blanks part them.
    """
    groups = [f"(?!(?<!{RUN}){word}(?!{RUN})){run}", *layers, single]
    starts = f"{word}|{run[:-1]}|{single}"
    pattern = "(?s)" + "".join(f"(?=({g})?)" for g in groups) + f".(?:(?!{starts}).)*+"
    found = " ".join(f"${n}" for n in range(1, len(groups) + 1)) + " "
    listing = F.regexp_replace(text, F.lit(pattern), F.lit(found))
    return F.regexp_extract_all(listing, F.lit("[^ ]+"), F.lit(0))


def _finest_anywhere(text: Column, layers: list[str], longest: int, alone: str) -> Column:
    """For any dictionary: arrays aligned with the characters say what starts there and how far words reach."""
    names = [f"w{n}" for n in range(len(layers))]
    arrays = [at_each_position(text, p).alias(n) for n, p in zip(names, layers)]
    nothing = F.array().cast("array<string>")

    def reach(span: Column) -> Column:
        return F.greatest(F.lit(0), *[F.length(span[n]) for n in names])

    def reached(ends: Column) -> Column:
        """The furthest end of the words that start at a character or up to ``longest`` before it, in log steps."""

        def doubled(step: int) -> Callable[[Column], Column]:
            return lambda e: F.transform(e, lambda end, i: F.greatest(end, F.get(e, i - step)))

        step = 1
        while step < longest:
            ends = let(ends, doubled(step))
            step *= 2
        return ends

    def emitted(spans: Column, lengths: Column) -> Column:
        ends = reached(F.transform(lengths, lambda n, i: i + n))
        return let(ends, lambda e: listed_at(spans, lengths, e))

    def listed_at(spans: Column, lengths: Column, ends: Column) -> Column:
        def covered(i: Column) -> Column:
            return (i > 0) & (F.get(ends, i - 1) > i)

        def at(span: Column, i: Column) -> Column:
            own = span["alone"]
            is_run = own.rlike(f"^{RUN}")
            found = F.filter(F.array(*[span[n] for n in names]), lambda t: t != "")
            with_run = F.array_sort(
                F.array_distinct(F.array_append(found, own)), lambda a, b: F.length(b) - F.length(a)
            )
            return (
                F.when(F.get(lengths, i) > 0, F.when(is_run, with_run).otherwise(found))
                .when(own == "", nothing)
                .when(is_run | ~covered(i), F.array(own))
                .otherwise(nothing)
            )

        return F.flatten(F.transform(spans, at))

    return let(
        F.arrays_zip(*arrays, at_each_position(text, alone).alias("alone")),
        lambda spans: let(F.transform(spans, reach), lambda lengths: emitted(spans, lengths)),
    )


def around_protected(
    text: Column,
    phrases: Iterable[str],
    rules: Mapping[str, list[str]],
    inner: Callable[[Column], Column],
) -> Column:
    """Keep protected phrases whole, replace rule phrases by their parts, segment what lies between."""
    kept = sorted({*phrases, *rules} - {""})
    if not kept:
        return inner(text)
    whole = F.array
    if rules:
        table = F.create_map(
            *[
                c
                for k in sorted(rules)
                for c in (F.lit(k), F.array(*[F.lit(p) for p in rules[k]]).cast("array<string>"))
            ]
        )
        whole = lambda part: F.coalesce(F.element_at(table, part), F.array(part))
    return F.flatten(
        F.transform(pieces(text, kept), lambda part: F.when(part.isin(kept), whole(part)).otherwise(inner(part)))
    )


def pieces(text: Column, phrases: Iterable[str]) -> Column:
    """The text cut into phrases, longest first, and the stretches between them; nothing is lost."""
    phrase = word_pattern(phrases)
    return F.regexp_extract_all(text, F.lit(f"(?s){phrase}|(?:(?!{phrase}).)++"), F.lit(0))


def segment_tokens(
    text: Column,
    words: Iterable[str],
    mode: str = "finest",
    protected: Iterable[str] = (),
    rules: Mapping[str, list[str]] | None = None,
    keep_punctuation: bool = False,
) -> Column:
    """Token array of the lower-cased ``text``; null text gives no tokens. Words match without regard to case."""
    if mode not in MODES[:2]:
        raise ValueError(f"mode must be one of {MODES[:2]}")
    split = finest_tokens if mode == "finest" else longest_tokens
    listed = sorted({w.lower() for w in words})
    return around_protected(
        normalized(text),
        [p.lower() for p in protected],
        {k.lower(): parts for k, parts in (rules or {}).items()},
        lambda part: split(part, listed, keep_punctuation),
    )
