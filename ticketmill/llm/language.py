"""Language identification by words first, then by ever shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unknown word scores the mean of its known
n-grams of the longest order that has any, from :data:`MAX_ORDER` down to single letters. A text's score for a
language is the sum over its words; the softmax of the sums is the confidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import Shared, extended, map_batches, prepare_session, store

#: Documents per language that the model is fitted on, about: a hash of doc_id picks them.
SAMPLE_PER_LANGUAGE = 4000
#: A word is in the model if it makes up at least this share of the sample's words: at most 1 / share words are kept.
WORD_SHARE = 1 / 400_000
#: The same for the n-grams of each order.
GRAM_SHARE = 1 / 100_000
MAX_ORDER = 5
#: Unknown words that a worker remembers before it starts afresh.
MEMO_WORDS = 100_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none for null."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(c.isalpha() for c in w) for w in words)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a blank on either side; single characters without the blanks."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """``tables[0]`` maps words to rows of ``scores``, ``tables[n]`` the n-grams of order n; a row has a language each."""

    languages: list[str]
    tables: list[dict[str, int]]
    scores: np.ndarray


def fit(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows (doc_id, text, lang); rows without language, text or words teach nothing.

    The sample and the shares bound the model; beyond the count of rows by language, only the sample is read.
    """
    spark = labelled.sparkSession
    prepare_session(spark)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.filter(place < share).select("lang", "text")

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        return pa.record_batch([[k[0] for k in counts], [k[1] for k in counts], pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])

    def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "gram", "n"))):
            for order in range(1, MAX_ORDER + 1):
                for gram in grams(word, order):
                    counts[lang, order, gram] += n
        keys = list(counts)
        orders = pa.array([k[1] for k in keys], pa.int32())
        return pa.record_batch([[k[0] for k in keys], orders, [k[2] for k in keys], pa.array(counts.values(), pa.int64())], ["lang", "ord", "gram", "n"])

    words = store(map_batches(sample, count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    shorter = map_batches(words, count_grams, "lang string, ord int, gram string, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    counted = store(words.select("lang", F.lit(0).alias("ord"), "gram", "n").unionByName(shorter), "grams")

    totals = {(r["ord"], r.lang): r.n for r in counted.groupBy("ord", "lang").agg(F.sum("n").alias("n")).collect()}
    by_order = Counter()
    for (order, _), n in totals.items():
        by_order[order] += n
    least = F.lit(0.0)
    for order, n in by_order.items():
        least = F.when(F.col("ord") == order, F.lit(n * (GRAM_SHARE if order else WORD_SHARE))).otherwise(least)
    frequent = counted.groupBy("ord", "gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    # At most 1 / share rows an order, by the shares' definition.
    rows = frequent.filter(F.col("all") >= least).select("ord", "gram", "by").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["ord"], r["gram"]))

    languages = sorted(lang for order, lang in totals if order == 0)
    scores = np.zeros((len(rows), len(languages)))
    tables: list[dict[str, int]] = [{} for _ in range(MAX_ORDER + 1)]
    for i, row in enumerate(rows):
        seen = {x["lang"]: x["n"] for x in row["by"]}
        tables[row["ord"]][row["gram"]] = i
        # Unseen in a language counts as a tenth of a single occurrence.
        scores[i] = [math.log(seen.get(lang, 0.1) / totals[row["ord"], lang]) for lang in languages]
    return Model(languages, tables, scores)


class Scorer(dict):
    """Rows of scores by word: the model's own, and those of unknown words as they are met, up to a bound."""

    def __init__(self, model: Model):
        super().__init__(model.tables[0])
        self.model, self.used = model, len(model.scores)
        self.rows = np.vstack([model.scores, np.zeros((MEMO_WORDS, len(model.languages)))])

    def __missing__(self, word: str) -> int:
        row = 0.0
        for n in range(MAX_ORDER, 0, -1):
            known = [i for g in grams(word, n) if (i := self.model.tables[n].get(g)) is not None]
            if known:
                row = self.model.scores[known].mean(axis=0)
                break
        self.rows[self.used] = row
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def sums(self, words: list[str]) -> np.ndarray:
        """The sum of the rows of all words; long texts go in blocks, so that the memory of unknown words holds."""
        total = np.zeros(len(self.model.languages))
        for i in range(0, len(words), MEMO_WORDS // 4):
            if self.used + MEMO_WORDS // 4 >= len(self.rows):
                self.clear()
                self.update(self.model.tables[0])
                self.used = len(self.model.scores)
            total += self.rows[list(map(self.__getitem__, words[i : i + MEMO_WORDS // 4]))].sum(axis=0)
        return total


def predict_text(scorer: Scorer, text: str | None) -> tuple[str, float]:
    """The best language and its confidence; ``und`` and 0 without a letter or without any learned language."""
    words = words_of(text)
    if not words or not scorer.model.languages or not has_letter(words):
        return UNDETERMINED, 0.0
    sums = scorer.sums(words)
    best = int(sums.argmax())
    return scorer.model.languages[best], float(1.0 / np.exp(sums - sums[best]).sum())


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, from its text alone.

    Ties go to the language that sorts first; repeated texts get the same answer. A null text, an empty one and one
    without letters are ``und`` with score 0. Columns of these two names are replaced; all others pass through.
    """
    prepare_session(documents.sparkSession)
    shared = Shared(documents.sparkSession, model, Scorer)
    documents = documents.drop("lang_pred", "score")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = shared.get()
        found = [predict_text(scorer, text) for text in batch["text"].to_pylist()]
        for i, name in enumerate(("lang_pred", "score")):
            batch = batch.append_column(name, pa.array([f[i] for f in found], pa.string() if i == 0 else pa.float64()))
        return batch

    return map_batches(documents, run, extended(documents, "lang_pred string, score double"), shared)


def least_score(n_languages: int) -> float:
    """The confidence below which no language stands out: a fifth above that of a guess among all of them. One language always does."""
    return 1.2 / n_languages if n_languages > 1 else 0.0


def is_rejected(lang_pred: Column, score: Column, least: float) -> Column:
    """No language, or none that stands out: a single unknown word may still have one."""
    return (lang_pred == UNDETERMINED) | (score < least)
