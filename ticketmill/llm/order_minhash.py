"""Near duplicates by order MinHash: sketches that keep the text order of several minimum word shingles.

A shingle (k-mer of five words) is labelled with its occurrence in the text, so that repeats count. For each of a number of
hash functions, the two labelled shingles of smallest hash are taken in the order in which they stand in the text; texts
that agree there are candidates. A candidate pair is verified by banded alignment of the words: edit similarity
is one less the edit distance over the length of the longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.fingerprints import CACHE_BYTES
from ticketmill.llm.grouping import Bound, bucket_keys, classes
from ticketmill.llm.rows import fresh, join_by_row, map_arrow, prepare_session, slabs, store, text_bytes, text_hash
from ticketmill.llm.shingles import mix, random_words, shingle_hashes, word_hashes
from ticketmill.session import join_lookup, scratch

#: Hash functions; a pair whose shingles' similarity is j agrees in about j * j of them. Words changed at random that leave an edit
#: similarity s leave j = s^5 / (2 - s^5): one agreement or more has the chance 0.94 at s = 0.80, 0.99 at 0.82, 0.999 at 0.85.
SKETCHES = 72
SIMILARITY = 0.8
#: Band of the first alignment, in words to either side of the diagonal; it doubles until the distance fits.
BAND = 8

_A = (random_words(31, SKETCHES) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_B = (random_words(32, SKETCHES) >> np.uint64(31)).astype(np.uint32)


def label_occurrences(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many times it stood in the text before)."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    own = mix(shingles + text * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    first = np.append(True, own[order][1:] != own[order][:-1])
    index = np.arange(len(order))
    times = np.empty(len(order), np.uint64)
    times[order] = index - np.maximum.accumulate(np.where(first, index, 0))
    return mix(shingles ^ (times * np.uint64(0xD6E8FEB86659FD93)))


def sketches(labels: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SKETCHES values per text; a text without shingles has zeros."""
    out = np.zeros((len(offsets) - 1, SKETCHES), np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    begins, several = offsets[:-1][full], np.diff(offsets)[full] > 1
    x, place, low_half = (labels >> np.uint64(32)).astype(np.uint32), np.arange(len(labels), dtype=np.uint64), np.uint64(0xFFFFFFFF)
    for k in range(SKETCHES):
        key = (x * _A[k] + _B[k]).astype(np.uint64) << np.uint64(32) | place
        one = (np.minimum.reduceat(key, begins) & low_half).astype(np.int64)
        key[one] = np.iinfo(np.uint64).max
        two = np.where(several, (np.minimum.reduceat(key, begins) & low_half).astype(np.int64), one)
        former, latter = labels[np.minimum(one, two)], labels[np.maximum(one, two)]
        out[full, k] = mix(former * np.uint64(0x9E3779B97F4A7C15) + latter + np.uint64(k)).view(np.int64)
    return out


def banded_distance(a: list[int], b: list[int], band: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``band``, else None.

    Bit-parallel columns of the alignment, of which only the ``2 * band + 1`` rows around the diagonal are kept.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    width = 2 * band + 1
    full, top, middle = (1 << width) - 1, 1 << (width - 1), 1 << band
    # Bit p of a column j stands for row j - band + p. Rows up to 0 lie before the text and cost their distance to row 0.
    up = full & ~((1 << (band + 1)) - 1)
    down = (1 << (band + 1)) - 1
    at: dict[int, tuple[int, int]] = {}  # word -> rows of the window that hold it, and the column they are aligned to
    for row in range(1, min(band, n) + 1):
        bits, column = at.get(a[row - 1], (0, 0))
        at[a[row - 1]] = (bits | 1 << (row + band), column)
    score = 0
    for j in range(1, m + 1):
        if (row := j + band) <= n:
            bits, column = at.get(a[row - 1], (0, j))
            at[a[row - 1]] = (bits >> (j - column) | top, j)
        bits, column = at.get(b[j - 1], (0, j))
        equal = (bits >> (j - column)) & full
        up, down = up >> 1 | top, down >> 1
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right = down | (full & ~(diagonal | up))
        left = diagonal & up
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up = left | (full & ~(diagonal | right))
        down = diagonal & right
        score += not diagonal & middle
    # From row m to row n of the last column.
    for row in range(min(n, m) + 1, max(n, m) + 1):
        p = 1 << (row - m + band)
        step = bool(up & p) - bool(down & p)
        score += step if n > m else -step
    return score if score <= band else None


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - distance / longer length if that is at least ``least``, else 0. Two empty sequences are equal."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    allowed = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > allowed:
        return 0.0
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[:short] != b[:short])
    start = int(differs[0]) if len(differs) else short
    a, b = a[start:], b[start:]
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    end = int(differs[0]) if len(differs) else short
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / longer
    # Words that the other text lacks bound the distance from below.
    values, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(codes[: len(a)], minlength=len(values)), np.bincount(codes[len(a) :], minlength=len(values))).sum()
    least_distance = max(len(a), len(b)) - int(common)
    if least_distance > allowed:
        return 0.0
    first, second, band = codes[: len(a)].tolist(), codes[len(a) :].tolist(), max(BAND, least_distance)
    while True:
        distance = banded_distance(first, second, min(band, allowed))
        if distance is not None:
            return 1 - distance / longer
        if band >= allowed:
            return 0.0
        band *= 2


def _read_texts(documents: DataFrame) -> DataFrame:
    """A row per document row: rid, doc_id, th, digest of the words, the words' hashes, the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            words, sketch, digests = [], [], []
            for i, j in slabs(np.diff(offsets), CACHE_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                block = data[offsets[i] : offsets[j]]
                hashes, by_text = word_hashes(block, own)
                shingles, by_shingle = shingle_hashes(hashes, by_text)
                sketch.append(sketches(label_occurrences(shingles, by_shingle), by_shingle))
                short = (hashes >> np.uint64(32)).astype("<u4")
                for k in range(j - i):
                    a, b = by_text[k], by_text[k + 1]
                    # Texts without words are equal if their bytes are.
                    digests.append(hashlib.blake2b((b"w" + hashes[a:b].tobytes()) if b > a else block[own[k] : own[k + 1]].tobytes(), digest_size=16).digest())
                    words.append(short[a:b].tobytes())
            table = np.concatenate(sketch)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, SKETCHES, dtype=np.int32)), pa.array(table.ravel()))
            yield pa.record_batch(
                [np.arange(rid, rid + len(words)), batch["doc_id"], batch["th"], pa.array(digests, pa.binary()), pa.array(words, pa.binary()), lists],
                ["rid", "doc_id", "th", "digest", "words", "sketch"],
            )
            rid += len(words)

    schema = "rid long, doc_id long, th long, digest binary, words binary, sketch array<long>"
    return map_arrow(documents.select("doc_id", text_hash(), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def _bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    places = hashes & np.uint64(width - 1)
    out = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(out, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    return out


def _pair_width(n_words: int) -> int:
    return 1 << min(max((n_words * 4 - 1).bit_length(), 6), 17)


def pair_bits(words: np.ndarray) -> np.ndarray:
    """A bitmap of a text's pairs of neighbouring words, of four to eight bits a word, and of 16 KB at most."""
    pairs = mix((words[:-1].astype(np.uint64) << np.uint64(32) | words[1:].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return _bitmap(pairs, _pair_width(len(words)))


def word_bits(words: np.ndarray) -> np.ndarray:
    """A bitmap of a text's words, each with how many times it stood there before, twice as wide as that of the pairs."""
    return _bitmap(label_occurrences(words.astype(np.uint64), np.array([0, len(words)])), 2 * _pair_width(len(words)))


def distance_bound(similarity: float) -> Bound:
    """An edit changes two pairs of neighbours at most, and one word: of texts at a distance d either lacks at most 2 d of the other's pairs, and
    d of its words. Where words were changed at random places, the words part texts just below the threshold that the pairs do not."""
    allowed = lambda longer: ((1 - similarity) * longer + 1e-9).astype(np.int64)
    words = Bound(lambda body: word_bits(np.frombuffer(body, "<u4")), allowed)
    return Bound(lambda body: pair_bits(np.frombuffer(body, "<u4")), lambda longer: 2 * allowed(longer), similarity, words)


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document row: doc_id, th, class_id (smallest doc_id of its class), class_size and stays (one row of each class).

    Texts with the same words are copies; links between different texts are verified, and classes are their connected
    components. A null text counts as empty; texts without words are alike only if equal. Among repeated rows one stays. Null ids
    sort last, and the class of such rows alone is null. An empty table gives an empty result. Words are compared by 32 bits of their
    hashes: two different words are equal once in four billion.
    """
    spark = documents.sparkSession
    prepare_session(spark)
    with scratch(spark):
        read = store(_read_texts(documents), "sketches")
        copies = read.groupBy("digest").agg(F.min("rid").alias("node"))
        rows = store(read.select("rid", "doc_id", "th", "digest").join(copies, "digest").drop("digest"), "nodes")
        with_words = read.filter("length(words) > 0").select("rid", "sketch").join(rows.filter("rid = node").select("rid"), "rid")
        nodes = with_words.select(F.col("rid").alias("node"), bucket_keys("sketch", SKETCHES).alias("keys"))

        def texts_of(wanted: DataFrame) -> DataFrame:
            words = read.select(F.col("rid").alias("node"), F.expr("length(words) div 4").alias("size"), F.col("words").alias("body"))
            return join_lookup(words, wanted, "node", "inner")

        def alike(x: bytes, y: bytes) -> bool:
            return edit_similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) >= similarity

        return store(classes(rows, nodes, texts_of, alike, distance_bound(similarity)), "near", outer=True)


def drop_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its columns."""
    found = near_duplicates(documents, similarity)
    times = fresh(documents, "times")
    kept = found.groupBy("doc_id", "th").agg(F.max("stays").alias("stays"), F.count("*").alias(times)).filter("stays").drop("stays")
    joined = join_by_row(documents, kept, "inner")
    # Rows equal in id and text, and so in all that the operator looks at: one of them.
    several = joined.filter(F.col(times) > 1).dropDuplicates(["doc_id", "text"])
    return joined.filter(F.col(times) == 1).unionByName(several).select(*documents.columns)
