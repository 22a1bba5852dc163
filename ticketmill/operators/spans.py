"""Segmentation with dictionaries and phrase lists too large for one pattern: held by the workers as tries, or joined with the texts.

Same results as :mod:`ticketmill.functions.segmentation`, for words and for phrases alike. A list that was measured and found small
enough goes to every worker as a trie; nothing is shuffled. Beyond that, a Bloom filter of the list, built by partial aggregation, goes
to the workers instead. Texts are dealt into blocks of about a million characters: only the different stretches of a block that are
probably in the list leave the workers, to be joined with it. What is in the list comes back to its block, whose texts each move once and are
segmented with a trie of the block's own words. Ids play no part, repeated and null ones included.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ticketmill.functions.segmentation import RUN, normalized, single_class
from ticketmill.functions.tries import GAP, Bloom, Stretches, Trie, code_points, leftmost_longest, lined_up, probable, word_hashes
from ticketmill.session import by_key, cut_lineage, fits_broadcast, join_lookup, ship_package, stored

# Lists up to this size are held by every worker.
HELD_ROWS = 1_000_000
HELD_BYTES = 48 * 1024 * 1024
# The filter of a larger list: at most so many bytes, whatever the list's size; a fuller filter lets more stretches through.
BLOOM_BYTES = 32 * 1024 * 1024
# Longer words are looked for only where their first characters are found.
HEAD = 6
# Bytes of texts that are worked on together: a worker holds the hits and tokens of so much text only.
SLAB_BYTES = 1 << 18
# Bytes of the texts that look up their words together when the list is joined.
BLOCK_BYTES = 1 << 20

OTHER, ALONE, IN_RUN = 0, 1, 2
#: Spans as one number: the start above, and below it the end, from this number down.
LAST = (1 << 32) - 1


def slabs(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLAB_BYTES`` bytes."""
    start, total = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if total and total + size > SLAB_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(column):
        yield start, len(column)


def bloom_filter(words: DataFrame, rows: int, head: int = HEAD, most_bytes: int = BLOOM_BYTES) -> Bloom:
    """The filter of the column ``word`` of ``rows`` words: every task sets the bits of its words, and the parts are put together
    as bitmaps of 4 KB."""
    n = max(Bloom.size(2 * rows, most_bytes), 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.zeros(n, np.uint64)
        for batch in batches:
            listed = batch["word"].to_pylist()
            block, bits = Bloom.places(word_hashes(listed + [w[:head] for w in listed if len(w) > head]), n)
            np.bitwise_or.at(blocks, block, bits)
        parts = blocks.reshape(-1, 512)
        full = np.flatnonzero(parts.any(axis=1))
        yield pa.record_batch([pa.array(full), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["part", "bits"])

    parts = words.select("word").mapInArrow(run, "part long, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    blocks = np.zeros((n // 512, 512), np.uint64)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
        blocks[part] = np.frombuffer(bits, np.uint64)
    return Bloom(blocks.ravel())


def in_blocks(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the number ``_block`` of neighbouring rows whose texts have about ``BLOCK_BYTES`` together; stored, so that the numbers stand still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            blocks = []
            for size in pc.fill_null(pc.binary_length(batch[text_col]), 0).to_pylist():
                if total and total + size > BLOCK_BYTES:
                    block, total = block + 1, 0
                total += size
                blocks.append(block)
            yield batch.append_column("_block", pa.array(blocks, pa.int64()))

    return stored(df.mapInArrow(run, StructType([*df.schema.fields, StructField("_block", LongType())])), "rows")


def probable_words(rows: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """``_block, word, n``: stretches of the lower-cased texts of ``rows`` (_block, text) that are probably in ``words``, and how often each stands
    in a part of the block; all listed words that are there are among them.

    ``words``: different, not empty, lower-cased; read several times.
    """
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast(bloom_filter(words, words.count()).blocks)

    def emitted(block: int, found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([block] * len(found), pa.int64()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["_block", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, block, found, size = Bloom(shared.value), None, Counter(), 0
        for batch in batches:
            blocks = batch["_block"].to_pylist()
            for i, j in slabs(batch["text"]):
                texts = batch["text"].slice(i, j - i).to_pylist()
                cuts = [k for k in range(i, j) if k == i or blocks[k] != blocks[k - 1]]
                for begin, end in zip(cuts, [*cuts[1:], j]):
                    if found and (blocks[begin] != block or size > BLOCK_BYTES):
                        yield emitted(block, found)
                        found, size = Counter(), 0
                    block, own = blocks[begin], texts[begin - i : end - i]
                    codes, _ = lined_up(own)
                    size += len(codes)
                    stretches = Stretches(codes)
                    for at, n in probable(codes, bloom, lengths, HEAD):
                        found.update(stretches.counted(at, n))
        if found:
            yield emitted(block, found)

    text = rows.select("_block", normalized(F.col(text_col)).alias("text"))
    return text.mapInArrow(run, "_block long, word string, n long")


_kinds: dict[tuple[str, bool], np.ndarray] = {}


def character_kinds(df: DataFrame, keep_punctuation: bool) -> np.ndarray:
    """By code point: part of a run, a token by itself, or neither, as the patterns of the in-row plan see it."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, keep_punctuation)
    if key not in _kinds:
        planes = [(("".join(chr(c) for c in range(p << 16, (p + 1) << 16) if not 0xD800 <= c < 0xE000)),) for p in range(17)]
        found = (
            spark.createDataFrame(planes, "text string")
            .select(
                F.array_join(F.regexp_extract_all("text", F.lit(f"{RUN}+"), F.lit(0)), "").alias("runs"),
                F.array_join(F.regexp_extract_all("text", F.lit(single_class(keep_punctuation)), F.lit(0)), "").alias(
                    "alone"
                ),
            )
            .collect()
        )
        kinds = np.zeros(0x110000, np.uint8)
        for kind, name in ((ALONE, "alone"), (IN_RUN, "runs")):
            for row in found:
                kinds[np.frombuffer(row[name].encode("utf-32-le"), np.uint32)] = kind
        _kinds[key] = kinds
    return _kinds[key]


def _run_ends(kinds: np.ndarray) -> np.ndarray:
    """For each place, the end of what a token without dictionary would be: the rest of the run, or one character."""
    n = len(kinds)
    ends = np.arange(1, n + 1)
    last = np.append((kinds[1:] != IN_RUN) | (kinds[:-1] != IN_RUN), True)[:n]
    stops = np.flatnonzero(last)
    return np.where(kinds == IN_RUN, ends[stops[np.cumsum(last) - last]], ends)


def longest_spans(kinds: np.ndarray, pos: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Non-overlapping tokens (start, end) of one stretch: the longest hit, else the run, else the character."""
    best = np.zeros(len(kinds), np.int64)
    np.maximum.at(best, pos, length)
    places = np.arange(len(kinds))
    ends = np.where(best > 0, places + best, _run_ends(kinds)).tolist()
    shown = ((best > 0) | (kinds != OTHER)).tolist()
    out, i, n = [], 0, len(kinds)
    while i < n:
        if shown[i]:
            out.append((i, ends[i]))
        i = ends[i]
    return out


def finest_spans(kinds: np.ndarray, pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all hits, whole runs and characters that no hit covers, by start, longest first."""
    n = len(kinds)
    change = np.bincount(pos, minlength=n + 1) - np.bincount(pos + length, minlength=n + 1)
    alone = np.flatnonzero((kinds == ALONE) & (np.cumsum(change[:-1]) == 0))
    run = kinds == IN_RUN
    # One after the other, runs begin and end.
    edges = np.flatnonzero(np.diff(run, prepend=False, append=False))
    starts = np.concatenate([pos, alone, edges[::2]])
    ends = np.concatenate([pos + length, alone + 1, edges[1::2]])
    spans = np.sort(starts << 32 | LAST - ends)
    spans = spans[np.append(True, spans[1:] != spans[:-1])] if len(spans) else spans
    return spans >> 32, LAST - (spans & LAST)


def cut_out(text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """Stretches of a text, given by characters, as one array; ``codes`` are its code points, and others than characters stand for one byte."""
    data, at = np.frombuffer(text.encode(), np.uint8), None
    if len(data) != len(codes):
        size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        size[codes == GAP] = 1
        at = np.append(0, np.cumsum(size))
        starts, ends = at[starts], at[ends]
    offsets = np.append(0, np.cumsum(ends - starts))
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.take(index))).cast(pa.string())


def likeliest_spans(kinds: np.ndarray, pos: np.ndarray, length: np.ndarray, score: np.ndarray, unknown: int) -> list[tuple[int, int]]:
    """The tokens of the path with the highest sum of scores through the lattice of hits (by place, then length).

    A character outside the path's words costs ``unknown``, or nothing if it is neither part of a run nor a token; neighbours of one run
    are one token. Of equal paths, from the left, the one with a word, then with the longer word, is taken.
    """
    n = len(kinds)
    cost = np.where(kinds == OTHER, 0, unknown).tolist()
    best, size = [0] * (n + 1), [0] * n
    at, sizes, scores = pos.tolist(), length.tolist(), score.tolist()
    k = len(at) - 1
    for i in range(n - 1, -1, -1):
        top, chosen = None, 0
        while k >= 0 and at[k] == i:
            total = scores[k] + best[i + sizes[k]]
            if top is None or total > top or total == top and sizes[k] > chosen:
                top, chosen = total, sizes[k]
            k -= 1
        alone = cost[i] + best[i + 1]
        if top is not None and top >= alone:
            best[i], size[i] = top, chosen
        else:
            best[i] = alone
    out, i, kind = [], 0, kinds.tolist()
    while i < n:
        if size[i]:
            out.append((i, i + size[i]))
            i += size[i]
            continue
        end = i + 1
        while kind[i] == IN_RUN and end < n and not size[end] and kind[end] == IN_RUN:
            end += 1
        if kind[i] != OTHER:
            out.append((i, end))
        i = end
    return out


_tries: dict[str, Trie] = {}


@dataclass
class Held:
    """A list that every worker holds, with a value for each phrase."""

    shared: object
    key: str

    def get(self) -> tuple[Trie, list | None]:
        if self.key not in _tries:
            if len(_tries) > 3:  # a worker holds the lists of one job
                _tries.clear()
            _tries[self.key] = self.shared.value
        return _tries[self.key]


def hold(listed: DataFrame, value: str | None, held_rows: int) -> Held | None:
    """The words of ``listed`` (and a column of values) on every worker, if measured small enough, else None."""
    if not fits_broadcast(listed, held_rows, HELD_BYTES):
        return None
    table = listed.toArrow()
    values = table[value].to_pylist() if value else None
    return Held(listed.sparkSession.sparkContext.broadcast((Trie(table["word"].to_pylist()), values)), uuid.uuid4().hex)


Hits = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def trie_hits(trie: Trie, texts: list[str]) -> Hits:
    """For each text of a slab: places, lengths and numbers of the words in it, by place, then length."""
    codes, starts = lined_up(texts)
    place, length, number = trie.find(codes)
    cuts = np.searchsorted(place, starts)
    for k in range(len(texts)):
        own = slice(cuts[k], cuts[k + 1])
        yield place[own] - starts[k], length[own], number[own]


def finest_tokens(texts: list[str], trie: Trie, table: np.ndarray) -> pa.ListArray:
    """The tokens of all matches for each text of a slab, all texts at once: nothing reaches over the gaps between them."""
    codes, starts = lined_up(texts)
    gaps = codes == GAP
    kinds = table[np.where(gaps, 0, codes)]
    kinds[gaps] = OTHER
    begins, ends = finest_spans(kinds, *trie.find(codes, ordered=False)[:2])
    cuts = np.searchsorted(begins, starts).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), cut_out("\0".join(texts) + "\0", codes, begins, ends))


def listed_words(words: DataFrame, *values: str) -> DataFrame:
    """Different lower-cased words, stored; of the values of one word the smallest."""
    rows = words.select(F.lower("word").alias("word"), *values).where(F.length("word") > 0)
    rows = rows.groupBy("word").agg(*[F.min(v).alias(v) for v in values]) if values else rows.distinct()
    return cut_lineage(rows)


def segment_by_join(
    df: DataFrame,
    text_col: str,
    out_col: str,
    words: DataFrame,
    mode: str,
    phrases: DataFrame | None = None,
    keep_punctuation: bool = False,
    held_rows: int = HELD_ROWS,
    unknown: int = 0,
) -> DataFrame:
    """Add the token array ``out_col``. ``words``: (word), with ``score`` for the likeliest path; ``phrases``: (word, parts), where parts
    of null keep the phrase whole. Lists of up to ``held_rows`` are held by the workers, larger ones are joined."""
    spark = df.sparkSession
    ship_package(spark)
    likeliest = mode == "likeliest"
    listed = listed_words(words, *["score"] * likeliest)
    if listed.isEmpty():
        raise ValueError("the dictionary holds no words")
    fixed = None if phrases is None else listed_words(phrases, "parts")
    if fixed is not None and fixed.isEmpty():
        fixed = None
    table = character_kinds(df, keep_punctuation)
    held_words = hold(listed, "score" if likeliest else None, held_rows)
    held_phrases = hold(fixed, "parts", held_rows) if fixed is not None else None

    any_phrases = fixed is not None
    rows = df.drop(out_col)
    schema = StructType([*rows.schema.fields, StructField(out_col, ArrayType(StringType()))])

    def walk(kinds: np.ndarray, pos: np.ndarray, length: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
        if likeliest:
            return likeliest_spans(kinds, pos, length, score, unknown)
        if mode == "finest":
            return list(zip(*(x.tolist() for x in finest_spans(kinds, pos, length))))
        return longest_spans(kinds, pos, length)

    def tokens(text: str, hits: tuple[np.ndarray, np.ndarray, np.ndarray], whole: list[tuple[int, int, list | None]]) -> list[str]:
        kinds, (pos, length, score) = table[code_points(text)], hits
        if not whole:
            return [text[a:b] for a, b in walk(kinds, pos, length, score)]
        # The stretches between the phrases, each by itself: words that reach into a phrase do not count.
        out, at = [], 0
        first = np.searchsorted(pos, [end for _, end, _ in whole]).tolist()
        last = np.searchsorted(pos, [start for start, _, _ in whole]).tolist()
        for (start, end, parts), i, j in zip([*whole, (len(text), len(text), [])], [0, *first], [*last, len(pos)]):
            if at < start:
                inside = slice(i, j)
                if i < j and pos[j - 1] + length[i:j].max() > start:
                    inside = i + np.flatnonzero(pos[i:j] + length[i:j] <= start)
                out += [text[at + a : at + b] for a, b in walk(kinds[at:start], pos[inside] - at, length[inside], score[inside])]
            out += [text[start:end]] if parts is None else parts
            at = end
        return out

    def segmented(batch: pa.RecordBatch | pa.Table, words_of: tuple[Trie, list | None], phrases_of: tuple[Trie, list | None]) -> Iterator:
        """``batch`` in slabs, with the tokens: a worker never holds those of all its rows."""
        scores = np.array(words_of[1], np.int64) if likeliest else None
        for i, j in slabs(batch["_text"]):
            texts = batch["_text"].slice(i, j - i).to_pylist()
            if mode == "finest" and not any_phrases:
                done = finest_tokens(texts, words_of[0], table)
                yield batch.slice(i, j - i).drop_columns(["_text"]).append_column(out_col, done)
                continue
            found = []
            whole = trie_hits(phrases_of[0], texts) if any_phrases else ((None, None, None) for _ in texts)
            for text, (pos, length, number), (at, size, which) in zip(texts, trie_hits(words_of[0], texts), whole):
                taken = leftmost_longest(at, size).tolist() if any_phrases else []
                kept = [(int(at[k]), int(at[k] + size[k]), phrases_of[1][which[k]]) for k in taken]
                found.append(tokens(text, (pos, length, scores[number] if likeliest else number), kept))
            yield batch.slice(i, j - i).drop_columns(["_text"]).append_column(out_col, pa.array(found, pa.list_(pa.string())))

    if held_words and (held_phrases or not any_phrases):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from segmented(batch, held_words.get(), held_phrases.get() if held_phrases else (None, None))

        return rows.withColumn("_text", normalized(F.col(text_col))).mapInArrow(run, schema)

    rows = in_blocks(rows, text_col)
    there = []
    for kind, held, listing in (("words", held_words, listed), ("phrases", held_phrases, fixed)):
        if listing is not None and not held:
            found = stored(probable_words(rows, text_col, listing).select("_block", "word"), "found")
            own = [F.col(c) if c in listing.columns else F.lit(None).cast(t).alias(c) for c, t in (("score", "long"), ("parts", "array<string>"))]
            there.append(join_lookup(found, listing, "word", "inner", split=True).select("_block", F.lit(kind).alias("kind"), "word", *own))
    in_list = there[0] if len(there) == 1 else there[0].unionByName(there[1])

    def of_block(found: pa.Table, kind: str, value: str | None) -> tuple[Trie, list | None]:
        own = found.filter(pc.equal(found["kind"], kind))
        words = dict(zip(own["word"].to_pylist(), own[value].to_pylist() if value else [None] * len(own)))
        return Trie(list(words)), list(words.values())

    def run_block(batch: pa.Table, found: pa.Table) -> pa.Table:
        words_of = held_words.get() if held_words else of_block(found, "words", "score" if likeliest else None)
        phrases_of = (None, None)
        if any_phrases:
            phrases_of = held_phrases.get() if held_phrases else of_block(found, "phrases", "parts")
        done = segmented(batch.drop_columns(["_block"]), words_of, phrases_of)
        return pa.concat_tables(done)

    texts = by_key(rows, "_block").withColumn("_text", normalized(F.col(text_col)))
    return texts.groupBy("_block").cogroup(in_list.groupBy("_block")).applyInArrow(run_block, schema)


def learn_scores(df: DataFrame, text_col: str, words: DataFrame, held_rows: int = HELD_ROWS) -> tuple[DataFrame, int]:
    """``word, n, score`` and the score of an unknown character: how often each word stands anywhere in the texts, and the logarithm of its share
    (with one added to each count), in millionths, so that sums are exact."""
    spark = df.sparkSession
    ship_package(spark)
    listed = listed_words(words)
    held = hold(listed, None, held_rows)
    if held:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0, np.int64)
            for batch in batches:
                for i, j in slabs(batch["text"]):
                    codes, _ = lined_up(batch["text"].slice(i, j - i).to_pylist())
                    counts = np.bincount(held.get()[0].find(codes)[2], minlength=len(total))
                    counts[: len(total)] += total
                    total = counts
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["number", "n"])

        partial = df.select(normalized(F.col(text_col)).alias("text")).mapInArrow(run, "number long, n long")
        order = listed.toArrow()["word"].to_pylist()  # as held: at most held_rows
        names = spark.createDataFrame([(k, w) for k, w in enumerate(order)], "number long, word string")
        counted = partial.groupBy("number").agg(F.sum("n").alias("n")).join(names, "number").select("word", "n")
    else:
        found = probable_words(df.select(F.lit(0).cast("long").alias("_block"), text_col), text_col, listed)
        counted = found.groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(listed.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    size, total = counts.agg(F.count("*"), F.sum("n")).first()
    whole = (total or 0) + size + 1
    score = lambda n: F.round(F.log((n + 1) / F.lit(float(whole))) * 1e6).cast("long")
    unknown = spark.range(1).select(score(F.lit(0))).first()[0]
    return counts.withColumn("score", score(F.col("n"))), unknown
