"""Text scores by prediction by partial matching over bytes, beside a unigram baseline over words.

The trie of byte contexts (up to six bytes) holds what followed each of them in the training texts. A symbol unseen in the longest
context escapes to the next shorter one (escape method D), where symbols already ruled out are excluded; the last resort
is a uniform choice. The counts are pretrained, so the probability of each gram (a context and the byte after it) is worked out once, and a
document's code length is a sum over its grams. Every context that was counted is in the model: it is a stored table, whose most frequent grams
every worker holds, and to which the other grams of the documents are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import Shared, map_arrow, map_batches, prepare_session, slabs, store, text_bytes
from ticketmill.llm.shingles import mix

ORDER = 6
#: Stands before and after a text; no UTF-8 text has this byte.
EDGE = 0xFF
#: Tokens with less than this share of all are never looked up in a broadcast table.
HOT_SHARE = 1 / 2_000_000
#: Bytes of the most frequent tokens, and of the most frequent grams, that every worker holds; all others are joined.
HOT_BYTES = 96 << 20
#: Bytes that a token takes in the workers' table besides its own, and a gram in all.
TOKEN_BYTES, GRAM_BYTES = 150, 12
#: Bytes of texts whose places are listed at a time.
PLACE_BYTES = 1 << 20
#: Bytes of text for each part of the model, and grams of a part that travel in one row.
PART_BYTES, ROW_GRAMS = 8 << 20, 2048
#: Distinct tokens, and grams, that a task counts before it sends what it has.
FLUSH = 400_000
FLUSH_GRAMS = 1_000_000


# -- the unigram baseline ---------------------------------------------------------------------------------------------


def tokens_of(text: bytes) -> list[bytes]:
    """Words of the text with A-Z lower-cased, split at ASCII white space. The end token is the empty word."""
    return text.lower().split()


def count_tokens(documents: DataFrame, held_out: Column) -> DataFrame:
    """(token, c, c_all): occurrences in training documents and in all; a document ends with one end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            keys = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                train, rest = ([counts[k].get(t, 0) for t in part] for k in (0, 1))
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array(train, pa.int64()), pa.array(rest, pa.int64())], ["token", "c", "other"])
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, out in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["held_out"].to_pylist()):
                into = counts[bool(out)]
                into.update(tokens_of(text or b""))
                into[b""] += 1
                if len(into) > FLUSH:
                    yield from rows()
        yield from rows()

    found = map_arrow(documents.select("text", held_out.alias("held_out")), run, "token binary, c long, other long")
    return found.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") + F.col("other")).alias("c_all"))


def hot_class(n: Column) -> Column:
    """Class of a count: four for each power of two."""
    return F.floor(4 * F.log2(n)).cast("int")


def hot_from(sizes: DataFrame) -> int:
    """The lowest class so that all (class, bytes) from there on take at most HOT_BYTES together."""
    left, lowest = HOT_BYTES, 1 << 16
    for k, used in sorted(sizes.groupBy("class").agg(F.sum("bytes")).collect(), reverse=True):
        if used > left:
            break
        left, lowest = left - used, k
    return lowest


# -- grams ---------------------------------------------------------------------------------------------------------------


def _framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each after ORDER edges and before one; and where each begins."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    framed = np.full(len(data) + n * (ORDER + 1), EDGE, np.uint8)
    starts = offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    shift = np.repeat(starts - offsets[:-1], lengths)
    framed[np.arange(len(data)) + shift] = data
    return framed, starts


def _grams(framed: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each place from ORDER on and the byte there, as one number.

    The nearest byte of the context is the highest, so that contexts with a common suffix are neighbours; the byte at the place is the lowest.
    """
    n = len(framed) - ORDER
    gram = np.zeros(n, np.int64)
    for k in [*range(ORDER - 1, -1, -1), ORDER]:
        gram <<= 8
        gram |= framed[k : n + k]
    return gram


def _places(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's symbols, its end included, in the array of contexts."""
    begin = starts - ORDER
    return np.stack([begin, begin + np.diff(offsets) + 1], axis=1).ravel()


def _inside(framed: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each place: the text whose symbol it is, or -1 between the symbols of two texts."""
    begin, end = _places(starts, offsets).reshape(-1, 2).T
    text = np.full(len(framed) - ORDER, -1, np.int32)
    length = end - begin
    index = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
    text[index] = np.repeat(np.arange(len(begin), dtype=np.int32), length)
    return text


#: Marks grams of held-out texts while they are counted; grams have 56 bits.
OUT = np.int64(1 << 62)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sum of each one's counts, of one kind or several."""
    if not len(keys):
        return keys, *counts
    # What comes here are sorted runs end to end, which the stable sort merges.
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(n[order], first) for n in counts)


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers as planes of their first bytes, second bytes and so on: zeros come together, which shuffles and files compress."""
    return np.ascontiguousarray(x.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.int64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


#: Orders whose counts every worker holds: their number is bounded by the bytes' values, not by the texts.
LOW_ORDERS = 3


def _pieces(grams: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places in it) of sorted grams in pieces of at most ROW_GRAMS, in order; the LOW_ORDERS nearest bytes decide on the part."""
    near = grams >> 8 * (ORDER + 1 - LOW_ORDERS)
    part = (mix(near.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    begins = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(part)).tolist()):
        for i in range(a, b, ROW_GRAMS):
            yield int(part[order[a]]), order[i : min(i + ROW_GRAMS, b)]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of packed rows; columns of the schema after those of the rows are null."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(x, f.type) for x, f in zip(zip(*held), schema)]
        return pa.record_batch([*arrays, *(pa.nulls(len(held), f.type) for f in list(schema)[len(arrays) :])], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == 200:
            yield batch()
            held.clear()
    if held:
        yield batch()


def count_grams(documents: DataFrame, parts: int) -> DataFrame:
    """Packed (part, grams, n, held_out): counts over all places of all texts; a gram may be in several rows of its part."""
    schema = pa.schema([("part", pa.int64()), ("grams", pa.binary()), ("n", pa.binary()), ("held_out", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sorted grams, the highest bit says if held out, and their counts

        def merge() -> int:
            """Bring what is held together; how many grams there are."""
            if len(held) > 1:
                held[:] = [_summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))]
            return sum(len(g) for g, _ in held)

        def rows() -> Iterator[tuple]:
            for keys, counts in held:
                cut = int(np.searchsorted(keys, OUT))
                for out, some, n in ((False, keys[:cut], counts[:cut]), (True, keys[cut:] ^ OUT, counts[cut:])):
                    for part, at in _pieces(some, parts):
                        yield part, pack_sorted(some[at]), pack(n[at]), out
            held.clear()

        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            out = np.where(np.array(batch["held_out"].to_pylist(), bool), OUT, np.int64(0))
            for i, j in slabs(np.diff(offsets), PLACE_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                framed, starts = _framed(data[offsets[i] : offsets[j]], own)
                text = _inside(framed, starts, own)
                place = text >= 0
                held.append(np.unique(_grams(framed)[place] | out[i:j][text[place]], return_counts=True))
            if sum(len(g) for g, _ in held) > 2 * FLUSH_GRAMS and merge() > FLUSH_GRAMS:
                yield from _batches(rows(), schema)
        merge()
        yield from _batches(rows(), schema)

    return map_arrow(documents.select("text", "held_out"), run, "part long, grams binary, n binary, held_out boolean")


class Counts:
    """What followed each context of one order: the grams of that order (context, then symbol), sorted, and their counts.

    ``exclude`` has, for each context, the shorter order's count of the symbols seen here, which are excluded there.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, shorter: Counts | None):
        self.grams, self.n = _summed(grams, n)
        of = self.grams >> 8
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        self.contexts, self.kinds = of[begins], np.diff(np.append(begins, len(of)))
        self.total = np.add.reduceat(self.n, begins) if len(of) else begins
        self.exclude = np.zeros_like(self.total)
        if shorter is not None and len(of):
            self.exclude = np.add.reduceat(shorter.count(self.grams >> 16 << 8 | self.grams & 255), begins)

    def count(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.n[at], 0)

    def after(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, kinds and ``exclude`` of each context; zeros for one that was not seen."""
        if not len(self.contexts):
            return (np.zeros(len(contexts), np.int64),) * 3
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        seen = self.contexts[at] == contexts
        return tuple(np.where(seen, x[at], 0) for x in (self.total, self.kinds, self.exclude))


def _of_order(grams: np.ndarray, k: int) -> np.ndarray:
    """The grams with the ``k`` nearest bytes of their context only."""
    return grams >> 8 * (ORDER + 1 - k) << 8 | grams & 255


def gram_logs(grams: np.ndarray, n: np.ndarray, low: list[Counts]) -> np.ndarray:
    """log10 of the probability of each gram's symbol after its context.

    ``grams`` are sorted and distinct, with all grams whose contexts have the len(low) nearest bytes in common; ``n`` are the counts in
    training texts, which may be 0; ``low`` are the counts of the orders from 0. A symbol that followed a context also followed its suffixes,
    so what is excluded in an order is what was seen in the next longer one.
    """
    seen, tables = n > 0, list(low)
    for k in range(len(low), ORDER + 1):
        tables.append(Counts(_of_order(grams[seen], k), n[seen], tables[-1]))
    value = np.zeros(len(grams))
    total, kinds, _ = tables[ORDER].after(grams[seen] >> 8)
    value[seen] = np.log10((n[seen] - np.where(kinds < 256, 0.5, 0.0)) / total)
    rest = grams[~seen]
    out, left, done = np.ones(len(rest)), np.ones(len(rest)), np.zeros(len(rest), bool)
    excluded, ruled_out = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
    for k in range(ORDER, -1, -1):
        own = _of_order(rest, k)
        total, kinds, longer = tables[k].after(own >> 8)
        # Method D: each symbol seen gives half a count to the escape, unless no symbol is left to escape to.
        given, open_counts = np.where(kinds < 256, 0.5, 0.0), total - excluded
        share = left / np.where(open_counts > 0, open_counts, 1)
        count = tables[k].count(own)
        hit = ~done & (count > 0)
        out[hit] = ((count - given) * share)[hit]
        done |= hit
        left = np.where(open_counts > 0, given * (kinds - ruled_out) * share, left)
        excluded, ruled_out = longer, kinds
    out[~done] = (left / np.maximum(256 - ruled_out, 1))[~done]
    value[~seen] = np.log10(out)
    return value


def low_counts(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the longest low order and their counts in training texts; there are at most 2 to the power of 8 * LOW_ORDERS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for own, n in zip(batch["grams"].to_pylist(), batch["n"].to_pylist()):
                held.append(_summed(_of_order(unpack_sorted(own), LOW_ORDERS - 1), unpack(n)))
            held[:] = [_summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))]
        for grams, n in held:
            yield pa.record_batch([pa.array(grams), pa.array(n)], ["gram", "n"])

    rows = map_arrow(counted.filter("NOT held_out").select("grams", "n"), run, "gram long, n long")
    found = rows.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return found["gram"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)


def model_table(counted: DataFrame) -> DataFrame:
    """Every gram of all texts, the log10 of its probability and its counts in all texts: packed (part, grams, logs, times)."""

    def make(arrays: tuple[np.ndarray, np.ndarray]) -> list[Counts]:
        low: list[Counts] = []
        for k in range(LOW_ORDERS):
            low.append(Counts(arrays[0] >> 8 * (LOW_ORDERS - k) << 8 | arrays[0] & 255, arrays[1], low[-1] if low else None))
        return low

    shared = Shared(counted.sparkSession, low_counts(counted), make)
    schema = pa.schema([("part", pa.int64()), ("grams", pa.binary()), ("logs", pa.binary()), ("times", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        low, part, held, size = shared.get(), None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The grams held, and their counts in training texts and in all."""
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        def finished() -> Iterator[tuple]:
            if held:
                grams, train, n = merged()
                logs = gram_logs(grams, train, low).astype(np.float32)
                for i in range(0, len(grams), ROW_GRAMS):
                    some = slice(i, i + ROW_GRAMS)
                    yield part, pack_sorted(grams[some]), logs[some].tobytes(), pack(n[some])

        for batch in batches:
            for p, own, times, out in zip(*(batch[c].to_pylist() for c in ("part", "grams", "n", "held_out"))):
                if p != part:
                    yield from finished()
                    part, held, size = p, [], 0
                grams, n = unpack_sorted(own), unpack(times)
                held.append((grams, np.zeros_like(n) if out else n, n))
                size += len(grams)
                if size > 2 * FLUSH_GRAMS:
                    held[:] = [merged()]
                    # The next merge is due when as much has come again.
                    size = min(len(held[0][0]), FLUSH_GRAMS)
        yield from finished()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    return map_arrow(counted.repartition("part").sortWithinPartitions("part"), run, "part long, grams binary, logs binary, times binary", shared)


def hot_grams(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, sorted, and their logs, as far as HOT_BYTES go."""

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([unpack(x) for x in batch["times"].to_pylist()])
        of, count = np.unique(np.floor(4 * np.log2(n)).astype(np.int32), return_counts=True)
        return pa.record_batch([pa.array(of, pa.int32()), pa.array(count * GRAM_BYTES, pa.int64())], ["class", "bytes"])

    lowest = hot_from(map_batches(model.select("times"), sizes, "class int, bytes long"))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, logs = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for own, values, times in zip(*(batch[c].to_pylist() for c in ("grams", "logs", "times"))):
            kept = np.floor(4 * np.log2(unpack(times))) >= lowest
            if kept.any():
                grams.append(unpack_sorted(own)[kept])
                logs.append(np.frombuffer(values, np.float32)[kept])
        return pa.record_batch([pa.array(np.concatenate(grams)), pa.array(np.concatenate(logs))], ["gram", "log"])

    found = map_batches(model.select("grams", "logs", "times"), pick, "gram long, log float").toArrow()
    grams, logs = found["gram"].to_numpy().astype(np.int64, copy=False), found["log"].to_numpy().astype(np.float32, copy=False)
    order = np.argsort(grams)
    return grams[order], logs[order]


def sorted_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams at all places of at most 256 texts, sorted, and the text of each. Both are sorted as one number: a gram has 56 bits."""
    framed, starts = _framed(data, offsets)
    text = _inside(framed, starts, offsets)
    place = text >= 0
    both = _grams(framed)[place].view(np.uint64) << np.uint64(8) | text[place].astype(np.uint64)
    both.sort()
    return (both >> np.uint64(8)).view(np.int64), (both & np.uint64(255)).astype(np.int32)


def known_logs(keys: np.ndarray, hot_keys: np.ndarray, hot_logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted keys: whether it is one of the hot ones, and its log, else 0. Equal keys are looked up once."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(hot_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    distinct, times = keys[first], np.diff(np.append(first, len(keys)))
    at = np.minimum(np.searchsorted(hot_keys, distinct), len(hot_keys) - 1)
    known = hot_keys[at] == distinct
    return np.repeat(known, times), np.repeat(np.where(known, hot_logs[at], np.float32(0)), times)


def look_up(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """``wanted`` with its packed rows (part from 0 on, base, grams, docs) replaced by (base, sums): the logs of a part's grams summed up for
    each of the rows from ``base`` on. Rows with a negative part pass. A part's model comes before what is looked up in it, a piece at a time.
    """
    out_schema = wanted.drop("part", "grams", "docs").schema.add("sums", "binary")
    columns = wanted.columns
    both = model.select("part", "grams", "logs").unionByName(wanted, allowMissingColumns=True).withColumn("is_wanted", F.col("logs").isNull())
    dealt = both.repartition("part").sortWithinPartitions("part", "is_wanted", "base")
    passed = [c for c in columns if c not in ("part", "grams", "docs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, grams, logs, base, sums, done = None, [], None, None, None, np.zeros(0), []

        def flush() -> pa.RecordBatch:
            bases, values = zip(*done)
            done.clear()
            arrays = [pa.array(bases, f.type) if f.name == "base" else pa.nulls(len(bases), f.type) for f in (batch.schema.field(c) for c in passed)]
            return pa.record_batch([*arrays, pa.array(values, pa.binary())], [*passed, "sums"])

        def close() -> None:
            if base is not None:
                done.append((base, sums.tobytes()))

        for batch in batches:
            own_part = batch["part"].to_numpy()
            through = pa.array(own_part < 0)
            if own_part[0] < 0:
                some = batch.filter(through)
                yield pa.record_batch([*(some[c] for c in passed), pa.nulls(some.num_rows, pa.binary())], [*passed, "sums"])
            packed = batch.filter(pa.array(own_part >= 0))
            for p, is_wanted, at, own, values, docs in zip(*(packed[c].to_pylist() for c in ("part", "is_wanted", "base", "grams", "logs", "docs"))):
                if p != part:
                    close()
                    part, held, grams, base = p, [], None, None
                if not is_wanted:
                    held.append((unpack_sorted(own), np.frombuffer(values, np.float32)))
                    continue
                if grams is None:
                    held.sort(key=lambda piece: piece[0][0])
                    grams, logs = (np.concatenate(x) for x in zip(*held))
                    held = []
                if at != base:
                    close()
                    base, sums = at, np.zeros(0)
                place = np.searchsorted(grams, unpack_sorted(own))
                some = np.bincount(unpack(docs), logs[place])
                if len(some) > len(sums):
                    sums = np.append(sums, np.zeros(len(some) - len(sums)))
                sums[: len(some)] += some
            if len(done) > 200:
                yield flush()
        close()
        if done:
            yield flush()

    return map_arrow(dealt, run, out_schema)


def add_sums(rows: DataFrame) -> DataFrame:
    """(rid, score) from (base, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sums = None, np.zeros(0)

        def finished() -> Iterator[pa.RecordBatch]:
            if base is not None:
                yield pa.record_batch([pa.array(np.arange(base, base + len(sums))), pa.array(sums)], ["rid", "score"])

        for batch in batches:
            for at, blob in zip(batch["base"].to_pylist(), batch["sums"].to_pylist()):
                if at != base:
                    yield from finished()
                    base, sums = at, np.zeros(0)
                some = np.frombuffer(blob, np.float64)
                if len(some) > len(sums):
                    sums = np.append(sums, np.zeros(len(some) - len(sums)))
                sums[: len(some)] += some
        yield from finished()

    return map_arrow(rows.repartition("base").sortWithinPartitions("base"), run, "rid long, score double")


# -- the model in one process: the definition that the stored one is tested against ----------------------------------------


@dataclass
class Trie:
    """For each order from 0: its contexts, sorted, and what followed each: where its symbols begin, the symbols, their counts."""

    contexts: list[np.ndarray]
    begins: list[np.ndarray]
    symbols: list[np.ndarray]
    counts: list[np.ndarray]

    def rows(self, order: int, at: np.ndarray) -> np.ndarray:
        """Counts of the 256 symbols, a row for each of the given contexts."""
        begin, length = self.begins[order][at], np.diff(self.begins[order])[at]
        index = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        out = np.zeros((len(at), 256))
        out[np.repeat(np.arange(len(at)), length), self.symbols[order][index]] = self.counts[order][index]
        return out


def distributions(chain: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the 256 symbols, row by row, from counts in the longest context down to the empty one."""
    shape = chain[0].shape
    out, left, excluded = np.zeros(shape), np.ones(shape[0]), np.zeros(shape, bool)
    for counts in chain:
        open_counts = np.where(excluded, 0.0, counts)
        seen = open_counts > 0
        total, kinds = open_counts.sum(axis=1), seen.sum(axis=1)
        excluded = excluded | seen
        # Method D: each symbol seen gives half a count to the escape, unless no symbol is left to escape to.
        given = np.where(excluded.all(axis=1), 0.0, 0.5)
        share = left / np.where(total > 0, total, 1)
        out += np.where(seen, open_counts - given[:, None], 0.0) * share[:, None]
        left = np.where(total > 0, given * kinds * share, left)
    rest = ~excluded
    return out + np.where(rest, (left / np.maximum(rest.sum(axis=1), 1))[:, None], 0.0)


class Coder:
    """The trie as arrays: the log10 probabilities after each context, and the context that is one byte longer.

    Columns are the bytes of the model's texts, and one for all others, which are equally likely everywhere.
    """

    def __init__(self, trie: Trie):
        empty = trie.rows(0, np.zeros(1, int)) if len(trie.contexts[0]) else np.zeros((1, 256))
        known = np.flatnonzero(empty[0])
        self.width = len(known) + 1
        self.column = np.full(256, len(known), np.int64)
        self.column[known] = np.arange(len(known))
        other = np.flatnonzero(empty[0] == 0)[:1]
        kept = np.append(known, other if len(other) else known[:1])
        tables, rows = [np.log10(distributions([empty]))[:, kept]], [np.zeros(1, np.int64)]
        done = 1
        for order in range(1, ORDER + 1):
            listed = trie.contexts[order]
            for i in range(0, len(listed), 2048):
                some = listed[i : i + 2048]
                chain = [trie.rows(order, i + np.arange(len(some)))]
                for shorter in range(order - 1, 0, -1):
                    at = np.searchsorted(trie.contexts[shorter], some & ((1 << 8 * shorter) - 1))
                    chain.append(trie.rows(shorter, at))  # a suffix is at least as frequent, so it is in the model
                chain.append(np.repeat(empty, len(some), axis=0))
                tables.append(np.log10(distributions(chain))[:, kept])
            rows.append(done + np.arange(len(listed)))
            done += len(listed)
        self.table = np.concatenate(tables).astype(np.float32).ravel()
        # A context without the longer one stays where it is.
        longer = np.repeat(np.arange(done, dtype=np.int32)[:, None], self.width, axis=1)
        for order in range(1, ORDER + 1):
            listed = trie.contexts[order]
            parent = rows[order - 1][np.searchsorted(trie.contexts[order - 1], listed & ((1 << 8 * (order - 1)) - 1))]
            longer[parent, self.column[listed >> 8 * (order - 1)]] = rows[order]
        self.longer = longer.ravel()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text and its end: walk from the empty context to the longest at every place."""
        out = np.zeros(len(offsets) - 1)
        for i, j in slabs(np.diff(offsets)):
            own = offsets[i : j + 1] - offsets[i]
            framed, starts = _framed(data[offsets[i] : offsets[j]], own)
            column = self.column[framed]
            n = len(framed) - ORDER
            row = np.zeros(n, np.int64)
            moved = np.ones(n, bool)
            for k in range(1, ORDER + 1):
                step = self.longer[row * self.width + column[ORDER - k : ORDER - k + n]]
                # Once a context was not found, longer ones are not looked for.
                moved &= step != row
                row = np.where(moved, step, row)
            value = self.table[row * self.width + column[ORDER:]].astype(np.float64)
            out[i:j] = np.add.reduceat(np.append(value, 0.0), _places(starts, own))[::2]
        return out


# -- both together -------------------------------------------------------------------------------------------------------

def score_documents(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model and the baseline learn from the rows that are not held out. A null text counts as empty: its only token is the
    end. Repeated rows get the same result each. With no training rows every token is unknown and the bytes are uniform.
    """
    spark = documents.sparkSession
    prepare_session(spark)
    documents = documents.select("doc_id", "text", held_out.alias("held_out"))
    counted = store(count_tokens(documents, F.col("held_out")), "token-counts")
    n, distinct, n_all = counted.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("c_all")).first()
    n, distinct, n_all = n or 0, distinct or 0, n_all or 0
    frequent = counted.filter(F.col("c_all") >= F.lit(n_all * HOT_SHARE)).withColumn("class", hot_class(F.col("c_all")))
    lowest = hot_from(frequent.select("class", (F.octet_length("token") + TOKEN_BYTES).alias("bytes")))
    hot_rows = frequent.filter(F.col("class") >= lowest).select("token", "c").toArrow()
    hot = dict(zip(hot_rows["token"].to_pylist(), (math.log10(c + 1) for c in hot_rows["c"].to_pylist())))  # 0: in held-out documents only
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-n_bytes // PART_BYTES))
    model = store(model_table(store(count_grams(documents, parts), "grams")), "model")
    shared = Shared(spark, (hot, *hot_grams(model)))
    denominator = float(n + distinct + 1)
    log_denominator = math.log10(denominator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, hot_keys, hot_logs), rid = shared.get(), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            scores = np.zeros(batch.num_rows)
            several = ((a, min(a + 256, j)) for i, j in slabs(np.diff(offsets), PLACE_BYTES) for a in range(i, j, 256))
            for i, j in several:
                keys, text = sorted_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                known, logs = known_logs(keys, hot_keys, hot_logs)
                scores[i:j] = np.bincount(text, logs, minlength=j - i)
                keys, text = keys[~known], text[~known]
                yield from _batches(((p, rid + i, pack_sorted(keys[x]), pack(text[x])) for p, x in _pieces(keys, parts)), arrow)
            raw = data.tobytes()
            n_tokens, n_known, base, rare, rare_times = [], [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = tokens_of(raw[a:b])
                words.append(b"")
                found = Counter(words)
                known, total, own_rare, own_times = 0, 0.0, [], []
                for token, k in found.items():
                    log = hot.get(token)
                    if log is None:
                        own_rare.append(token)
                        own_times.append(k)
                    else:
                        known += k if log else 0
                        total += k * (log - log_denominator)
                n_tokens.append(len(words))
                n_known.append(known)
                base.append(total)
                rare.append(own_rare)
                rare_times.append(own_times)
            ids = np.arange(rid, rid + batch.num_rows)
            rid += batch.num_rows
            nulls = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary())]
            arrays = [pa.array(-1 - ids % parts), *nulls, pa.array(ids), batch["doc_id"], batch["held_out"]]
            arrays += [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)]
            arrays += [pa.array(rare, pa.list_(pa.binary())), pa.array(rare_times, pa.list_(pa.int32()))]
            yield pa.record_batch(arrays, schema=arrow)

    # Packed rows of the grams that are to be looked up, and rows of documents.
    packed = [("part", pa.int64()), ("base", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary())]
    of_documents = [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("hot_known", pa.int64())]
    of_documents += [("hot_base", pa.float64()), ("hot_score", pa.float64()), ("rare", pa.list_(pa.binary())), ("rare_times", pa.list_(pa.int32()))]
    arrow = pa.schema(packed + of_documents)
    schema = "part long, base long, grams binary, docs binary, rid long, doc_id long, held_out boolean, n_tokens long, hot_known long"
    schema += ", hot_base double, hot_score double, rare array<binary>, rare_times array<int>"
    mixed = store(look_up(map_arrow(documents, run, schema, shared), model), "scored")
    scored = mixed.filter("sums IS NULL").drop("base", "sums")
    by_gram = add_sums(mixed.filter("sums IS NOT NULL").select("base", "sums")).withColumnRenamed("rid", "_rid")
    wanted = scored.select("rid", F.explode(F.arrays_zip("rare", "rare_times")).alias("t")).select("rid", F.col("t.rare").alias("token"), F.col("t.rare_times").alias("k"))
    rest = (
        wanted.join(counted.select("token", "c"), "token")
        .groupBy("rid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(denominator))).alias("base"))
    )
    return (
        scored.drop("rare", "rare_times")
        .join(rest, "rid", "left")
        .join(by_gram, F.col("rid") == F.col("_rid"), "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("hot_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
            (F.col("hot_score") + F.coalesce("score", F.lit(0.0))).alias("score"),
        )
    )
