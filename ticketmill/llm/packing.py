"""Best-two-fit packing of token sequences into bins of one size.

A bin is filled greedily, the largest piece that fits first; then its smallest piece is replaced by the two unpacked pieces that
fit its room more tightly, if there are such. What a bin can take depends on lengths alone, and there are at most as
many lengths as a bin has tokens: the plan is made from the count of pieces of each length, a whole run of
equal bins at a time, and its size does not grow with the data. A piece finds its bin by its number among the pieces of its
length, which come from counts by task: no piece is sorted, and no group is gathered.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketmill.llm.bpe import _ODD, _SPACE, BLOCK_CHARS, Tables, byte_alphabet, merge, parse
from ticketmill.llm.rows import Shared, extended, map_arrow, map_batches, prepare_session, store
from ticketmill.session import join_lookup

CAPACITY = 2048
#: Ends every document.
END_ID = 0
#: Chunks of text between white space that a worker remembers before it starts afresh, and the longest of them.
MEMO_CHUNKS = 400_000
MEMO_LENGTH = 48
#: Characters of texts whose unknown chunks are encoded at once.
SLAB_CHARS = 1 << 20


# Fixed value: how the word-level file parts lower-case text of these characters.
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN_CHUNK = re.compile(f"(?!.*<\\|)[!-~À-ÖØ-öø-ÿ]{{1,{MEMO_LENGTH}}}")
#: Stands for the end of a word; no plain chunk has it.
_END = "\x7f"


def ranked_words(tables: Tables) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray] | None:
    """The merge list as ranks of byte strings, in which a word ends with a byte of its own; ids by rank; ranks that end a word.

    Ranks merge any two neighbours whose bytes make a token, the list only its own pairs. They agree if every token comes
    from one pair, and the list makes every token out of its own bytes: a pair that is not listed then never stands side by side. Else None.
    """
    if len({new for _, new in tables.merges.values()}) < len(tables.merges):
        return None
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    n = len(tables.inner)
    special = set(tables.special.values())
    ids = {b: tables.inner[b] for b in range(n)} | {n + b: tables.last[b] for b in range(n)}
    ranks = {bytes([b]): b for b in range(n)} | {bytes([b]) + _END.encode(): n + b for b in range(n) if chr(b) != _END}
    texts = {i: (bytes(byte[c] for c in t.removesuffix(tables.suffix)), t.endswith(tables.suffix)) for i, t in enumerate(tables.tokens) if t and i not in special}
    for rank, new in tables.merges.values():
        data, ends = texts[new]
        symbols = [tables.inner[b] for b in data[:-1]] + [(tables.last if ends else tables.inner)[data[-1]]]
        if merge(symbols, tables.merges) != [new]:
            return None
        ranks[data + _END.encode() * ends] = 2 * n + rank
        ids[2 * n + rank] = new
    table, last = np.zeros(max(ids) + 1, "<u4"), np.zeros(max(ids) + 1, bool)
    for rank, i in ids.items():
        table[rank] = i
        last[rank] = n <= rank < 2 * n or texts[i][1]
    return tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}), table, last


class ChunkIds(dict):
    """Ids of chunks of text between white space, as little-endian 32-bit integers.

    The file's tokens never reach over white space, so a text's ids are those of its chunks. Unknown chunks are encoded many at a time:
    short plain ones by ranks, as far as those are proven to give the same, all others by the tokenizers library. Short ones are remembered.
    """

    def __init__(self, file: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranked = ranked_words(parse(json.loads(file)))

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [_SPACE.split(t) if _ODD.search(t) else t.split() for t in texts]
        new = set().union(*lists).difference(self)
        if len(self) + len(new) > MEMO_CHUNKS:
            self.clear()
            new = set().union(*lists)
        plain = list(filter(_PLAIN_CHUNK.fullmatch, new)) if self.ranked else []
        others = list(new.difference(plain))
        if plain:
            self._learn(plain)
        for at in range(0, len(others), 1000):
            some = others[at : at + 1000]
            self.update(zip(some, [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]))
        out = [b"".join(map(self.__getitem__, x)) for x in lists]
        for chunk in others:
            if len(chunk) > MEMO_LENGTH:
                del self[chunk]
        return out

    def _learn(self, chunks: list[str]) -> None:
        encoding, ids, last = self.ranked
        words = [_PLAIN_WORDS.findall(c.lower()) for c in chunks]
        found = np.array(encoding.encode_ordinary(_END.join(w for x in words for w in x) + _END), np.int64)
        ends = np.flatnonzero(last[found]) + 1
        cuts = np.append(0, ends[np.cumsum([len(x) for x in words]) - 1] * 4).tolist()
        data = ids[found].tobytes()
        self.update(zip(chunks, [data[i:j] for i, j in zip(cuts, cuts[1:])]))


def blocks(text: str) -> Iterator[str]:
    """A long text in blocks that end with white space."""
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        space = _SPACE.search(text, end) if end < len(text) else None
        end = space.end() if space else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def slabs_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLAB_CHARS`` characters."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > SLAB_CHARS:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def cut_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32, and (part, rank): the task and the number within it among
    the pieces of this length, from 0. ``ids`` (little-endian 32-bit) if asked for."""
    with open(path, "rb") as f:
        shared = Shared(documents.sparkSession, f.read(), ChunkIds)  # its size is that of the tokenizer file
    end, size = array("I", [END_ID]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = shared.get(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            doc_ids, rows, ids = batch["doc_id"].to_pylist(), [], []

            def add(doc_id: int | None, piece: int, data: bytes, rows=rows, ids=ids) -> None:
                n = len(data) // 4
                rows.append((doc_id, piece, piece * capacity, n, zlib.crc32(data), part, seen[n]))
                seen[n] += 1
                if with_ids:
                    ids.append(data)

            for i, j in slabs_of(texts):
                if j - i == 1 and len(texts[i]) > BLOCK_CHARS:
                    piece, held = 0, b""
                    for block in blocks(texts[i]):
                        held += encoder.encode([block])[0]
                        whole = len(held) // size * size
                        for at in range(0, whole, size):
                            add(doc_ids[i], piece, held[at : at + size])
                            piece += 1
                        held = held[whole:]
                    add(doc_ids[i], piece, held + end)
                    continue
                for doc_id, data in zip(doc_ids[i:j], encoder.encode(texts[i:j])):
                    data += end
                    if len(data) <= size:
                        add(doc_id, 0, data)
                    else:
                        for piece, at in enumerate(range(0, len(data), size)):
                            add(doc_id, piece, data[at : at + size])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.record_batch(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids binary" * with_ids
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, shared)


@dataclass(frozen=True)
class Run:
    """``times`` equal bins of pieces (length, how many), in the order they stand in the bin."""

    times: int
    pieces: tuple[tuple[int, int], ...]


def fill(lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """One bin from ``left`` pieces by length (``lengths``: those there are, ascending): length -> how many."""
    used: dict[int, int] = {}
    room, at = capacity, len(lengths)
    while at := bisect.bisect_right(lengths, room, 0, at):
        length = lengths[at - 1]
        n = min(left[length], room // length)
        used[length] = n
        room -= n * length
        at -= 1
    if room and used:
        smallest = min(used)
        pair = tightest_pair(lengths, left, used, smallest, room + smallest)
        if pair:
            used[smallest] -= 1
            for length in pair:
                used[length] = used.get(length, 0) + 1
            used = {length: n for length, n in used.items() if n}
    return used


def tightest_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], least: int, room: int) -> tuple[int, int] | None:
    """The two unpacked pieces of the largest sum over ``least`` and up to ``room``; of equal sums the one with the largest piece."""
    best, found = least, None
    i, j = 0, bisect.bisect_left(lengths, room) - 1
    free = lambda length: left[length] - used.get(length, 0)
    while i <= j:
        low, high = lengths[i], lengths[j]
        if low + high > room or not free(high):
            j -= 1
        elif not free(low) or i == j and free(low) < 2:
            i += 1
        else:
            if low + high > best:
                best, found = low + high, (high, low)
                if best == room:
                    break
            i += 1
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of equal bins that hold all pieces, given how many there are of each length from 1 to ``capacity``."""
    left = {length: n for length, n in counts.items() if n}
    lengths, runs = sorted(left), []
    while lengths:
        used = fill(lengths, left, capacity)
        times = min(left[length] // n for length, n in used.items())
        runs.append(Run(times, tuple(sorted(used.items(), reverse=True))))
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
                lengths.remove(length)
    return runs


_RANK_BITS = 44


class Places:
    """Where the pieces of each length go: spans of their numbers, sorted by (length, first number)."""

    def __init__(self, runs: list[Run]):
        rows, given, first_bin = [], {}, 0
        for run in runs:
            offset = 0
            for length, n in run.pieces:
                rank = given.get(length, 0)
                rows.append((length << _RANK_BITS | rank, n, first_bin, offset))
                given[length] = rank + run.times * n
                offset += n * length
            first_bin += run.times
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.bins = first_bin

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << _RANK_BITS | rank
        span, each, first_bin, offset = self.table[np.searchsorted(self.table[:, 0], key, "right") - 1].T
        within = key - span
        return first_bin + within // each, offset + within % each * length


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every document row ends with id 0; documents longer than a bin are cut into full pieces and a last one. A null or
    empty text is one piece of length 1. Repeated rows are packed each; null ids stay null; an empty table gives an empty result. Columns
    other than doc_id and text play no part. Which of several pieces of one length goes where is arbitrary.
    """
    prepare_session(documents.sparkSession)
    pieces = store(cut_pieces(documents, path, capacity, with_ids), "pieces")
    counts = store(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "offsets")
    # At most a row for each length a piece can have.
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = Shared(documents.sparkSession, Places(plan(totals, capacity)))
    ranked = join_lookup(pieces, offsets, ["part", "length"], "inner").withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = shared.get().find(batch["length"].to_numpy(), batch["rank"].to_numpy())
        batch = batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return batch.drop_columns(["rank"])

    return map_batches(ranked, run, extended(ranked.drop("rank"), "sequence_id long, offset long"), shared)
