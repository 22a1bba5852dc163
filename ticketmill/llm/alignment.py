"""Alignment of two tokenizers' tokens, by windows between spaces.

After both tokenizations of a whole text, places where a token of either side ends and one that begins with a space follows on both sides are
anchors. They cut the text into windows of token ids; what lies in a window is aligned once for each pair of id tuples, and remembered.
Links are then weighed by the corpus: how often each pair of ids is linked, and whether a pair is the most frequent of its second id.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketmill.llm.bpe import byte_alphabet
from ticketmill.llm.rows import Shared, map_arrow, map_batches, prepare_session, store, text_bytes
from ticketmill.llm.shingles import mix

#: Window alignments that a worker remembers before it starts afresh, and the most tokens of a side of such a window.
MEMO_WINDOWS = 200_000
MEMO_TOKENS = 24
#: Characters of texts that are tokenized at once; longer texts go in parts that end where neither side has a token.
SLAB_CHARS = 1 << 19
#: Id pairs whose counts every worker holds (12 bytes each): the most frequent ones. All others are joined.
HELD_PAIRS = 1_500_000
#: Pairs of ids that a task gathers before it adds them up, and sums that it holds before it hands them on.
GATHERED_PAIRS = 2_000_000

# Fixed value: how the byte-level file parts a text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Text on which the rank-based library is known to part as the file's own does; any other text takes the file's own library.
_ODD = re.compile("[^\t\n\r -~¡-ɏ]")
#: Longest stretch without, or of, white space for it: its merging is quadratic in them.
_LONG_RUN = 500
#: Neither side has a token over such a space.
_GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class Aligner(dict):
    """Tokenizes texts on both sides and aligns their tokens; as a dict, the alignments of windows by id tuples.

    A window's alignment is its groups as text, and its links as codes: first id, shifted, and second id.
    """

    def __init__(self, files: tuple[bytes, bytes]):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(files[0])
        self.library = Tokenizer.from_buffer(files[0])
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.ranked = tiktoken.Encoding("first", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in ranks.items():
            self.first[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        ids = range(self.pieces.get_piece_size())
        self.second = [self._piece(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in ids]
        wide = max(len(self.first), len(self.second)) > 1 << 16
        self.code, self.shift = (np.dtype("<u8"), 32) if wide else (np.dtype("<u4"), 16)
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (self.first, self.second))
        # Ids in decimal, with zero bytes before them.
        numbers = [str(i).encode() for i in range(max(len(self.first), len(self.second)))]
        self.width = np.array([len(x) for x in numbers], np.int64)
        self.digits = np.frombuffer(b"".join(x.rjust(len(numbers[-1]), b"\0") for x in numbers), np.uint8).reshape(len(numbers), -1)
        self.spaced = tuple(np.array([x[:1] == b" " for x in side]) for side in (self.first, self.second))
        # Tokens of the second side that hold a space after something else would reach over a gap.
        self.cuttable = not any(b" " in x.lstrip(b" ") for x in self.second)

    @staticmethod
    def _piece(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def align_windows(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The alignments of windows that follow each other: ids of both sides, and where each window begins in them. Both sides of a
        window have the same bytes."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        marked = np.zeros(int(ends_a[-1]) + 1, bool)
        marked[ends_b] = True
        last_a = marked[ends_a]  # tokens that end where one of the other side does: the last ones of their groups
        marked[:] = False
        marked[ends_a] = True
        last_b = marked[ends_b]
        codes = (a[last_a].astype(self.code) << self.code.type(self.shift)) | b[last_b].astype(self.code)
        # The text of the groups: a group's ids of the first side, then those of the second, each with what follows it.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a, before_b = (np.append(0, np.flatnonzero(x) + 1) for x in (last_a, last_b))
        order_a, order_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
        ids, after = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[order_a], ids[order_b] = a, b
        after[order_a[last_a]], after[order_b[last_b]] = ord("|"), ord(";")
        shown = np.concatenate([self.digits[ids], after[:, None]], axis=1)
        text = shown[shown != 0].tobytes()
        starts = np.append(0, np.cumsum(self.width[ids] + 1))[np.append(at_a + at_b, len(ids))].tolist()
        links = np.append(np.append(0, np.cumsum(last_a))[at_a] * self.code.itemsize, len(codes) * self.code.itemsize).tolist()
        packed = codes.tobytes()
        return [(text[i : j - 1], packed[k:m]) for i, j, k, m in zip(starts, starts[1:], links, links[1:])]

    def parts(self, text: str) -> list[str]:
        """The text, in parts that are tokenized by themselves (each with a space before it)."""
        out, at = [], 0
        while self.cuttable and len(text) - at > SLAB_CHARS and (gap := _GAP.search(text, at + SLAB_CHARS)):
            out.append(text[at : gap.start()])
            at = gap.end()
        return [*out, text[at:] if at else text]

    def tokenize(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for a space and each text."""
        first: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if _ODD.search(text) or _has_long_run(text):
                slow.append(i)
            else:
                first[i] = self.ranked.encode_ordinary(" " + text)
        for i, found in zip(slow, self.library.encode_batch_fast([" " + texts[i] for i in slow], add_special_tokens=False)):
            first[i] = found.ids
        return first, self.pieces.encode(texts, num_threads=1)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text: tokens of either side, groups, digest of the groups, and its id pairs with how often each is linked."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            if text:
                for part in self.parts(text):
                    parts.append(part)
                    owner.append(k)
        first, second = self.tokenize(parts) if parts else ([], [])
        whole = [True] * len(texts)
        for k, part, a, b in zip(owner, parts, first, second):
            data = b" " + part.encode()
            if b"".join(map(self.first.__getitem__, a)) != data or b"".join(map(self.second.__getitem__, b)) != data:
                whole[k] = False
        kept = [i for i, k in enumerate(owner) if whole[k]]
        texts_of = np.array([owner[i] for i in kept], np.int64)
        found = self._windows([first[i] for i in kept], [second[i] for i in kept]) if kept else []
        out = []
        begin = 0
        for k in range(len(texts)):
            end = begin
            while end < len(kept) and texts_of[end] == k:
                end += 1
            if end == begin:
                out.append((0, 0, 0, "", np.zeros(0, self.code), np.zeros(0, np.uint32)))
                continue
            windows = [w for i in range(begin, end) for w in found[i]]
            digest = hashlib.sha256(b";".join([w[0] for w in windows])).hexdigest()
            codes = np.frombuffer(b"".join([w[1] for w in windows]), self.code)
            pairs, times = np.unique(codes, return_counts=True)
            n_a, n_b = (sum(len(side[kept[i]]) for i in range(begin, end)) for side in (first, second))
            out.append((n_a, n_b, len(codes), digest, pairs, times.astype("<u4")))
            begin = end
        return out

    def _windows(self, first: list[list[int]], second: list[list[int]]) -> list[list[tuple[bytes, bytes]]]:
        """The alignments of the windows of each text, in order. Both sides of a text have the same bytes."""
        a, b = (np.array(list(chain.from_iterable(side)), np.int64) for side in (first, second))
        sizes_a, sizes_b = self.sizes[0][a], self.sizes[1][b]
        starts_a, starts_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        spaced = np.zeros(int(sizes_a.sum()), bool)
        spaced[starts_a[self.spaced[0][a]]] = True
        at_b = np.flatnonzero(self.spaced[1][b] & spaced[starts_b])  # a text begins with a space, so that its start is an anchor
        at_a = np.searchsorted(starts_a, starts_b[at_b])
        texts = np.searchsorted(at_b, np.cumsum([0, *map(len, second)])).tolist()
        chosen, which = _equal_windows(a, b, at_a, at_b)
        end_a, end_b = np.append(at_a[1:], len(a))[chosen], np.append(at_b[1:], len(b))[chosen]
        at_a, at_b = at_a[chosen], at_b[chosen]
        bytes_a, bytes_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        cuts = zip((4 * at_a).tolist(), (4 * end_a).tolist(), (4 * at_b).tolist(), (4 * end_b).tolist())
        keys = [(bytes_a[i:j], bytes_b[k:m]) for i, j, k, m in cuts]
        different = list(map(self.get, keys))
        new = np.array([k for k, x in enumerate(different) if x is None], np.int64)
        if len(new):
            n_a, n_b = (end_a - at_a)[new], (end_b - at_b)[new]
            begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            own_a = a[np.arange(n_a.sum()) + np.repeat(at_a[new] - begin_a, n_a)]
            own_b = b[np.arange(n_b.sum()) + np.repeat(at_b[new] - begin_b, n_b)]
            if len(self) + len(new) > MEMO_WINDOWS:
                self.clear()
            short = ((n_a <= MEMO_TOKENS) & (n_b <= MEMO_TOKENS)).tolist()
            for k, x, keep in zip(new.tolist(), self.align_windows(own_a, own_b, begin_a, begin_b), short):
                different[k] = x
                if keep:
                    self[keys[k]] = x
        found = [different[k] for k in which.tolist()]
        return [found[i:j] for i, j in zip(texts, texts[1:])]


def _equal_windows(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows, which begin at these places, that differ: one of each kind, and the kind of every window.

    They are told apart by hashes of their ids, and those of one hash are compared id by id."""
    kinds, same = np.zeros(len(at_a), np.uint64), []
    for ids, at in ((a, at_a), (b, at_b)):
        sizes = np.diff(np.append(at, len(ids)))
        place = np.arange(len(ids)) - np.repeat(at, sizes)
        own = np.add.reduceat(mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), at)
        kinds = mix(kinds * np.uint64(0x9E3779B97F4A7C15) + own + sizes.astype(np.uint64))
        same.append((ids, at, sizes))
    _, first_of, which = np.unique(kinds, return_index=True, return_inverse=True)
    chosen = first_of[which]
    for ids, at, sizes in same:
        if (sizes != sizes[chosen]).any() or (ids != ids[np.arange(len(ids)) + np.repeat(at[chosen] - at, sizes)]).any():
            every = np.arange(len(at_a))  # two kinds with one hash: look at each by itself
            return every, every
    return first_of, which


def _has_long_run(text: str) -> bool:
    if len(text) <= _LONG_RUN:
        return False
    blank = np.frombuffer(text.encode("utf-32-le"), np.uint32) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return bool(np.diff(turns, prepend=-1, append=len(blank) - 1).max() > _LONG_RUN)


def _slabs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if total and total + size > SLAB_CHARS:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def align_documents(documents: DataFrame, first: str, second: str) -> DataFrame:
    """rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the text's id pairs with their times, as arrays in binary.

    ``first`` and ``second`` are the paths of a byte-level BPE file and of a piece model. Tokens are not empty, so that a group ends with
    exactly one link.
    """
    files = []
    for path in (first, second):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = Shared(documents.sparkSession, tuple(files), Aligner)  # its size is that of the files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, rid = shared.get(), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, rows = batch["text"].to_pylist(), []
            for i, j in _slabs(texts):
                rows += aligner.align(texts[i:j])
            if not rows:
                continue
            n_a, n_b, n_links, digests, pairs, times = zip(*rows)
            columns = [
                pa.array(np.arange(rid, rid + len(rows))), batch["doc_id"], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_links, pa.int64()),
                pa.array(n_links, pa.int64()), pa.array(digests), pa.array([x.astype("<u8").tobytes() if x.itemsize == 8 else x.tobytes() for x in pairs], pa.binary()),
                pa.array([x.tobytes() for x in times], pa.binary()),
            ]
            yield pa.record_batch(columns, ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            rid += len(rows)

    schema = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, shared)


def pair_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of all id pairs of a batch, and where each row's begin (one more than rows)."""
    times, ends = text_bytes(batch["times"])
    times, offsets = times.view("<u4"), ends // 4
    codes, _ = text_bytes(batch["pairs"])
    return codes.view("<u8" if len(codes) == 8 * len(times) else "<u4").astype(np.int64), times.astype(np.int64), offsets


def _added_up(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(pairs)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(np.concatenate(times)[order], first) if len(every) else np.zeros(0, np.int64)


def count_pairs(aligned: DataFrame, mask: int) -> DataFrame:
    """pair, n (how often it is linked in all texts), best (whether no pair of its second id is linked more often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pairs[0]), 100_000):
                yield pa.record_batch([pa.array(pairs[0][at : at + 100_000]), pa.array(times[0][at : at + 100_000])], ["pair", "n"])

        for batch in batches:
            p, t, _ = pair_arrays(batch)
            pairs.append(p)
            times.append(t)
            size += len(p)
            if size - held >= GATHERED_PAIRS:
                p, t = _added_up(pairs, times)
                pairs, times, size = [p], [t], len(p)
                held = size
                if size >= GATHERED_PAIRS:
                    yield from out()
                    pairs, times, size, held = [], [], 0, 0
        if pairs:
            p, t = _added_up(pairs, times)
            pairs, times = [p], [t]
            yield from out()

    partial = map_arrow(aligned.select("pairs", "times"), run, "pair long, n long")
    counts = store(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.col("pair").bitwiseAND(mask)
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return store(counts.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "weights")


def frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows of ``counts``, those of the largest n, and whether they are all."""
    by_size = {r.k: r.rows for r in counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("rows")).collect()}
    total, least = 0, 65
    for k in sorted(by_size, reverse=True):
        if total + by_size[k] > limit:
            break
        total, least = total + by_size[k], k
    return counts.filter(F.length(F.bin("n")) >= least), total == sum(by_size.values())


class Weights:
    """The held pairs, sorted, with their counts; a negative count marks the best of its second id."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(table[0])
        self.pairs, self.counts = table[0][order], table[1][order]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair is held, and its count."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return self.pairs[at] == pairs, self.counts[at]


def link_weights(documents: DataFrame, first: str, second: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """A row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or not the bytes that either side's tokens give have no tokens: zeros and an empty digest. Repeated rows
    count each, null ids stay null, an empty table gives an empty result. Columns other than doc_id and text play no part.
    """
    spark = documents.sparkSession
    prepare_session(spark)
    aligned = store(align_documents(documents, first, second), "aligned")
    mask = (1 << 32) - 1 if _is_wide(first, second) else (1 << 16) - 1
    counts = count_pairs(aligned, mask)
    chosen, all_held = frequent(counts, held_pairs)
    table = chosen.select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
    weights = Shared(spark, (table["pair"].to_numpy(), table["n"].to_numpy()), Weights)  # at most held_pairs rows
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, times, offsets = pair_arrays(batch)
        there, n = weights.get().find(pairs)
        times = np.where(there, times, 0)
        sums = [np.diff(np.append(0, np.cumsum(v))[offsets]) for v in (np.where(n < 0, times, 0), times * np.abs(n))]
        return pa.record_batch([*(batch[c] for c in ["rid", *own]), *map(pa.array, sums)], ["rid", *own, "n_best", "count_sum"])

    schema = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = map_batches(aligned, weigh, schema, weights)
    if all_held:
        return found.drop("rid")

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, times, offsets = pair_arrays(batch)
        rids = np.repeat(batch["rid"].to_numpy(), np.diff(offsets))
        missing = ~weights.get().find(pairs)[0]
        return pa.record_batch([pa.array(x[missing]) for x in (rids, pairs, times)], ["rid", "pair", "times"])

    rest = map_batches(aligned.select("rid", "pairs", "times"), others, "rid long, pair long, times long", weights).join(counts, "pair")
    more = rest.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    joined = found.join(more, "rid", "left")
    total = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return joined.select(*own, total("n_best", "more_best"), total("count_sum", "more"))


def _is_wide(first: str, second: str) -> bool:
    """Whether ids take more than 16 bits."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    return max(pieces, Tokenizer.from_file(first).get_vocab_size(with_added_tokens=True)) > 1 << 16
