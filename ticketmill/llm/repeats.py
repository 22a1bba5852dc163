"""Repeated byte strings of a threshold length, by a depth-limited radix sort of suffixes.

Suffixes are compared on their first LENGTH bytes only. The first pass deals them out by their *anchor*: the smallest hashed
gram inside those bytes, which equal strings share. Suffixes whose anchor occurs in no other text, and only once in their
own, are alone and go. The rest are sorted by most-significant-digit passes of eight bytes; a suffix alone after a pass goes, and
groups still equal after the last pass are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import map_arrow, map_batches, prepare_session, slabs, store, text_bytes
from ticketmill.llm.shingles import mix

LENGTH = 200
#: Bytes of an anchor's gram.
GRAM = 32
DIGIT = 8
#: Different stretches of text under one anchor up to which one task sorts them; more are counted window by window.
SPLIT_ABOVE = 1000
#: Bytes that a task sorts at once.
SORT_BYTES = 2 << 20

_PLACE_BITS = np.uint64(23)
_PLACE_MASK = np.uint64((1 << 23) - 1)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; places past the end read zeros."""
    padded = np.append(data, np.zeros(DIGIT - 1, np.uint8)).astype(np.uint64)
    out = padded[: len(data)].copy()
    for k in range(1, DIGIT):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    words = _words(data)
    total = words * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in zip(range(DIGIT, GRAM, DIGIT), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        total[:-k] ^= words[k:] * np.uint64(factor)
        total ^= total >> np.uint64(29)
    return mix(total)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values, from running minima of blocks forwards and backwards."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    blocks = np.append(x, np.full(size - len(x), np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor, over texts that lie end to end: text, first start, windows, hash of the anchor.

    The anchor of a window is its gram of smallest hash, the leftmost among equals: a function of the window's bytes
    alone. Texts shorter than a window have none.
    """
    found = []
    for i, j in slabs(np.diff(offsets)):
        base = offsets[i]
        block = data[base : offsets[j]]
        # A very long text goes in pieces that overlap by a window less one; a run cut in two is two runs.
        for piece in range(0, max(len(block) - LENGTH + 1, 0), 1 << 22):
            part = block[piece : piece + (1 << 22) + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            hashes = _gram_hashes(part)[: len(part) - GRAM + 1]
            keyed = (hashes & ~_PLACE_MASK) | np.arange(len(hashes), dtype=np.uint64)
            anchor = (_sliding_min(keyed, LENGTH - GRAM + 1) & _PLACE_MASK).astype(np.int64)
            starts = np.arange(len(anchor)) + base + piece
            text = np.searchsorted(offsets, starts, "right") - 1
            kept = starts + LENGTH <= offsets[text + 1]
            anchor, starts, text = anchor[kept], starts[kept], text[kept]
            if not len(starts):
                continue
            cut = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
            first = np.flatnonzero(cut)
            found.append((text[first], starts[first] - offsets[text[first]], np.diff(np.append(first, len(starts))), hashes[anchor[first]].view(np.int64)))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(data: np.ndarray, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows (by start in ``data``) equal another of their group. Groups are numbered and lie together.

    Most-significant-digit passes to the depth of LENGTH: a group whose digits are all equal stays as it is, a mixed one is
    sorted and split, and windows left alone are dropped.
    """
    words = _words(data)
    order = np.arange(len(places))
    for depth in range(0, LENGTH, DIGIT):
        if not len(order):
            break
        digit = words[places[order] + depth]
        same = group[1:] == group[:-1]
        mixed = np.unique(group[1:][same & (digit[1:] != digit[:-1])])
        if len(mixed):
            split = np.zeros(int(group[-1]) + 1, bool)
            split[mixed] = True
            index = np.flatnonzero(split[group])
            by = index[np.lexsort([digit[index], group[index]])]
            order[index], digit[index] = order[by], digit[by]
        first = np.append(True, ~same | (digit[1:] != digit[:-1]))
        alone = first & np.append(first[1:], True)
        group = (np.cumsum(first) - 1)[~alone]
        order = order[~alone]
    out = np.zeros(len(places), bool)
    out[order] = True
    return out


def cover(starts: np.ndarray) -> list[int]:
    """Bounds of the union of the windows with these (ascending) starts: start, end, start, end."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH], axis=1).ravel().tolist()


def _sort_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, c, content), sorted by a, then c: the covered bytes of each content, group by group."""
    anchors: list[int] = []
    ids: list[int] = []
    contents: list[bytes] = []
    size = 0

    def sort() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in contents], np.int64)
        windows = lengths - LENGTH + 1
        begin = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(contents)), windows)
        index = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        names = np.array(anchors, np.int64)
        group = np.cumsum(np.append(True, names[1:] != names[:-1])) - 1
        found = repeated_windows(np.frombuffer(b"".join(contents), np.uint8), begin[of] + index, group[of])
        spans = [cover(x) for x in np.split(index[found], np.searchsorted(of[found], np.arange(1, len(contents))))]
        return pa.record_batch([names, pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["a", "c", "spans"])

    for batch in batches:
        for a, c, content in zip(*(batch[x].to_pylist() for x in ("a", "c", "content"))):
            if anchors and a != anchors[-1] and size > SORT_BYTES:
                yield sort()
                anchors.clear(), ids.clear(), contents.clear()
                size = 0
            if anchors and a == anchors[-1] and c == ids[-1]:
                continue
            anchors.append(a)
            ids.append(c)
            contents.append(content)
            size += len(content)
    if anchors:
        yield sort()


_ENTRY = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("a", "<i8"), ("c", "<i8"), ("i", "<i4"), ("n", "<i4")])


def _positions(entries: np.ndarray) -> pa.RecordBatch:
    """Rows (a, c, at): the windows of each content among the entries."""
    entries = entries[np.lexsort([entries["i"], entries["c"], entries["a"]])]
    new = np.append(True, (entries["a"][1:] != entries["a"][:-1]) | (entries["c"][1:] != entries["c"][:-1])) if len(entries) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(entries)).astype(np.int32)), pa.array(np.ascontiguousarray(entries["i"])))
    return pa.record_batch([np.ascontiguousarray(entries["a"][first]), np.ascontiguousarray(entries["c"][first]), at], ["a", "c", "at"])


def _by_digest(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of their digests, and where each digest begins."""
    entries = entries[np.lexsort([entries["w2"], entries["w1"]])]
    return entries, np.flatnonzero(np.append(True, (entries["w1"][1:] != entries["w1"][:-1]) | (entries["w2"][1:] != entries["w2"][:-1])))


def _deal_windows(batch: pa.RecordBatch, buckets: int) -> pa.Table:
    """The windows of a batch of contents, dealt out by their digest: one packed block for each bucket.

    Windows that repeat inside the batch are known to be repeated at once (rows with ``at``); one entry of each digest
    goes on, with how often it was there.
    """
    parts = []
    for a, c, content in zip(*(batch[x].to_pylist() for x in ("a", "c", "content"))):
        n = len(content) - LENGTH + 1
        own = np.zeros(n, _ENTRY)
        digests = np.frombuffer(b"".join(hashlib.blake2b(content[i : i + LENGTH], digest_size=16).digest() for i in range(n)), "<i8")
        own["w1"], own["w2"], own["a"], own["c"], own["i"] = digests[::2], digests[1::2], a, c, np.arange(n)
        parts.append(own)
    entries, first = _by_digest(np.concatenate(parts))
    times = np.diff(np.append(first, len(entries)))
    known = _positions(entries[np.repeat(times > 1, times)])
    sent = entries[first]
    sent["n"] = times
    bucket = (sent["w1"] % buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    blocks = [x.tobytes() for x in np.split(sent, cut[1:])]
    n, k = len(blocks), known.num_rows
    columns = ["bucket", "block", "a", "c", "at"]
    dealt = [pa.array(bucket[cut].astype(np.int32)), pa.array(blocks, pa.binary()), *(pa.nulls(n, known.schema.field(c).type) for c in columns[2:])]
    found = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), *(known[c] for c in columns[2:])]
    return pa.concat_tables([pa.table(dealt, columns), pa.table(found, columns)])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block), sorted by bucket: the windows whose digest has several entries."""
    held: list[np.ndarray] = []
    current = None

    def repeated() -> pa.RecordBatch:
        entries, first = _by_digest(np.concatenate(held))
        several = np.diff(np.append(first, len(entries)))
        return _positions(entries[np.repeat(several > 1, several) & (entries["n"] == 1)])

    for batch in batches:
        for bucket, block in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist()):
            if bucket != current and held:
                yield repeated()
                held.clear()
            current = bucket
            held.append(np.frombuffer(block, _ENTRY))
    if held:
        yield repeated()


def _split_groups(contents: DataFrame) -> DataFrame:
    """The same result as :func:`_sort_contents` for anchors with very many contents: one more pass deals their windows
    out to buckets by digest, so that no anchor is gathered in one task, and each bucket is sorted."""
    buckets = 4 * int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(map_batches(contents, lambda batch: _deal_windows(batch, buckets), "bucket int, block binary, a long, c long, at array<int>"), "dealt")
    blocks = dealt.filter("block IS NOT NULL").select("bucket", "block")
    across = map_arrow(blocks.repartition(buckets // 4, "bucket").sortWithinPartitions("bucket"), _sort_buckets, "a long, c long, at array<int>")
    known = dealt.filter("block IS NULL").select("a", "c", "at")

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        covered = [cover(np.sort(np.array(x, np.int64))) for x in batch["at"].to_pylist()]
        return pa.record_batch([batch["a"], batch["c"], pa.array(covered, pa.list_(pa.int32()))], ["a", "c", "spans"])

    found = known.unionByName(across).groupBy("a", "c").agg(F.flatten(F.collect_list("at")).alias("at"))
    return map_batches(found, spans, "a long, c long, spans array<int>")


def _text_key() -> list:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def _find_runs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Runs of windows of each text: its key, first start, windows, anchor and a digest of all their bytes."""
    data, offsets = text_bytes(batch["text"])
    text, start, n, anchor = anchor_runs(data, offsets)
    if not len(text):
        return None
    raw, at = memoryview(data.tobytes()), (offsets[text] + start).tolist()
    digests = b"".join(hashlib.blake2b(raw[i : i + k + LENGTH - 1], digest_size=8).digest() for i, k in zip(at, n.tolist()))
    h1, h2 = (batch[x].to_numpy()[text] for x in ("h1", "h2"))
    return pa.record_batch([h1, h2, start, n.astype(np.int32), anchor, np.frombuffer(digests, np.int64)], ["h1", "h2", "s", "n", "a", "c"])


def find_repeats(documents: DataFrame) -> DataFrame:
    """(h1, h2, copies, spans): for every distinct text its number of rows, and the byte spans covered by windows
    that also start elsewhere in another text or in itself (start, end, start, end; they may overlap; null: none).

    Equal texts are one text here; with two copies or more, every window of theirs is repeated.
    """
    spark = documents.sparkSession
    prepare_session(spark)
    keyed = documents.select(*_text_key(), F.coalesce("text", F.lit("")).alias("text"))
    runs = store(map_batches(keyed, _find_runs, "h1 long, h2 long, s long, n int, a long, c long"), "runs")

    # The first pass: what does an anchor gather? Nothing else: alone. One content at several places: repeated as it is. Several
    # contents: their windows have to be sorted. Copies of a text are one place.
    place = F.xxhash64("h1", "h2", "s")
    anchors = (
        runs.groupBy("a")
        .agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(place).alias("p1"), F.max(place).alias("p2"))
        .filter("p1 != p2")
        .select("a", (F.col("c1") != F.col("c2")).alias("open"))
    )
    live = store(runs.join(anchors, "a"), "live")

    # One place of each content under an open anchor, and whether the content as a whole is at several.
    row = F.struct("h1", "h2", "s", "n")
    contents = (
        live.filter("open")
        .groupBy("a", "c")
        .agg(F.min(row).alias("r"), (F.min(place) != F.max(place)).alias("whole"))
        .select("a", "c", "whole", "r.h1", "r.h2", "r.s", "r.n")
    )
    contents = store(contents, "contents")
    many = contents.groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") > SPLIT_ABOVE).select("a", F.lit(True).alias("many"))
    # A text's list is bounded by its length.
    wanted = contents.join(many, "a", "left").groupBy("h1", "h2").agg(F.collect_list(F.struct("s", "n", "a", "c", F.coalesce("many", F.lit(False)).alias("many"))).alias("w"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, c, out, flags = [], [], [], []
        for text, rows in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["w"].to_pylist()):
            for r in rows:
                a.append(r["a"])
                c.append(r["c"])
                out.append(text[r["s"] : r["s"] + r["n"] + LENGTH - 1])
                flags.append(r["many"])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(out, pa.binary()), pa.array(flags)], ["a", "c", "content", "many"])

    texts = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    pieces = store(map_batches(texts.join(wanted, ["h1", "h2"]).select("text", "w"), cut, "a long, c long, content binary, many boolean"), "pieces")
    few = pieces.filter("NOT many").select("a", "c", "content")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_few = map_arrow(few.repartition(n, "a").sortWithinPartitions("a", "c"), _sort_contents, "a long, c long, spans array<int>")
    spans = store(sorted_few.unionByName(_split_groups(pieces.filter("many").select("a", "c", "content"))), "spans")

    whole = F.array(F.lit(0), F.col("n") + (LENGTH - 1))
    closed = live.filter("NOT open").select("h1", "h2", "s", whole.alias("spans"))
    opened = (
        live.filter("open")
        .join(contents.select("a", "c", "whole"), ["a", "c"])
        .join(spans, ["a", "c"], "left")
        .select("h1", "h2", "s", F.when(F.col("whole"), whole).otherwise(F.col("spans")).alias("spans"))
        .filter("size(spans) > 0")
    )
    moved = F.transform("spans", lambda x: x + F.col("s"))
    by_text = closed.unionByName(opened).distinct().select("h1", "h2", moved.alias("spans")).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    copies = keyed.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    return copies.join(by_text, ["h1", "h2"], "left")


def remove_repeats(documents: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (and ``kept``, the bytes left, if asked for).

    Removed is every byte covered by a window that also starts anywhere else, judged on the input. A null text counts as
    empty; texts shorter than a window lose nothing; repeated rows are copies of each other. Bytes left need not be valid UTF-8.
    """
    found = store(find_repeats(documents), "found")
    keyed = documents.select(*_text_key(), "text")
    texts = keyed.groupBy("h1", "h2").agg(F.first("text").alias("text"))

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs, digests, left = [], [], [], [], []
        for text, copies, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["copies"].to_pylist(), batch["spans"].to_pylist()):
            text = text or b""
            bounds = [0, len(text)] if copies > 1 and len(text) >= LENGTH else spans or []
            kept, gone, n, end = [], 0, 0, 0
            for a, b in sorted(zip(bounds[::2], bounds[1::2])):
                if a > end or not n:
                    kept.append(text[end:a])
                    n += 1
                    end = a
                if b > end:
                    gone += b - end
                    end = b
            kept.append(text[end:])
            rest = b"".join(kept)
            sizes.append(len(text))
            removed.append(gone)
            runs.append(n)
            digests.append(hashlib.sha256(rest).hexdigest())
            left.append(rest)
        arrays = [batch["h1"], batch["h2"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
        names = ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            arrays, names = [*arrays, pa.array(left, pa.binary())], [*names, "kept"]
        return pa.record_batch(arrays, names)

    schema = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    results = map_batches(texts.join(found, ["h1", "h2"]), remove, schema)
    return documents.select("doc_id", *_text_key()).join(results, ["h1", "h2"]).drop("h1", "h2")
