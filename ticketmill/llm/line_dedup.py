"""Line deduplication by pairwise alignment of overlapping documents.

A line, or a short run of lines with enough words, that several documents share proposes to align each later document with the
first that has it. Pairs are aligned by patience diff on the lines, and common blocks with enough words are deleted from the later
document. Every such block has a short run, and so a proposing key, of its own. Earlier and later go by doc_id.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import extended, fresh, join_by_row, map_batches, prepare_session, store, text_hash
from ticketmill.operators.numbering import number_rows
from ticketmill.session import scratch

#: Words of the smallest block that is deleted.
MIN_WORDS = 10


def _unique_common(a: list, b: list, a_range: tuple[int, int], b_range: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of the elements that stand exactly once in either range, by their place in ``a``."""
    once: dict = {}
    for i in range(*a_range):
        once[a[i]] = -1 if a[i] in once else i
    there: dict = {}
    for j in range(*b_range):
        if once.get(b[j], -1) >= 0:
            there[b[j]] = -1 if b[j] in there else j
    return sorted((once[x], j) for x, j in there.items() if j >= 0)


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both places (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tops, j)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: matched places of two sequences, rising in both.

    Equal ends are matched first, then elements unique on both sides, and the ranges between those in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        anchors = _longest_rising(_unique_common(a, b, (i, i_end), (j, j_end)))
        if not anchors:
            continue
        for x, y in [*anchors, (i_end, j_end)]:
            todo.append((i, x, j, y))
            i, j = x, y  # the next range starts with its anchor
    return sorted(out)


_PRIME, _BASE, _BLANK = (1 << 61) - 1, 1_000_003_000_017, 977


def short_runs(lines: list, words: list, min_words: int) -> list[tuple[int, int]]:
    """Places (start, end) of the shortest runs with ``min_words`` words, one from each line on and one up to each line.

    A line whose words are None is in no run. The runs inside a longer run cover all its lines.
    """
    found, start, total = set(), 0, 0
    for end, n in enumerate(words):
        if n is None:
            start, total = end + 1, 0
            continue
        total += n
        while start <= end and total >= min_words:  # from each line on
            found.add((start, end + 1))
            total, start = total - words[start], start + 1
    end, total = len(words) - 1, 0
    for start in range(len(words) - 1, -1, -1):
        n = words[start]
        if n is None:
            end, total = start - 1, 0
            continue
        total += n
        while end >= start and total >= min_words:  # up to each line
            found.add((start, end + 1))
            total, end = total - words[end], end - 1
    return sorted(found)


def run_keys(lines: list, runs: list[tuple[int, int]]) -> list[int]:
    """64-bit hashes of runs of lines; that of a single line is the line itself."""
    total, powers = [0], [1]
    for x in lines:
        total.append((total[-1] * _BASE + (_BLANK if x is None else hash(x) + 1)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return [lines[i] if j == i + 1 and lines[i] is not None else (total[j] - total[i] * powers[j - i]) % _PRIME for i, j in runs]


def left_over(a: list, b: list, b_words: list[int], gone: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Places (start, end) in ``b`` of further runs of at least ``min_words`` words that ``a`` has, in whatever order and however often.

    An alignment has each line once, and none that cross: a passage that one side repeats, or has elsewhere, is not in it.
    """
    covered = bytearray(len(b))
    for low, high in gone:
        covered[low:high] = b"\1" * (high - low)
    before = [0, *accumulate(covered)]  # covered lines before each
    if before[-1] == len(b):
        return []
    known = dict(zip(b, b_words))
    there = set(run_keys(a, short_runs(a, [known.get(x) for x in a], min_words)))
    if not there:
        return []
    runs = short_runs(b, b_words, min_words)
    out: list[tuple[int, int]] = []
    for (low, high), key in zip(runs, run_keys(b, runs)):
        if key in there and before[high] - before[low] < high - low:
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
            else:
                out.append((low, high))
    return out


def common_blocks(a: list, b: list, b_words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Places (start, end) in ``b`` of runs of lines with at least ``min_words`` words that ``a`` has: the aligned ones, then
    those that the alignment leaves out."""
    blocks, start, last = [], 0, (-2, -2)
    matched = align(a, b)
    for k, pair in enumerate([*matched, (-2, -2)]):
        if k and pair != (last[0] + 1, last[1] + 1):
            low, high = matched[start][1], last[1] + 1
            if sum(b_words[low:high]) >= min_words:
                blocks.append((low, high))
            start = k
        last = pair
    return blocks + left_over(a, b, b_words, blocks, min_words)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def find_common_blocks(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, blocks, earlier): for each document with something to delete, the places of the aligned blocks
    (start, end; they may overlap) and the sorted ids of the earlier documents they are in."""
    prepare_session(documents.sparkSession)
    lines = _lines(F.col("text"))
    # Hashes of trimmed lines; blank ones are null, and have no words. Rows equal in id and text are one document.
    listed = documents.select(
        "doc_id",
        text_hash(),
        F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x)))).alias("lines"),
        F.transform(lines, lambda x: F.when(F.trim(x) != "", F.size(F.split(F.trim(x), r"\s+"))).otherwise(0)).alias("words"),
    )
    texts = store(listed.groupBy("doc_id", "th").agg(F.first("lines").alias("lines"), F.first("words").alias("words")), "lines")
    docs = store(number_rows(texts.select("doc_id", "th"), [F.asc_nulls_last("doc_id"), F.col("th")], "n"), "numbers")
    texts = store(texts.join(docs.withColumnsRenamed({"doc_id": "_id", "th": "_th"}), texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["th"] == F.col("_th"))).drop("_id", "_th"), "documents")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for own, words in zip(batch["lines"].to_pylist(), batch["words"].to_pylist()):
            found.append(list({x for x in own if x is not None}.union(run_keys(own, short_runs(own, words, min_words)))))
        return pa.record_batch([batch["n"], pa.array(found, pa.list_(pa.int64()))], ["n", "keys"])

    rows = store(map_batches(texts.select("n", "lines", "words"), keys, "n long, keys array<long>"), "keys").select("n", F.explode("keys").alias("line"))
    firsts = rows.groupBy("line").agg(F.min("n").alias("first"), F.max("n").alias("last")).filter("first != last").select("line", "first")
    pairs = store(rows.join(firsts, "line").filter("first != n").select("first", "n").distinct(), "pairs")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, first, out = [], [], []
        for k, (a, b, words) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["words"].to_pylist())):
            blocks = common_blocks(a, b, words, min_words)
            if blocks:
                n.append(batch["n"][k].as_py())
                first.append(batch["first"][k].as_py())
                out.append([x for block in blocks for x in block])
        return pa.record_batch([pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["n", "first", "blocks"])

    with_b = pairs.join(texts.select("n", F.col("lines").alias("b"), "words"), "n")
    both = with_b.join(texts.select(F.col("n").alias("first"), F.col("lines").alias("a")), "first")
    found = store(map_batches(both.select("n", "first", "a", "b", "words"), run, "n long, first long, blocks array<int>"), "blocks")
    named = found.join(docs.select(F.col("n").alias("first"), F.col("doc_id").alias("earlier")), "first")
    by_doc = named.groupBy("n").agg(F.flatten(F.collect_list("blocks")).alias("blocks"), F.array_sort(F.collect_set("earlier")).alias("earlier"))
    return docs.join(by_doc, "n").select("doc_id", "th", "blocks", "earlier")


def drop_common_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row with its ``text`` less the deleted lines, and n_lines, n_removed (lines), earlier (ids, or an empty list).

    Judged on the input: an earlier document counts with all its lines, deleted ones too. Blank lines inside a block go with
    it. A null text has no lines and stays null; a text without line breaks is one line; repeated rows lose the same lines;
    null ids come last. Columns of the three names are replaced.
    """
    kept = documents.drop("n_lines", "n_removed", "earlier")
    spans = fresh(kept, "blocks")
    with scratch(documents.sparkSession):
        found = store(find_common_blocks(documents, min_words), "removed", outer=True).withColumnRenamed("blocks", spans)
    joined = join_by_row(kept, found, "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_removed = [], [], []
        for text, blocks in zip(batch["text"].to_pylist(), batch[spans].to_pylist()):
            lines = text.split("\n") if text else []
            gone = {i for a, b in zip(blocks[::2], blocks[1::2]) for i in range(a, b)} if blocks and lines else set()
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            n_lines.append(len(lines))
            n_removed.append(len(gone))
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        batch = batch.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))
        return batch.drop_columns([spans])

    ordered = joined.select(*kept.columns, F.coalesce("earlier", F.array().cast("array<long>")).alias("earlier"), spans)
    return map_batches(ordered, run, extended(ordered.drop(spans), "n_lines long, n_removed long"))
