"""Classes of near-duplicate texts from buckets: candidates, verification, components.

The steps are the same for every kind of bucket and of likeness; the operators give both. Buckets propose pairs with their first
text; what these leave apart is compared pair by pair inside its buckets, in cells of bounded size, by bitmaps that bound the distance of two
texts from below: only pairs that may be alike are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.components import components, contract
from ticketmill.llm.rows import map_arrow, map_batches, store
from ticketmill.session import by_key, scratch

#: Texts of a bucket that are compared with each other in one go; larger buckets are dealt out in such blocks.
BLOCK = 1024
#: Bytes of the tables that are made at once.
TABLE_BYTES = 16 << 20


@dataclass(frozen=True)
class Bound:
    """What can be said of two texts without aligning them. ``bits_of``: a bitmap of a text's features, of a power of two of bits that
    grows with the text; ``most_missing``: how many features of either text the other may lack, by the longer's size, if they are alike;
    ``least_ratio``: of their sizes. ``finer``: a second bound, whose bitmaps are wider than these by one factor; it is tried on the pairs that pass."""

    bits_of: Callable[[bytes], np.ndarray]
    most_missing: Callable[[np.ndarray], np.ndarray]
    least_ratio: float = 0.0
    finer: Bound | None = None


def bucket_keys(values: str, n: int) -> Column:
    """Keys of the buckets that a text with ``n`` sketch values is in."""
    return F.array(*[F.xxhash64(F.lit(i), F.get(values, F.lit(i))) for i in range(n)])


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, first) from (node, keys): the buckets that hold several texts, with their first one."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    firsts = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first != last").select("key", "first")
    return rows.join(firsts, "key").select("key", "node", "first")


def verify(pairs: DataFrame, texts: DataFrame, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """(u, v): the pairs (a, b) whose texts (node, body) are alike."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array([alike(x, y) for x, y in zip(batch["xa"].to_pylist(), batch["xb"].to_pylist())], pa.bool_())
        return pa.record_batch([batch["a"].filter(kept), batch["b"].filter(kept)], ["u", "v"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("xb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("body").alias("xa")), "a")
    return map_batches(both.select("a", "b", "xa", "xb"), run, "u long, v long")


def label_of(label: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """``ends`` with the class so far of the node in each of the columns, as ``l`` and the column's name."""
    for c in columns:
        own = label.select(F.col("node").alias(c), F.col("label").alias("_l"))
        ends = ends.join(own, c, "left").withColumn(f"l{c}", F.coalesce("_l", c)).drop("_l")
    return ends


def missing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each bitmap of ``a`` and each of ``b`` (rows): the larger of the counts of bits that one has and the other lacks."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(TABLE_BYTES // max(b.nbytes, 1), 1)
    for i in range(0, len(a), step):
        x = a[i : i + step, None, :]
        common = np.bitwise_count(x & b[None]).sum(axis=2, dtype=np.int64)
        most = np.maximum(np.bitwise_count(a[i : i + step]).sum(axis=1, dtype=np.int64)[:, None], np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None])
        out[i : i + step] = most - common
    return out


def folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of rows of ``width`` words: a bit of a longer one stands at its place modulo the width."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, width), axis=1)


def missing_in_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`missing_bits` of the pairs of the bitmaps ``a[i]`` and ``b[j]`` only."""
    own, other = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    most, step = np.maximum(own[i], other[j]), max(TABLE_BYTES // max(a.itemsize * a.shape[1], 1), 1)
    for k in range(0, len(i), step):
        most[k : k + step] -= np.bitwise_count(a[i[k : k + step]] & b[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return most


def compare_cell(left: list[tuple], right: list[tuple] | None, bound: Bound) -> list[tuple[int, int]]:
    """Pairs of nodes of rows (node, label, size, bits) of different classes that may be alike: of left and right, or within left.

    Rows may have the bitmaps of the finer bound as a fifth field.
    """
    out = []
    sides = [left, left if right is None else right]
    by_width: list[dict[int, list[tuple]]] = [{}, {}]
    for rows, found in zip(sides, by_width):
        for r in rows:
            found.setdefault(len(r[3]), []).append(r)
    tables = [
        {w: (*(np.array([r[c] for r in rows]) for c in range(3)), *(np.stack([np.frombuffer(r[c], "<u8") for r in rows]) for c in range(3, len(rows[0])))) for w, rows in found.items()}
        for found in by_width
    ]
    for w, (node, label, size, bits, *finer) in tables[0].items():
        for v, (other_node, other_label, other_size, other_bits, *other_finer) in tables[1].items():
            longer = np.maximum(size[:, None], other_size[None])
            open_ = (label[:, None] != other_label[None]) & (np.minimum(size[:, None], other_size[None]) >= bound.least_ratio * longer)
            if right is None:
                open_ &= node[:, None] < other_node[None]
            if not open_.any():
                continue
            width = min(w, v) // 8
            open_ &= missing_bits(folded(bits, width), folded(other_bits, width)) <= bound.most_missing(longer)
            i, j = np.nonzero(open_)
            if bound.finer is not None and finer:
                width = min(finer[0].shape[1], other_finer[0].shape[1])
                close = missing_in_pairs(folded(finer[0], width), folded(other_finer[0], width), i, j) <= bound.finer.most_missing(np.maximum(size[i], other_size[j]))
                i, j = i[close], j[close]
            out += list(zip(np.minimum(node[i], other_node[j]).tolist(), np.maximum(node[i], other_node[j]).tolist()))
    return out


def close_pairs(buckets: DataFrame, label: DataFrame, texts: DataFrame, bound: Bound) -> DataFrame:
    """(a, b): pairs of texts of one bucket and of different classes that may be alike.

    Buckets of one class cost nothing. A bucket of m texts is dealt out in blocks of about ``BLOCK`` texts, and every two blocks meet in a
    cell of their own, so that no task holds a whole bucket.
    """
    bounds = [bound] if bound.finer is None else [bound, bound.finer]
    columns = ["bits", "finer"][: len(bounds)]
    labelled = label_of(label, buckets.select("key", "node"), "node")
    mixed = labelled.groupBy("key").agg(F.min("lnode").alias("low"), F.max("lnode").alias("high"), F.count("*").alias("m")).filter("low != high")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = store(labelled.join(mixed.select("key", blocks.alias("blocks")), "key"), "mixed")
    wanted = rows.select("node").distinct()

    def bits(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch["body"].to_pylist()
        tables = [pa.array([b.bits_of(x).tobytes() for x in bodies], pa.binary()) for b in bounds]
        return pa.record_batch([batch["node"], batch["size"], *tables], ["node", "size", *columns])

    schema = ", ".join(["node long, size long", *(f"{c} binary" for c in columns)])
    bitmaps = store(map_batches(texts.join(wanted, "node").select("node", "size", "body"), bits, schema), "bitmaps")
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), "block", "node", F.col("lnode").alias("label"))
    cells = cells.join(bitmaps, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sides = None, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            found = compare_cell(sides[0], sides[1] if current[1] != current[2] else None, bound) if sides[0] else []
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*sorted(set(found)))], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "c1", "c2", "block", "node", "label", "size", *columns))):
                if row[:3] != current:
                    if current:
                        yield from out()
                    current, sides = row[:3], ([], [])
                sides[row[3] != row[1]].append(row[4:])
        if current:
            yield from out()

    placed = cells.withColumn("cell", F.xxhash64("key", "c1", "c2"))
    placed = by_key(placed, "cell").drop("cell").sortWithinPartitions("key", "c1", "c2")
    return map_arrow(placed.select("key", "c1", "c2", "block", "node", "label", "size", *columns), run, "a long, b long").distinct()


def classes(rows: DataFrame, nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], alike: Callable[[bytes, bytes], bool], bound: Bound) -> DataFrame:
    """doc_id, th, class_id (smallest doc_id of its class), class_size and stays (one row of each class).

    ``rows``: (rid, doc_id, th, node), a row per document; rows of one node are copies. ``nodes``: (node, keys) of the texts
    that have buckets. ``texts_of`` gives (node, size, body) for a table of wanted nodes: only texts that share a bucket are fetched. First
    every text meets the text with which it shares most buckets, then all proposals between classes that are still
    apart are verified, and at last all other pairs of a bucket between such classes that may be alike. Copies are deleted but the result.
    """
    with scratch(rows.sparkSession):
        buckets = store(shared_buckets(nodes), "buckets")
        proposals = buckets.filter("first != node").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
        pairs = store(proposals, "proposals")
        texts = store(texts_of(store(buckets.select("node").distinct(), "wanted")), "texts")
        best = pairs.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
        best = store(best, "best")
        label = components(verify(best, texts, alike))

        apart = label_of(label, pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), "a", "b").filter("la != lb").select("a", "b")
        apart = store(apart, "apart")
        label = contract(label, verify(apart, texts, alike))

        close = close_pairs(buckets, label, texts, bound).join(best, ["a", "b"], "left_anti").join(apart, ["a", "b"], "left_anti")
        label = contract(label, verify(store(close, "close"), texts, alike))

        labelled = rows.join(label, "node", "left").select("rid", "doc_id", "th", F.coalesce("label", "node").alias("label"))
        labelled = store(labelled, "labelled")
        # The smallest id first, nulls last; then the row's place.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid"))
        found = labelled.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
        result = labelled.join(found, "label").select(
            "doc_id", "th", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.rid") == F.col("rid")).alias("stays")
        )
        return store(result, "classes", outer=True)
