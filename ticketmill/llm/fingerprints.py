"""MinHash fingerprints: the minima of many universal hash functions over a text's word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ticketmill.llm.grouping import Bound, bucket_keys, classes
from ticketmill.llm.rows import map_arrow, map_batches, prepare_session, slabs, store, text_hash
from ticketmill.llm.shingles import mix, random_words, shingle_hashes, word_hashes

PERMUTATIONS = 128
#: Texts are hashed in slabs whose shingles stay in a core's cache.
CACHE_BYTES = 1 << 20

# h(x) = a x + b modulo 2^32 with odd a: universal, and one-to-one on 32-bit shingles.
_A = (random_words(21, PERMUTATIONS) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_B = (random_words(22, PERMUTATIONS) >> np.uint64(31)).astype(np.uint32)


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of 16-bit values per text: the low halves of the minima. A text without words has 0xFFFF throughout."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    for i, j in slabs(np.array([len(t) for t in texts], np.int64), CACHE_BYTES):
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        words, by_text = word_hashes(data, np.append(0, np.cumsum([len(t) for t in texts[i:j]])))
        shingles, offsets = shingle_hashes(words, by_text)
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            continue
        x, begins = (shingles >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
        value = np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=value)
            value += _B[k]
            out[i + full, k] = np.minimum.reduceat(value, begins) & np.uint32(0xFFFF)
    return out


def as_text(rows: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings, four digits a value."""
    return [r.astype(">u2").tobytes().hex() for r in rows]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal values, row by row: the estimate of the shingle sets' Jaccard similarity."""
    return (left == right).mean(axis=1)


#: Bands of neighbouring signature values; texts that agree in a whole band are candidates. A pair of Jaccard similarity 0.8
#: agrees in none of 32 bands of 4 with a probability of 5e-8.
BANDS, ROWS = 32, 4


def _read_bands(documents: DataFrame) -> DataFrame:
    """A row per document row: rid, doc_id, th, digest of the words, hashes of the signature's bands, number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = [t.encode() for t in batch["text"].to_pylist()]
            rows = signatures(raw).reshape(len(raw), BANDS, ROWS).astype(np.uint64)
            bands = mix(rows[:, :, 0] << np.uint64(48) | rows[:, :, 1] << np.uint64(32) | rows[:, :, 2] << np.uint64(16) | rows[:, :, 3]).view(np.int64)
            digests, sizes = [], []
            for t in raw:
                words, _ = word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
                sizes.append(len(words))
                digests.append(hashlib.blake2b(b"w" + words.tobytes() if len(words) else t, digest_size=16).digest())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.record_batch(
                [np.arange(rid, rid + len(raw)), batch["doc_id"], batch["th"], pa.array(digests, pa.binary()), lists, pa.array(sizes, pa.int64())],
                ["rid", "doc_id", "th", "digest", "bands", "n_words"],
            )
            rid += len(raw)

    schema = "rid long, doc_id long, th long, digest binary, bands array<long>, n_words long"
    return map_arrow(documents.select("doc_id", text_hash(), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def jaccard(x: bytes, y: bytes) -> float:
    """Of two sets of 64-bit shingle hashes, each sorted and without repeats."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def shingle_bits(body: bytes) -> np.ndarray:
    """A bitmap of a set of shingles, of four to eight bits a shingle."""
    values = np.frombuffer(body, "<u8")
    width = 1 << max((len(values) * 4 - 1).bit_length(), 6)
    out = np.zeros(width // 64, np.uint64)
    place = values & np.uint64(width - 1)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def jaccard_bound(similarity: float) -> Bound:
    """Sets of Jaccard similarity s lack at most (1 - s) / s of the smaller one's size, and their sizes are in a ratio of s or more."""
    return Bound(shingle_bits, lambda longer: ((1 - similarity) / similarity * longer + 1e-9).astype(np.int64), similarity)


def near_duplicates(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row per document row: doc_id, th, class_id (smallest doc_id of its class), class_size and stays (one row of each class).

    Signature bands are joined for candidates, whose sets of word shingles are then compared exactly; classes are the connected
    components of pairs with at least the given Jaccard similarity, and of texts with the same words. A null text counts as
    empty; texts without words are alike only if equal. Null ids sort last. An empty table gives an empty result.
    """
    prepare_session(documents.sparkSession)
    read = store(_read_bands(documents), "bands")
    copies = read.groupBy("digest").agg(F.min("rid").alias("node"))
    rows = store(read.select("rid", "doc_id", "th", "digest").join(copies, "digest").drop("digest"), "nodes")
    first = read.filter("n_words > 0").join(copies.select(F.col("node").alias("rid")), "rid")
    nodes = first.select(F.col("rid").alias("node"), bucket_keys("bands", BANDS).alias("keys"))

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for text in batch["text"].to_pylist():
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, offsets = word_hashes(data, np.array([0, len(data)]))
            sets.append(np.unique(shingle_hashes(words, offsets)[0]).astype("<u8").tobytes())
        return pa.record_batch([batch["node"], pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "size", "body"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        names = wanted.join(rows.select("rid", "doc_id", "th").withColumnRenamed("rid", "node"), "node")
        named = documents.select("doc_id", "text", text_hash())
        # Rows equal in id and text are one node; its set is fetched once.
        found = named.join(names.withColumnsRenamed({"doc_id": "w_id", "th": "w_th"}), named["doc_id"].eqNullSafe(F.col("w_id")) & (named["th"] == F.col("w_th")))
        return map_batches(found.select("node", "text"), shingled, "node long, size long, body binary").dropDuplicates(["node"])

    return classes(rows, nodes, texts_of, lambda x, y: jaccard(x, y) >= similarity, jaccard_bound(similarity))


def _neighbours(documents: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, k, text): range buckets by descending doc_id, each with its successor's first row as guest.

    Texts move once. Only ids are read to place the bounds; there is a bound per shuffle partition.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A null doc_id sorts after all others.
    keyed = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.unique(np.array(keyed.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [], float))

    def place(k: pd.Series) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, k.to_numpy().astype(float), "left")

    bucket_of = F.pandas_udf(lambda k: pd.Series(place(k), dtype="int32"), IntegerType())
    heads = {r.bucket: r.k for r in keyed.select(bucket_of("k").alias("bucket"), "k").groupBy("bucket").agg(F.max("k").alias("k")).collect()}  # one row per bucket
    order = sorted(heads)
    # The first id of a bucket also goes to the bucket before; the very first goes to the last.
    goes_to = {heads[b]: order[i - 1] for i, b in enumerate(order)}

    guest_of = F.pandas_udf(lambda k: pd.Series([goes_to.get(x, -1) for x in k.tolist()], dtype="int32"), IntegerType())
    copies = F.array(F.struct(bucket_of("k").alias("bucket"), F.lit(0).alias("guest")), F.struct(guest_of("k").alias("bucket"), F.lit(1).alias("guest")))
    return (
        keyed.withColumn("c", F.explode(F.filter(copies, lambda c: c["bucket"] >= 0)))
        .select("c.bucket", "c.guest", "doc_id", "k", "text")
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("guest", F.desc("k"), "text")
    )


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprint every text, and its edited text: the last half (rounded down) of its code points replaced by the first as
    many (or all) of the next document, by descending doc_id; after the last comes the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as
    empty. Rows of equal doc_id follow each other by text, null ids come last; a single row is its own next. Equal texts have equal
    fingerprints, and texts without words equal each other. An empty table gives an empty result.
    """
    prepare_session(documents.sparkSession)

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all but the last, which is only the next of the one before."""
        raw = [t.encode() for t in texts]
        edited = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for t, after in zip(texts, texts[1:])]
        plain, changed = signatures(raw), signatures(edited)
        return pa.record_batch(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(as_text(plain[:-1])),
                pa.array(as_text(changed)),
                likeness(plain[:-1], changed),
                likeness(plain[:-1], plain[1:]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []  # the last own row, which waits for its next
        for batch in batches:
            guests = batch["guest"].to_pylist()
            own = guests.index(1) if 1 in guests else len(guests)
            ids += batch["doc_id"].to_pylist()[: own + 1]
            texts += batch["text"].to_pylist()[: own + 1]
            if len(ids) > 1:
                yield rows(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
            if own < len(guests):
                break
        for _ in batches:  # further guests, if the first id of the next bucket repeats
            pass

    kept = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(_neighbours(documents).select("guest", "doc_id", "text"), run, kept)
