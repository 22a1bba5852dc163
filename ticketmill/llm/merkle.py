"""Merkle manifest of a table of documents: one tree of digests per language, and a tree over their roots.

Where a leaf stands among the leaves of its group is a rank query on a bitmap of the group's ids: bitmaps are kept as their
64-bit words that are not empty, each with the number of ids before it (a popcount directory), so that no leaf is
sorted. Levels are then reduced by key: node ``i`` goes into slot ``i % 8`` of the array of its parent ``i / 8``. Proofs come back down
the same arrays, from the root to the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill.llm.rows import extended, map_arrow, prepare_session, store
from ticketmill.operators.numbering import number_rows
from ticketmill.session import join_lookup

#: Bits of a node's place that say its slot: 8 children a node.
SLOT_BITS = 3
FAN = 1 << SLOT_BITS
#: Bits of an id that say its place in a word of the bitmap.
WORD_BITS = 6
#: The bitmap word of rows without id, before all others.
NO_ID = -(1 << 63)

# The columns a leaf is made of, in their order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(text: Column) -> Column:
    fields = [text if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered() -> Column:
    """Documents whose text is changed before they are verified; rows without id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def running_totals(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that come before in the order of the columns (no two rows equal).

    Ranges of the order are summed up in their own tasks; only one number a task is added up beyond them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(batch[value].to_numpy())
            if len(ends):
                before, total = ends - batch[value].to_numpy(), int(ends[-1])
                yield batch.append_column("_before", pa.array(before)).append_column("_part", pa.array(np.full(len(ends), part, np.int64)))

    placed = store(map_arrow(ranged, run, extended(ranged, "_before long, _part long")), "totals")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(parts), "_part").withColumn(out, F.col("_offset") + F.col("_before")).drop("_part", "_before", "_offset")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, doc_id, row, leaf, ...) with ``i``, the place among the leaves of the group g, and ``m``, their number.

    Leaves of a group ascend by doc_id, null first. Rows of one id are told apart by their digests, then by ``row``: only the words
    of the bitmap that hold such ids are numbered by sorting. ``leaves`` is read more than once and should be stored.
    """
    word = F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NO_ID)).alias("w")
    keyed = leaves.select("*", word)
    bits = F.coalesce(F.expr("bit_or(shiftleft(1L, CAST(doc_id & 63 AS INT)))"), F.lit(0)).alias("bits")
    words = running_totals(keyed.groupBy("g", "w").agg(bits, F.count("*").alias("n")), ["g", "w"], "n", "before")
    words = store(words.withColumn("unique", F.bit_count("bits") == F.col("n")), "words")
    groups = store(words.groupBy("g").agg(F.min("before").alias("start"), F.sum("n").alias("m")), "groups")
    placed = join_lookup(keyed.join(words.withColumn("before", F.col("before").cast("long")), ["g", "w"]), groups, "g", "inner")
    placed = placed.withColumn("base", F.col("before") - F.col("start"))
    rank = F.expr("CAST(bit_count(bits & ~shiftleft(-1L, CAST(doc_id & 63 AS INT))) AS BIGINT)")
    own = [*leaves.columns, "m"]
    found = placed.filter("unique").select(*own, (F.col("base") + rank).alias("i"))
    if not words.filter(~F.col("unique")).isEmpty():
        order = [F.col("g"), F.col("w"), F.col("doc_id"), F.col("leaf"), F.col("row")]
        several = store(number_rows(placed.filter(~F.col("unique")), order, "number"), "several")
        first = several.groupBy("g", "w").agg(F.min("number").alias("first"))
        found = found.unionByName(several.join(first, ["g", "w"]).select(*own, (F.col("base") + F.col("number") - F.col("first")).alias("i")))
    return found


def reduce_levels(nodes: DataFrame, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, from the leaves up, and the root of each group: (g, digest).

    ``nodes``: (g, i, m, digest): place and number of the nodes of a group. A run is (g, i, m, alone, kids, digest): the node that its kids
    become, at place i of m; kids are structs of slot, digest and what is ``carried``, in order. A lone node of a group is its root
    as it is (``alone``); in higher levels it is left out.
    """
    most = nodes.agg(F.max("m")).first()[0] or 0
    levels, roots = [], nodes.filter("false").select("g", "digest")
    above = lambda c: F.shiftright(c, SLOT_BITS)
    while most and (most > 1 or not levels):
        slot = F.struct(F.col("i").bitwiseAND(FAN - 1).cast("int").alias("slot"), "digest", *carried)
        runs = nodes.groupBy("g", above("i").alias("i"), "m").agg(F.sort_array(F.collect_list(slot)).alias("kids"))
        alone = (F.col("m") == 1).alias("alone")
        hashed = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        digest = F.when(F.col("alone"), F.col("kids")[0]["digest"]).otherwise(hashed).alias("digest")
        runs = store(runs.select("*", alone).select("g", "i", above(F.col("m") + FAN - 1).alias("m"), "alone", "kids", digest), "level")
        levels.append(runs)
        roots = roots.unionByName(runs.filter("m = 1").select("g", "digest"))
        nodes, carried, most = runs.filter("m > 1").select("g", "i", "m", "digest"), (), (most + FAN - 1) // FAN
    return levels, roots


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes that the lowest of ``levels`` was made from: g, i, the kid's struct, the columns of ``tops``, and ``path``: left and right
    siblings by level, from the node's own to the root's.

    ``tops``: (g, path, ...) for the root of each group, where the group's tree goes on above.
    """
    others = [c for c in tops.columns if c not in ("g", "path")]
    held = None
    for runs in reversed(levels):
        parents = runs.filter("m = 1").join(tops, "g")
        if held is not None:
            parents = parents.unionByName(runs.filter("m > 1").join(held.select("g", "i", "path", *others), ["g", "i"]))
        digests = F.transform("kids", lambda k: k["digest"])
        rows = parents.select("g", "i", "alone", "path", *others, digests.alias("digests"), F.explode("kids").alias("kid"))
        slot = F.col("kid.slot")
        step = F.struct(
            F.array_join(F.slice("digests", F.lit(1), slot), "").alias("before"),
            F.array_join(F.slice("digests", slot + 2, F.lit(FAN)), "").alias("after"),
        )
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path")
        held = rows.select("g", (F.col("i") * FAN + slot).alias("i"), "kid", path, *others)
    return held


_EMPTY_PATH = "array<struct<before:string,after:string>>"


def manifest(documents: DataFrame) -> DataFrame:
    """A row per document row: doc_id, lang, place (in its language's tree), leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is computed from the leaf of the document as it is shown (tampered with where :func:`is_tampered`) and the siblings of the
    original. Repeated rows are leaves of their own, next to each other; null ids come first in their language, the null language
    first among the languages; a null text is the field ``-``. One leaf is its own root, with an empty proof. An empty table gives an
    empty result. Columns other than the leaf's five play no part.
    """
    prepare_session(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    # The group's key orders as the language does, bytewise, with null first.
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang"))).alias("g")
    shown = F.when(is_tampered(), leaf_digest(lower_ascii(F.col("text")))).alias("shown")
    leaves = store(rows.select(group, "doc_id", F.monotonically_increasing_id().alias("row"), leaf_digest(F.col("text")).alias("leaf"), shown), "leaves")

    nodes = coordinates(leaves).withColumnRenamed("leaf", "digest")
    levels, subroots = reduce_levels(nodes, "doc_id", "shown")
    if not levels:
        empty = "doc_id long, lang string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return documents.sparkSession.createDataFrame([], empty)
    subroots = store(subroots, "subroots")
    numbered = number_rows(subroots, [F.col("g")], "i", start=0)
    n = subroots.count()
    top_nodes = numbered.select(F.lit("").alias("g"), "i", F.lit(n).cast("long").alias("m"), "digest", F.col("g").alias("group"))
    top_levels, root = reduce_levels(top_nodes, "group")
    top = root.select("g", F.col("digest").alias("root"), F.array().cast(_EMPTY_PATH).alias("path"))
    tops = descend(top_levels, top).select(F.col("kid.group").alias("g"), F.col("kid.digest").alias("subroot"), "root", "path")

    found = descend(levels, store(tops, "tops"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    folded = F.aggregate(
        "path", F.coalesce(F.col("kid.shown"), F.col("kid.digest")), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256)
    )
    lang = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("lang")
    proven = found.select(
        F.col("kid.doc_id").alias("doc_id"), lang, F.col("i").alias("place"), F.col("kid.digest").alias("leaf"),
        "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql(levels: int = 9) -> str:
    """The same rows in DuckDB's SQL, with place by sorting; for at most ``8 ** levels`` leaves a language and languages."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if c == 'text' else c) for c in LEAF_COLUMNS)})"

    crc = "SELECT r, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS c FROM bytes, crc_table"
    parts = [
        "WITH RECURSIVE crc_bits(v, k, c) AS (SELECT v, 0, v FROM range(256) x(v) UNION ALL "
        "SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8)",
        "crc_table AS (SELECT list(c ORDER BY v) AS t FROM crc_bits WHERE k = 8)",
        "d AS (SELECT row_number() OVER () AS r, * FROM documents)",
        "bytes AS (SELECT r, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM d WHERE doc_id IS NOT NULL)",
        f"crc AS ({crc})",
        "a AS (SELECT d.*, coalesce(xor(c, 4294967295) % 3 = 0, false) AS hit FROM d LEFT JOIN crc USING (r))",
        "tampered AS (SELECT * REPLACE (CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text) FROM a)",
        f"shown AS (SELECT r, {leaf('text')} AS shown FROM tampered)",
        f"l AS (SELECT r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf('text')} AS digest FROM a)",
        "s0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS m, digest, r, doc_id FROM l)",
    ]

    def level(name: str, k: int) -> str:
        return (
            f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CAST((max(m) + 7) // 8 AS BIGINT) AS m, "
            f"CASE WHEN max(m) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest FROM {name}{k} GROUP BY g, i // 8)"
        )

    parts += [level("s", k) for k in range(levels)]
    parts.append(f"t0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m, digest, g AS own FROM s{levels})")
    parts += [level("t", k) for k in range(levels)]
    # A node's siblings: the others of its run, in order, before and after it.
    for name, key in (("s", "r"), ("t", "own")):
        for k in range(levels):
            source = f"SELECT {key} AS key, g, i AS own_i FROM {name}0"
            parts.append(
                f"{name}p{k} AS (SELECT key, coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i < own_i // {8**k}), '') AS b, "
                f"coalesce(string_agg(digest, '' ORDER BY i) FILTER (WHERE i > own_i // {8**k}), '') AS a, max(m) AS m "
                f"FROM ({source}) JOIN {name}{k} USING (g) WHERE i // 8 = own_i // {8 ** (k + 1)} GROUP BY key)"
            )
    before = [f"sp{k}" for k in range(levels)] + [f"tp{k}" for k in range(levels)]
    joins = " ".join(f"JOIN {p} ON {p}.key = {'s0.r' if p[0] == 's' else 's0.g'}" for p in before)
    fold = "shown"
    columns = []
    for k, p in enumerate(before):
        columns.append(f"{p}.b AS b{k}, {p}.a AS a{k}, {p}.m AS m{k}")
    parts.append(f"j AS (SELECT s0.doc_id, s0.g, s0.digest AS leaf, s{levels}.digest AS subroot, t{levels}.digest AS root, shown, {', '.join(columns)} "
                 f"FROM s0 JOIN shown USING (r) JOIN s{levels} ON s{levels}.g = s0.g JOIN t{levels} ON true {joins})")
    last = "j"
    for k in range(len(before)):
        fold = f"CASE WHEN m{k} = 1 THEN shown ELSE sha256(b{k} || shown || a{k}) END AS shown"
        parts.append(f"f{k} AS (SELECT * REPLACE ({fold}) FROM {last})")
        last = f"f{k}"
    proof = " || ".join(f"b{k} || a{k}" for k in range(len(before)))
    query = f"SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM {last}"
    return ", ".join(parts) + "\n" + query
