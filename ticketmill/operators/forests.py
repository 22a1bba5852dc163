"""Random forests over sparse vectors of counts, grown level by level for tables whose dense bins would not fit.

The trees are those of MLlib's algorithm: rows drawn with replacement for each tree, a random subset of the features for each node, the
split of the largest gain among all of their bins, leaves that give the same prediction put together. Only non-zero counts are binned
and kept, in rows that stay where they are. Each level is one job: tasks walk all trees with blocks of their rows and count classes by node,
feature and bin where a bin is not that of zero, whose counts follow from the node's own; counts meet by node, and what comes back to the driver is one
split a node. Everything random is a hash of seed, row, tree or node: batches, tasks and retries play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.functions.tries import _spread
from ticketmill.session import remove, shared_path, ship_package, stored

#: MLlib holds a row as four bytes a feature; up to so many bytes in all it fits the forest.
DENSE_BYTES = 1 << 27
#: Rows that walk the trees together, and pairs of row and tree whose bins are looked up together.
BLOCK_ROWS, BLOCK_PAIRS = 512, 4096
#: Counts that a task puts together before it hands them on, and cells that are weighed together.
PENDING, CELLS = 1 << 22, 1 << 22
#: Bits of a drawn row's weight in a packed count.
WEIGHT_BITS = 4
#: Bits of twice a value beside its feature.
VALUE_BITS = 40
#: A probability of fewer events than so is not told from zero; the largest weight of a row.
MOST = 15


def poisson_steps() -> np.ndarray:
    """Upper ends, in 64 bits, of the hashes that give 0, 1, 2, ... draws with mean one."""
    share, total, out = np.exp(-1.0), 0.0, []
    for k in range(MOST):
        total += share
        share /= k + 1
        out.append(min(int(total * 2.0**64), 2**64 - 1))
    return np.array(out, np.uint64)


def draws(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row (by number) is drawn for each tree."""
    key = _spread(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 64) - 1))
    tree = _spread(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.searchsorted(poisson_steps(), _spread(key[:, None] + tree[None, :]), side="right").astype(np.uint8)


def subsets(nodes: int, features: int, wanted: int, rng: np.random.Generator) -> np.ndarray:
    """For each of ``nodes`` nodes ``wanted`` different features, in any order alike."""
    kind = np.uint16 if features <= 1 << 16 else np.uint32
    if wanted * wanted > 4 * features:
        out = [rng.permutation(features)[:wanted] for _ in range(nodes)]
        return np.array(out, kind).reshape(nodes, wanted)
    out, again = np.zeros((nodes, wanted), kind), np.arange(nodes)
    while len(again):
        out[again] = rng.integers(0, features, (len(again), wanted))
        ordered = np.sort(out[again], axis=1)
        again = again[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)]
    return out


def subset_size(strategy: str, features: int, trees: int) -> int:
    """Features tried at a node, by MLlib's names and numbers."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": features, "sqrt": int(np.ceil(np.sqrt(features))), "log2": max(1, int(np.ceil(np.log2(features)))), "onethird": int(np.ceil(features / 3))}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), features)
    return int(np.ceil(float(strategy) * features))


def impurity_of(counts: np.ndarray, kind: str) -> np.ndarray:
    """Gini or entropy (base two) along the last axis."""
    share = counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    if kind == "gini":
        return 1 - (share * share).sum(axis=-1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=-1)


def thresholds(values: np.ndarray, counts: np.ndarray, rows: int, max_bins: int) -> np.ndarray:
    """Ends of the bins of one feature: between all neighbouring values, or at steps of equal counts if there are too many.

    ``values``: non-zero, ascending; the other ``rows`` are zero.
    """
    if rows > counts.sum():
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, rows - counts.sum())
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= max_bins - 1:
        return middle
    step, out, total = rows / max_bins, [], counts[0]
    target = step
    for k in range(1, len(values)):
        before, total = total, total + counts[k]
        if abs(before - target) < abs(total - target):
            out.append(middle[k - 1])
            target += step
    return np.array(out)


class Walk:
    """Trees of flat arrays: ``left`` is the first of two neighbouring children, or the node itself if it has none (its bin is then 255)."""

    def __init__(self, feature: np.ndarray, bin: np.ndarray, left: np.ndarray, closed: np.ndarray):
        self.feature, self.bin, self.left, self.closed = feature, bin, left, closed

    def down(self, bins: np.ndarray, base: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs of row (by where its bins begin) and node come to an open node in ``depth`` steps, and to which."""
        kept = np.arange(len(node))
        for step in range(1, depth + 1):
            node = self.left.take(node) + (bins.take(base + self.feature.take(node)) > self.bin.take(node))
            if step % 3 == 0 or step == depth:
                going = np.flatnonzero(~self.closed.take(node))
                kept, base, node = kept[going], base[going], node[going]
        return kept, node


def level_counts(rows: DataFrame, shared, reducers: int) -> DataFrame:
    """``part, keys, weights``: counts of one level, as runs of sorted keys (open node, place of the feature, bin, class). All of a node are in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        walk, open_of, subset, depth = Walk(*level["walk"]), level["open_of"], level["subset"], level["depth"]
        features, trees, classes, seed = level["features"], level["trees"], level["classes"], level["seed"]
        nodes, wanted = subset.shape
        ends = -(-np.arange(1, reducers) * nodes // reducers) * ((wanted + 1) * 256 * classes)
        waiting, n = [], 0

        def emitted() -> pa.RecordBatch:
            keys, weights = put_together(np.concatenate(waiting))
            cuts = [0, *np.searchsorted(keys, ends).tolist(), len(keys)]
            parts = [p for p in range(reducers) if cuts[p] < cuts[p + 1]]
            runs = [[x[cuts[p] : cuts[p + 1]].tobytes() for p in parts] for x in (keys, weights)]
            return pa.record_batch([pa.array(parts, pa.int32()), *[pa.array(x, pa.binary()) for x in runs]], ["part", "keys", "weights"])

        for batch in batches:
            for begin in range(0, len(batch), BLOCK_ROWS):
                some = batch.slice(begin, BLOCK_ROWS)
                label = some["label"].to_numpy()
                weight = draws(some["row"].to_numpy(), trees, seed)
                bins = np.zeros(len(some) * features, np.uint8)
                packed = some["entries"].flatten().to_numpy()
                lengths = np.diff(some["entries"].offsets.to_numpy())
                bins[np.repeat(np.arange(len(some)) * features, lengths) + (packed >> 8)] = packed & 255
                row, tree = np.nonzero(weight)
                kept, node = walk.down(bins, row * features, tree, depth)  # the first nodes are the roots
                slot, row, tree = open_of.take(node), row[kept], tree[kept]
                for own in np.split(np.flatnonzero(slot >= 0), range(BLOCK_PAIRS, len(slot), BLOCK_PAIRS)):
                    s, r = slot[own], row[own]
                    times, c = weight[r, tree[own]].astype(np.int64), label[r]
                    found = bins.take((r * features)[:, None] + subset.take(s, axis=0)).ravel()
                    flat = np.flatnonzero(found)
                    pair, place = np.divmod(flat, wanted)
                    field = s * (wanted + 1)
                    key = ((field[pair] + place) * 256 + found[flat]) * classes + c[pair]
                    whole = (field + wanted) * 256 * classes + c  # the node's own counts, after those of its features
                    waiting += [key << WEIGHT_BITS | times[pair], whole << WEIGHT_BITS | times]
                    n += len(key) + len(whole)
                if n > PENDING:
                    yield emitted()
                    waiting, n = [], 0
        if n:
            yield emitted()

    return rows.mapInArrow(run, "part int, keys binary, weights binary")


def put_together(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of packed counts, and the sums of their weights."""
    packed = np.sort(packed)
    keys = packed >> WEIGHT_BITS
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(packed & (1 << WEIGHT_BITS) - 1, first)


def best_splits(keys: np.ndarray, weights: np.ndarray, classes: int, wanted: int, kind: str, least: int) -> dict[str, np.ndarray]:
    """For each node of the sorted ``keys``: place of the feature, bin, gain, counts of the node and of its right side; a gain of -1 if no
    split leaves ``least`` rows on both sides."""
    cell, c = np.divmod(keys, classes)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    counts = np.zeros((len(first), classes))
    counts[np.cumsum(np.append(False, cell[1:] != cell[:-1])), c] = weights
    field, bin = np.divmod(cell[first], 256)
    slot, place = np.divmod(field, wanted + 1)
    last = np.flatnonzero(place == wanted)  # a node's own counts come last
    whole, own = counts[last], np.repeat(np.arange(len(last)), np.diff(np.append(-1, last)))
    # Counts from a bin on, within node and feature; the split before it leaves them on the right.
    ends = np.flatnonzero(np.append(field[1:] != field[:-1], True))
    back = np.cumsum(counts[::-1], axis=0)[::-1]
    after = np.vstack([back, np.zeros((1, classes))])[ends + 1]
    group = np.cumsum(np.append(False, field[1:] != field[:-1]))
    right = back - after[group]
    left = whole[own] - right
    n_left, n_right, n = left.sum(axis=1), right.sum(axis=1), whole.sum(axis=1)
    gain = impurity_of(whole, kind)[own] - n_left / n[own] * impurity_of(left, kind) - n_right / n[own] * impurity_of(right, kind)
    starts = np.append(True, field[1:] != field[:-1])
    before = np.where(starts, 0, np.append(0, bin[:-1]))  # of equal splits the first: right after the bin before
    gain = np.where((n_left >= least) & (n_right >= least) & (place < wanted) & (bin > 0), gain, -1.0)
    begins = np.append(0, last[:-1] + 1)
    top = np.maximum.reduceat(gain, begins)
    hits = np.flatnonzero(gain == top[own])
    chosen = hits[np.searchsorted(own[hits], np.arange(len(last)))]
    return {"slot": slot[last], "place": np.minimum(place[chosen], wanted - 1), "bin": before[chosen], "gain": top, "whole": whole, "right": right[chosen]}


def level_splits(counts: DataFrame, reducers: int, classes: int, wanted: int, kind: str, least: int) -> pa.Table:
    """The best split of each open node. Nodes are weighed some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = [], []
        for batch in batches:
            keys += [np.frombuffer(b, np.int64) for b in batch["keys"].to_pylist()]
            weights += [np.frombuffer(b, np.int64) for b in batch["weights"].to_pylist()]
        if not keys:
            return
        key, weight = np.concatenate(keys), np.concatenate(weights)
        keys, weights = [], []
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, weight = key[first], np.add.reduceat(weight, first)
        node = key // ((wanted + 1) * 256 * classes)
        ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(key))
        begin = 0
        while begin < len(key):
            most = np.searchsorted(ends, begin + max(CELLS // classes, 1), side="right") - 1
            end = ends[max(most, np.searchsorted(ends, begin, side="right"))]
            found = best_splits(key[begin:end], weight[begin:end], classes, wanted, kind, least)
            table = [pa.array(found[c]) for c in ("slot", "place", "bin", "gain")]
            table += [pa.array([x.tobytes() for x in found[c]], pa.binary()) for c in ("whole", "right")]
            yield pa.record_batch(table, ["slot", "place", "bin", "gain", "whole", "right"])
            begin = end

    dealt = counts.repartitionById(reducers, "part")
    return dealt.mapInArrow(run, "slot long, place long, bin long, gain double, whole binary, right binary").toArrow()


def feature_bins(vectors: DataFrame, features: int, rows: int, max_bins: int) -> list[np.ndarray]:
    """The thresholds of each feature, from the counts of all its values: no row is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def put() -> tuple[np.ndarray, np.ndarray]:
            key, times = (np.concatenate(x) for x in zip(*waiting))
            known, place = np.unique(key, return_inverse=True)
            return known, np.bincount(place, times, len(known)).astype(np.int64)

        for batch in batches:
            key = batch["indices"].flatten().to_numpy().astype(np.int64) << VALUE_BITS | batch["values"].flatten().to_numpy().astype(np.int64)
            waiting.append(np.unique(key, return_counts=True))
            n += len(waiting[-1][0])
            if n > PENDING:
                waiting, n = [put()], 0
        yield pa.record_batch([pa.array(x) for x in put()], ["key", "n"])

    found = parts_of(vectors).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    key, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    value = (key & (1 << VALUE_BITS) - 1).astype(float)
    cuts = np.searchsorted(key >> VALUE_BITS, np.arange(features + 1))
    return [thresholds(value[a:b], n[a:b], rows, max_bins) for a, b in zip(cuts[:-1], cuts[1:])]


def parts_of(vectors: DataFrame) -> DataFrame:
    plain = F.unwrap_udt("features")
    return vectors.select("row", F.col("label").cast("long").alias("label"), plain["indices"].alias("indices"), plain["values"].alias("values"))


def binned(vectors: DataFrame, ends: list[np.ndarray]) -> DataFrame:
    """``row, label, entries``: the bins other than that of zero, each with its feature in one number; stored."""
    # Twice a threshold between whole numbers is whole.
    keys = np.concatenate([(f << VALUE_BITS) + (2 * e).astype(np.int64) for f, e in enumerate(ends)])
    starts = np.append(0, np.cumsum([len(e) for e in ends]))
    shared = vectors.sparkSession.sparkContext.broadcast((keys, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts = shared.value
        for batch in batches:
            feature, value = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("indices", "values"))
            bin = np.searchsorted(keys, (feature << VALUE_BITS) + 2 * value) - starts[feature]
            kept = bin > 0
            lengths = np.diff(np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(np.diff(batch["indices"].offsets.to_numpy())))])
            packed = (feature << 8 | bin)[kept].astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(packed))
            yield pa.record_batch([batch["row"], batch["label"], entries], ["row", "label", "entries"])

    return stored(parts_of(vectors).mapInArrow(run, "row long, label long, entries array<int>"), "binned")


def grow(vectors: DataFrame, classifier: RandomForestClassifier, features: int, classes: int, rows: int) -> RandomForestClassificationModel:
    """Fit ``classifier`` on ``row, features, label``: sparse vectors of counts, with a number of its own for each of the ``rows`` rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    of = classifier.getOrDefault
    trees, kind, least = of("numTrees"), of("impurity"), of("minInstancesPerNode")
    wanted = subset_size(of("featureSubsetStrategy"), features, trees)
    width = 2 if features <= 1 << 16 else 4
    at_once = max((of("maxMemoryInMB") << 20) // (wanted * width), 1)
    reducers = max(2 * spark.sparkContext.defaultParallelism, rows * trees // PENDING)
    ends = feature_bins(vectors, features, rows, of("maxBins"))
    table = binned(vectors, ends)

    feature, bin, left = np.zeros(trees, np.int64), np.full(trees, 255, np.uint8), np.arange(trees)
    gain, counts, tree = np.full(trees, -1.0), np.zeros((trees, classes)), np.arange(trees)
    open_nodes, levels = np.arange(trees), [0]
    for depth in range(of("maxDepth") + 1):
        ready = []
        for begin in range(0, len(open_nodes), at_once):
            some = open_nodes[begin : begin + at_once]
            open_of = np.full(len(left), -1, np.int64)
            open_of[some] = np.arange(len(some))
            rng = np.random.default_rng([of("seed") & (1 << 64) - 1, depth, begin])
            subset = subsets(len(some), features, wanted, rng)
            level = {"walk": (feature, bin, left, (left == np.arange(len(left))) & (open_of < 0)), "open_of": open_of, "subset": subset, "depth": depth}
            level |= {"features": features, "trees": trees, "classes": classes, "seed": of("seed")}
            shared = spark.sparkContext.broadcast(level)
            found = level_splits(level_counts(table, shared, reducers), reducers, classes, wanted, kind, least)
            shared.destroy()
            slot, place = found["slot"].to_numpy(), found["place"].to_numpy()
            whole, right = (np.frombuffer(b"".join(found[c].to_pylist())).reshape(-1, classes) for c in ("whole", "right"))
            counts[some[slot]] = whole
            better = (found["gain"].to_numpy() > 0) & (found["gain"].to_numpy() >= of("minInfoGain")) & (depth < of("maxDepth"))
            ready.append((some[slot], subset[slot, place], found["bin"].to_numpy(), found["gain"].to_numpy(), whole - right, right, better))
        node, f, b, g, on_left, on_right, better = (np.concatenate(x) for x in zip(*ready))
        order = np.flatnonzero(better)[np.argsort(node[better])]
        node, n = node[order], len(left)
        levels.append(n)
        feature[node], bin[node], gain[node] = f[order], b[order], g[order]
        left[node] = n + 2 * np.arange(len(node))
        children = np.stack([on_left[order], on_right[order]], axis=1).reshape(-1, classes)
        new = len(children)
        feature, bin, left = np.append(feature, np.zeros(new, np.int64)), np.append(bin, np.full(new, 255, np.uint8)), np.append(left, n + np.arange(new))
        gain, counts, tree = np.append(gain, np.full(new, -1.0)), np.vstack([counts, children]), np.append(tree, np.repeat(tree[node], 2))
        # Nodes at the last level, of one class, or too small to be parted are leaves.
        mixed = (impurity_of(children, kind) > 1e-12) & (children.sum(axis=1) >= 2 * least)
        open_nodes = n + np.flatnonzero(mixed)
        if not len(open_nodes) or depth + 1 >= of("maxDepth"):
            break
    return as_model(spark, classifier, features, kind, ends, levels, feature, bin, left, gain, counts, tree)


def as_model(spark: SparkSession, classifier, features: int, kind: str, ends, levels, feature, bin, left, gain, counts, tree) -> RandomForestClassificationModel:
    """The trees as MLlib's model, by way of its saved form. Leaves of one parent that give the same prediction are put together first."""
    inner, prediction = left != np.arange(len(left)), counts.argmax(axis=1)
    for a, b in list(zip(levels, [*levels[1:], len(left)]))[::-1]:
        node = a + np.flatnonzero(inner[a:b])
        one, two = left[node], left[node] + 1
        inner[node] = inner[one] | inner[two] | (prediction[one] != prediction[two])
    kept = np.arange(len(left)) <= tree.max()  # the roots
    for a, b in zip(levels, [*levels[1:], len(left)]):
        node = a + np.flatnonzero(inner[a:b] & kept[a:b])
        kept[left[node]] = kept[left[node] + 1] = True
    node = np.flatnonzero(kept)
    node = node[np.argsort(tree[node], kind="stable")]  # within a tree, children come after their parents
    begins = np.searchsorted(tree[node], np.arange(tree.max() + 1))
    number = np.zeros(len(left), np.int32)
    number[node] = np.arange(len(node)) - begins[tree[node]]
    has = inner[node]
    starts = np.append(0, np.cumsum([len(e) for e in ends]))
    values = np.concatenate([*ends, np.zeros(1)])
    threshold = values[np.where(has, starts[feature[node]] + bin[node], len(values) - 1)]
    columns = {
        "treeID": tree[node].astype(np.int32),
        "id": number[node],
        "prediction": prediction[node].astype(float),
        "impurity": impurity_of(counts[node], kind),
        "rawCount": counts[node].sum(axis=1).astype(np.int64),
        "gain": np.where(has, gain[node], -1.0),
        "leftChild": np.where(has, number[left[node]], -1).astype(np.int32),
        "rightChild": np.where(has, number[np.where(has, left[node] + 1, 0)], -1).astype(np.int32),
        "featureIndex": np.where(has, feature[node], -1).astype(np.int32),
        "threshold": threshold,
        "numCategories": np.full(len(node), -1, np.int32),
    }
    stats = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1) * counts.shape[1], pa.int32()), pa.array(counts[node].ravel()))
    table = pa.table({**{k: pa.array(v) for k, v in columns.items()}, "impurityStats": stats})
    split = F.struct("featureIndex", F.when(F.col("leftChild") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), "numCategories")
    fields = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
    path = shared_path(spark, "forest")
    nodes = spark.createDataFrame(table).select("treeID", F.struct(*fields, split.alias("split")).alias("nodeData"))
    nodes.write.parquet(f"{path}/data")

    def described(name: str, uid: str, without: tuple[str, ...] = (), **more) -> str:
        kinds = {k: {p.name: v for p, v in m.items() if p.name not in without} for k, m in (("paramMap", classifier._paramMap), ("defaultParamMap", classifier._defaultParamMap))}
        head = {"class": f"org.apache.spark.ml.classification.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
        return json.dumps(head | kinds | more)

    n_trees, whole = int(tree.max()) + 1, ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
    one = [(t, described("DecisionTreeClassificationModel", f"dtc_{classifier.uid}_{t}", whole), 1.0) for t in range(n_trees)]
    spark.createDataFrame(one, "treeID int, metadata string, weights double").write.parquet(f"{path}/treesMetadata")
    about = described("RandomForestClassificationModel", classifier.uid, numFeatures=features, numClasses=counts.shape[1], numTrees=n_trees)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    model = RandomForestClassificationModel.load(path)
    remove(spark, path)
    return model


class Scorer:
    """A saved forest in flat arrays, by its node table: what its trees vote for, as MLlib's model adds the votes up."""

    def __init__(self, nodes: pa.Table):
        """``nodes``: tree, id, leftChild, rightChild, feature, threshold, impurityStats; of any order."""
        nodes = nodes.sort_by([("tree", "ascending"), ("id", "ascending")])
        tree, left, right, feature = (nodes[c].to_numpy().astype(np.int64) for c in ("tree", "leftChild", "rightChild", "feature"))
        self.roots = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        first, inner = np.repeat(self.roots, np.diff(np.append(self.roots, len(tree)))), left >= 0
        self.left, self.right = (np.where(inner, first + x, np.arange(len(tree))) for x in (left, right))
        self.feature = np.where(inner, feature, 0)
        limit = np.where(inner, nodes["threshold"].to_numpy(zero_copy_only=False), 0.0)
        # Values are compared by their places among all thresholds of their feature.
        pairs = np.unique(np.stack([feature[inner].astype(float), limit[inner]]), axis=1)
        self.starts, self.limits = np.searchsorted(pairs[0], np.arange(int(pairs[0].max(initial=0)) + 2)), pairs[1]
        self.bin = np.full(len(tree), np.iinfo(np.uint32).max, np.uint32)
        self.bin[inner] = self.places(feature[inner], limit[inner])
        stats = nodes["impurityStats"].combine_chunks().flatten().to_numpy().reshape(len(tree), -1)
        total = stats.sum(axis=1, keepdims=True)
        self.votes = np.divide(stats, total, out=np.zeros_like(stats), where=total != 0)

    def places(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many thresholds of its feature lie below each value."""
        low, high = self.starts[feature].copy(), self.starts[feature + 1].copy()
        while (low < high).any():
            middle = (low + high) // 2
            below = (low < high) & (self.limits.take(middle, mode="clip") < value)
            low, high = np.where(below, middle + 1, low), np.where(below, high, np.minimum(middle, high))
        return low - self.starts[feature]

    def predict(self, indices: pa.ListArray, values: pa.ListArray) -> np.ndarray:
        out, features = [], len(self.starts) - 1
        for begin in range(0, len(indices), BLOCK_ROWS):
            own, n = indices.slice(begin, BLOCK_ROWS), min(BLOCK_ROWS, len(indices) - begin)
            feature, value = own.flatten().to_numpy(), values.slice(begin, BLOCK_ROWS).flatten().to_numpy()
            row = np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))
            known = np.flatnonzero(feature < features)
            row, feature, value = row[known], feature[known].astype(np.int64), value[known]
            bins = np.tile(self.places(np.arange(features), np.zeros(features)).astype(np.uint16 if len(self.limits) < 1 << 16 else np.uint32), n)
            bins[row * features + feature] = self.places(feature, value)
            node = np.tile(self.roots, n)
            at, base, done = np.arange(len(node)), np.repeat(np.arange(n) * features, len(self.roots)), node.copy()
            while len(at):
                for _ in range(3):
                    over = bins.take(base + self.feature.take(node)) > self.bin.take(node)
                    node = np.where(over, self.right.take(node), self.left.take(node))
                done[at] = node
                going = np.flatnonzero(self.left.take(node) != node)
                at, base, node = at[going], base[going], node[going]
            votes = np.zeros((n, self.votes.shape[1]))
            for leaf in done.reshape(n, -1).T:  # in the trees' order, so that sums are the model's own
                votes += self.votes.take(leaf, axis=0)
            out.append(votes.argmax(axis=1).astype(float))
        return np.concatenate(out) if out else np.zeros(0)


def with_predictions(df: DataFrame, path: str, features: str = "features") -> DataFrame:
    """Add ``prediction`` of the forest saved at ``path`` for sparse vectors: the same as its model gives, block by block of rows."""
    spark = df.sparkSession
    ship_package(spark)
    split = F.col("nodeData.split")
    columns = [F.col(f"nodeData.{c}") for c in ("id", "leftChild", "rightChild", "impurityStats")]
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), *columns, split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")
    )
    shared = spark.sparkContext.broadcast(Scorer(nodes.toArrow()))

    @F.arrow_udf("double")
    def voted(indices: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array(shared.value.predict(indices, values))

    plain = F.unwrap_udt(features)
    return df.withColumn("prediction", voted(plain["indices"], plain["values"]))
