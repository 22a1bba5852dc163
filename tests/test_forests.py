"""Forests grown from sparse vectors: held to their definition node by node, and to MLlib's in what they predict."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.linalg import SparseVector

from ticketmill.config import ForestParams, ScoreConfig
from ticketmill.operators import forests, models
from ticketmill.plans.score import score, scored_rows
from ticketmill.sinks.tables import save_stage
from ticketmill.sources.saved import load_job_table

FEATURES, CLASSES = 40, 3


def counts_and_labels(n):
    rng = np.random.default_rng(7)
    label = rng.integers(0, CLASSES, n)
    x = rng.poisson(0.4, (n, FEATURES)) + (np.arange(FEATURES) % 7 == label[:, None]) * rng.poisson(1.2, (n, FEATURES))
    x[:, 5] *= np.arange(n) % 90  # more values than bins
    x[:, 6] = 0
    return x, label


def gains(x, label, weight, ends, kind):
    """Gain, feature and threshold of all splits with rows on both sides."""

    def impurity(w):
        p = np.array([w[label == c].sum() for c in range(CLASSES)]) / w.sum()
        return 1 - (p * p).sum() if kind == "gini" else -sum(q * np.log2(q) for q in p if q)

    out = []
    for f, threshold in ((f, t) for f, e in enumerate(ends) for t in e):
        left, right = weight * (x[:, f] <= threshold), weight * (x[:, f] > threshold)
        if left.any() and right.any():
            gain = impurity(weight) - sum(w.sum() / weight.sum() * impurity(w) for w in (left, right))
            out.append((gain, [np.bincount(label, w, CLASSES).argmax() for w in (left, right)]))
    return out


@pytest.mark.parametrize("kind, depth", [("gini", 30), ("entropy", 4)])
def test_every_node_takes_the_best_split_of_its_rows(spark, tmp_path, monkeypatch, kind, depth):
    monkeypatch.setattr(forests, "PENDING", 500)  # counts leave the tasks many times
    monkeypatch.setattr(forests, "CELLS", 200)
    monkeypatch.setattr(forests, "BLOCK_PAIRS", 64)
    x, label = counts_and_labels(150)
    vector = lambda r: SparseVector(FEATURES, {i: float(v) for i, v in enumerate(r) if v})
    rows = [(i << 33 if i % 2 else i, vector(r), float(c)) for i, (r, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, ["row", "features", "label"])
    params = ForestParams(num_trees=4, max_depth=depth, max_bins=20, feature_subset="all", impurity=kind)
    model = forests.grow(df.repartition(3), models.forest(params), FEATURES, CLASSES, len(rows))
    save_stage(model, f"{tmp_path}/forest")
    nodes = models._nodes(spark, f"{tmp_path}/forest").collect()
    ends = [forests.thresholds(*map(np.array, zip(*sorted((v, int((x[:, f] == v).sum())) for v in set(x[:, f].tolist()) if v))), 150, 20) if x[:, f].any() else [] for f in range(FEATURES)]
    assert len(ends[5]) < 20 and len(ends[6]) == 0
    weight = forests.draws(np.array([r[0] for r in rows]), 4, params.seed).astype(float)
    deepest = 0
    for t in range(4):
        tree = {n["id"]: n for n in nodes if n["tree"] == t}
        going, seen = [(0, weight[:, t], 0)], 0
        while going:
            at, w, level = going.pop()
            node, seen, deepest = tree[at], seen + 1, max(deepest, level)
            assert list(node["impurityStats"]) == np.bincount(label, w, CLASSES).tolist() and node["rawCount"] == w.sum()
            assert node["prediction"] == np.bincount(label, w, CLASSES).argmax()
            found = gains(x, label, w, ends, kind) if node["impurity"] > 0 else []
            best = max([g for g, _ in found], default=0)
            if node["leftChild"] < 0:
                assert best < 1e-12 or level == depth or any(a == b for g, (a, b) in found if g > best - 1e-12)
                continue
            assert node["gain"] == pytest.approx(best)
            on_left = x[:, node["split"]["featureIndex"]] <= node["split"]["leftCategoriesOrThreshold"][0]
            going += [(node["leftChild"], w * on_left, level + 1), (node["rightChild"], w * ~on_left, level + 1)]
        assert seen == len(tree)
    assert deepest == depth or depth == 30 and deepest > 4


def test_large_tables_grow_from_sparse_vectors_and_score_as_mllib_does(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        c = int(rng.integers(0, 3))
        rows.append((i, "abc"[c], " ".join(f"w{w}" for w in rng.integers(0, 60, 20).tolist() + rng.integers(60 + 9 * c, 75 + 9 * c, 4).tolist())))
    df = spark.createDataFrame(rows, "doc_id long, group string, text string")
    train, test = df.where("doc_id % 4 > 0"), df.where("doc_id % 4 = 0")
    classifier = models.forest(ForestParams(num_trees=30, max_depth=12))
    fit = lambda part, dense: models.fit_text(part, classifier, ["a", "b", "c"], 200, "doc_id", 2, dense)
    sparse, again, dense = fit(train, 0), fit(train.repartition(7), 0), fit(train, 1 << 40)
    trees = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    assert trees(sparse) == trees(again)
    shares = [m.transform(test).where("label = prediction").count() / 150 for m in (sparse, dense)]
    assert min(shares) > 0.8 and abs(shares[0] - shares[1]) < 0.08
    one, other = (m.stages[-1] for m in (sparse, dense))
    for name in ("numTrees", "maxDepth", "maxBins", "impurity", "seed", "featureSubsetStrategy"):
        assert one.getOrDefault(name) == other.getOrDefault(name)
    assert (one.numClasses, one.numFeatures, len(one.trees)) == (3, 200, 30)
    assert max(t.depth for t in one.trees) == max(t.depth for t in other.trees) == 12


@pytest.mark.parametrize("dense", [0, 1 << 40])
def test_the_score_job_votes_in_blocks_as_the_model_does(spark, tmp_path, monkeypatch, dense):
    rng = np.random.default_rng(11)
    words = lambda: " ".join(f"w{w}" for w in rng.zipf(1.4, int(rng.integers(0, 60))) % 70)
    rows = [(i, "abc"[i % 3], words(), "x") for i in range(300)] + [(900, None, "", "x"), (900, "new", "w1 w2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, group string, text string, orgtext string")
    classifier = models.forest(ForestParams(num_trees=25, max_depth=10))
    model = models.fit_text(df.where("group in ('a', 'b', 'c')"), classifier, ["a", "b", "c"], 50, "doc_id", 2, dense)
    path = f"{tmp_path}/model"
    save_stage(model, path)
    monkeypatch.setattr(forests, "BLOCK_ROWS", 7)
    transformed = []
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda self, df: transformed.append(df))
    score(df, ScoreConfig("1", path, f"{tmp_path}/out"))
    monkeypatch.undo()
    assert not transformed  # MLlib goes down the trees row by row
    got = load_job_table(spark, f"{tmp_path}/out/scored", "1")
    want = scored_rows(model, df, "1")
    plain = lambda t: sorted(str(r) for r in t.select("job_id", "text", "orgtext", "label", "prediction").collect())
    assert plain(got) == plain(want) and len({r["prediction"] for r in got.collect()}) == 3


def test_rows_are_drawn_and_features_are_chosen_at_random():
    drawn = forests.draws(np.arange(4000), 50, 1234)
    assert drawn.mean() == pytest.approx(1, abs=0.02) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert drawn.var() == pytest.approx(1, abs=0.03) and not (drawn[:, 0] == drawn[:, 1]).all()
    chosen = forests.subsets(3000, 90, 9, np.random.default_rng(1))
    assert all(len(set(r)) == 9 for r in chosen.tolist())
    assert np.bincount(chosen.ravel(), minlength=90) == pytest.approx(np.full(90, 300), abs=90)
    sizes = [forests.subset_size(s, 6900, 200) for s in ("auto", "sqrt", "log2", "onethird", "all", "12", "0.5")]
    assert sizes == [84, 84, 13, 2300, 6900, 12, 3450] and forests.subset_size("auto", 6900, 1) == 6900
