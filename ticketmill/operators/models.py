"""Classifiers as pipelines: text forest, numeric forest, text logistic regression, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, StringIndexerModel, Tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.config import ForestParams
from ticketmill.operators.forests import DENSE_BYTES, grow
from ticketmill.session import shared_dir, ship_package, stored

SEED = 1234


def forest(params: ForestParams, features: str = "features", label: str = "label") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features,
        labelCol=label,
        numTrees=params.num_trees,
        maxDepth=params.max_depth,
        maxBins=params.max_bins,
        featureSubsetStrategy=params.feature_subset,
        impurity=params.impurity,
        minInstancesPerNode=params.min_instances,
        minInfoGain=params.min_info_gain,
        cacheNodeIds=params.cache_node_ids,
        checkpointInterval=params.checkpoint_interval,
        seed=params.seed,
        maxMemoryInMB=params.max_memory_mb,
    )


def class_names(index: DataFrame, num_classes: int | None = None) -> list[str]:
    """Class names in label order, checked against the declared number. The model holds them all, one name a class."""
    rows = index.orderBy("label").select("group").collect()
    if num_classes is not None and len(rows) > num_classes:
        raise ValueError(f"{len(rows)} classes in the data, {num_classes} declared")
    return [r["group"] for r in rows]


def placed(df: DataFrame, id_col: str, partitions: int) -> DataFrame:
    """Fix which rows share a partition and their order, so that refitting gives the same trees."""
    return df.repartition(partitions, id_col).sortWithinPartitions(id_col)


def text_stages(num_features: int) -> tuple[Tokenizer, HashingTF]:
    return (
        Tokenizer(inputCol="text", outputCol="words"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=num_features),
    )


def fit_text(
    train: DataFrame,
    classifier,
    names: list[str],
    num_features: int,
    id_col: str | None = None,
    partitions: int | None = None,
    dense_bytes: int = DENSE_BYTES,
) -> PipelineModel:
    """Fit a text classifier on ``group, text``.

    Hashing happens once: the sparse vectors are stored and every pass of the fit reads those instead of text. MLlib's forest bins all
    features of a row; beyond ``dense_bytes`` of such bins the forest is grown from the sparse vectors (:mod:`ticketmill.operators.forests`).
    The returned pipeline scores tables with or without ``group``; unknown classes get an extra label.
    """
    shared_dir(train.sparkSession)
    tokenizer, hashing = text_stages(num_features)
    indexer = StringIndexerModel.from_labels(names, "group", "label", handleInvalid="error")
    train = train.where(F.col("group").isNotNull())
    vectors = PipelineModel([tokenizer, hashing, indexer]).transform(train)
    if partitions:
        vectors = placed(vectors.select(id_col, "features", "label"), id_col, partitions)
    rows = train.count() if isinstance(classifier, RandomForestClassifier) else 0
    if 4 * rows * num_features > dense_bytes:
        numbered = stored(vectors.select(F.monotonically_increasing_id().alias("row"), "features", "label"), "vectors")
        fitted = grow(numbered, classifier, num_features, len(names), rows)
    else:
        fitted = classifier.fit(stored(vectors.select("features", "label"), "vectors"))
    indexer.setHandleInvalid("keep")
    return PipelineModel([tokenizer, hashing, indexer, fitted])


def text_pipeline(num_features: int = 1000, max_iter: int = 10, reg: float = 0.01) -> Pipeline:
    """Unfitted tokenizer, hashing and logistic-regression stages over ``text, label``."""
    return Pipeline(stages=[*text_stages(num_features), LogisticRegression(maxIter=max_iter, regParam=reg)])


def numeric_stages(rows: DataFrame, label: str) -> tuple[StringIndexerModel, IndexToString]:
    """Index the labels of the whole table, so that no part has an unknown one, and decode predictions."""
    indexer = StringIndexer(inputCol=label, outputCol="indexed_label").fit(rows)
    return indexer, IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)


def fit_numeric_forest(
    train: DataFrame, label: str, id_col: str, whole: DataFrame | None = None, num_trees: int = 5, partitions: int = 8
) -> PipelineModel:
    """Forest over ``features`` with the label indexed first and the prediction decoded to ``predicted_label``.

    Labels are indexed on ``whole``, the table before it was split. Placement and seed are fixed: the same rows
    give the same trees.
    """
    indexer, decoder = numeric_stages(train if whole is None else whole, label)
    classifier = RandomForestClassifier(
        labelCol="indexed_label", featuresCol="features", numTrees=num_trees, seed=SEED
    )
    fitted = classifier.fit(indexer.transform(placed(train, id_col, partitions)))
    return PipelineModel([indexer, fitted, decoder])


def fit_small_forest(train: DataFrame, id_col: str, partitions: int = 8) -> RandomForestClassificationModel:
    """Three shallow trees over ``label, features``, as for LibSVM data; the same rows give the same trees."""
    params = ForestParams(num_trees=3, max_depth=4, max_bins=32)
    return forest(params).fit(placed(train, id_col, partitions).select("label", "features"))


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a saved forest."""
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")


def _shape(nodes: pd.DataFrame) -> pd.DataFrame:
    """Depth and size of one tree; a node's number is lower than its children's."""
    nodes = nodes.sort_values("id")
    depth = {0: 0}
    for node, left, right in zip(nodes["id"], nodes["leftChild"], nodes["rightChild"]):
        if left >= 0:
            depth[left] = depth[right] = depth[node] + 1
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "depth": max(depth.values()), "n_nodes": len(nodes)})


def tree_report(spark: SparkSession, path: str) -> DataFrame:
    """``tree, depth, n_nodes, weight``: one row per tree of a saved forest, from its node and tree tables."""
    ship_package(spark)
    links = _nodes(spark, path).select("tree", "id", "leftChild", "rightChild")
    shapes = links.groupBy("tree").applyInPandas(_shape, "tree int, depth int, n_nodes int")
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight")
    return shapes.join(trees.select("tree", "weight"), "tree")


def feature_report(spark: SparkSession, path: str) -> DataFrame:
    """``feature, importance`` of the features that some tree of a saved forest uses.

    A split counts with its gain times its rows; the splits of a tree add up to one, and so do all importances.
    """
    rows = F.aggregate("impurityStats", F.lit(0.0), lambda total, n: total + n)
    splits = _nodes(spark, path).where("leftChild >= 0")
    by_tree = splits.groupBy("tree", F.col("split.featureIndex").alias("feature")).agg(
        F.sum(F.col("gain") * rows).alias("weight")
    )
    totals = by_tree.groupBy("tree").agg(F.sum("weight").alias("all")).where("all > 0")
    shares = by_tree.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("weight") / F.col("all")).alias("share"))
    n = totals.count()  # trees with a split
    return shares.select("feature", (F.col("share") / n).alias("importance"))
