"""Registered queries: each operator over whole tables of a data folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.config import ForestParams, PrepConfig, ScoreConfig, TrainConfig
from ticketmill.functions.segmentation import RUN
from ticketmill.functions.tokens import (
    exploded,
    inlined,
    joined,
    token_counts,
    whitespace_tokens,
)
from ticketmill.operators import corpus, evaluate, labels, models
from ticketmill.operators.features import array_features, bucket_words, hashed_tf, named_features, sparse_entries
from ticketmill.operators.segment import remove_words, segment, stop_natures
from ticketmill.plans.fixed import JOB, MOD, NATURES, PROTECTED, RULES, STOP_WORDS, WORDS
from ticketmill.plans.lexicon import Lexicon
from ticketmill.plans.prepare import prepare_text, prepared_split
from ticketmill.plans.score import score, scored_rows, scored_unlabelled
from ticketmill.plans.train import evaluated_predictions as evaluated
from ticketmill.plans.train import train
from ticketmill.session import exists, is_folder, shared_dir, shared_path, spread, stored
from ticketmill.sinks.tables import save_stage
from ticketmill.sources.saved import load_job_table, load_pipeline_model
from ticketmill.sources.text import read_numbered_tickets
from ticketmill.streaming import windows
from ticketmill.streaming.score import score_stream as stream_scores

NUM_FEATURES = 1000
# The forest of the text queries, at full size: 200 trees of depth 30 with 70 bins.
FOREST, FOREST_FEATURES = ForestParams(), 6900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def tokenized(spark: SparkSession, sf_dir: str, keep_punctuation: bool = True) -> DataFrame:
    tokens = whitespace_tokens(F.col("text"), keep_punctuation)
    return texts(spark, sf_dir).select("doc_id", tokens.alias("tokens"))


def counted(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), joined(F.col("tokens")).alias("text"))


# Text


def tokenize(spark, sf_dir):
    return counted(tokenized(spark, sf_dir))


def term_frequency(spark, sf_dir):
    return inlined(tokenized(spark, sf_dir), ["doc_id"], token_counts(F.col("tokens")), "n")


def tf_total(spark, sf_dir):
    entries = hashed_tf(tokenized(spark, sf_dir), "tokens", NUM_FEATURES).select(
        "doc_id", sparse_entries("features").alias("entries")
    )
    total = F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["tf"])
    return entries.select("doc_id", total.alias("total"))


def hashing_tf(spark, sf_dir):
    vectors = hashed_tf(tokenized(spark, sf_dir), "tokens", 6900)
    return inlined(vectors, ["doc_id"], sparse_entries("features"), "bucket")


def stopword_removal(spark, sf_dir):
    return counted(remove_words(tokenized(spark, sf_dir), "tokens", STOP_WORDS))


def stopword_table_removal(spark, sf_dir):
    stop = exploded(table(spark, sf_dir, "benchmark"), [], whitespace_tokens(F.col("text")), "word")
    return counted(remove_words(tokenized(spark, sf_dir), "tokens", stop, limit=0))


def drop_by_nature(spark, sf_dir):
    dictionary = spark.createDataFrame(NATURES, "word string, nature string")
    rows = tokenized(spark, sf_dir, keep_punctuation=False)
    return counted(remove_words(rows, "tokens", stop_natures(dictionary)))


def segment_max_match(spark, sf_dir):
    return counted(segment(texts(spark, sf_dir), "text", "tokens", WORDS, "longest"))


def segment_all_matches(spark, sf_dir):
    return counted(segment(texts(spark, sf_dir), "text", "tokens", WORDS, "finest"))


def table_words(spark, sf_dir) -> DataFrame:
    """A dictionary that grows with the data: the words of the benchmark passages."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(f"{RUN}+"), F.lit(0))
    return exploded(table(spark, sf_dir, "benchmark"), [], runs, "word").select("word").distinct()


def segment_max_match_join(spark, sf_dir):
    return counted(segment(texts(spark, sf_dir), "text", "tokens", table_words(spark, sf_dir), "longest", limit=0))


def segment_all_matches_join(spark, sf_dir):
    return counted(segment(texts(spark, sf_dir), "text", "tokens", table_words(spark, sf_dir), "finest", limit=0))


def segment_max_match_shuffled(spark, sf_dir):
    """The plan for dictionaries that are too large for a worker to hold."""
    words = table_words(spark, sf_dir)
    return counted(segment(texts(spark, sf_dir), "text", "tokens", words, "longest", limit=0, held_rows=0))


def segment_all_matches_shuffled(spark, sf_dir):
    words = table_words(spark, sf_dir)
    return counted(segment(texts(spark, sf_dir), "text", "tokens", words, "finest", limit=0, held_rows=0))


def letter_words(spark, sf_dir) -> DataFrame:
    """A dictionary whose words cross the borders of runs: pairs of benchmark words with the blank between them."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+ [\p{L}]+"), F.lit(0))
    return exploded(table(spark, sf_dir, "benchmark"), [], pairs, "word").select("word").distinct()


def segment_all_matches_any(spark, sf_dir):
    """All matches with a dictionary that is not made of runs only, as Chinese ones are."""
    return counted(segment(texts(spark, sf_dir), "text", "tokens", letter_words(spark, sf_dir), "finest"))


def segment_best_path(spark, sf_dir):
    """The likeliest path through the lattice of dictionary words, whose frequencies are learned from the same texts."""
    return counted(segment(texts(spark, sf_dir), "text", "tokens", table_words(spark, sf_dir), "likeliest"))


def segment_phrase_table(spark, sf_dir):
    """Protected phrases that grow with the data, as a table: pairs of neighbouring words of the benchmark passages."""
    phrases = letter_words(spark, sf_dir)
    return counted(segment(texts(spark, sf_dir), "text", "tokens", WORDS, "longest", protected=phrases, phrase_limit=0))


def segment_protected(spark, sf_dir):
    return counted(segment(texts(spark, sf_dir), "text", "tokens", WORDS, "longest", protected=PROTECTED))


def segment_ambiguity(spark, sf_dir):
    return counted(
        segment(texts(spark, sf_dir), "text", "tokens", WORDS, "longest", protected=PROTECTED, rules=RULES)
    )


def prepared_texts(spark, sf_dir) -> DataFrame:
    lexicon = Lexicon(WORDS, STOP_WORDS)
    return prepare_text(texts(spark, sf_dir, "lang"), lexicon, PrepConfig(group_col="lang", text_col="text"))


def prepare_split(spark, sf_dir):
    """The preparation job: segment, drop stop words and words of dropped natures, drop singleton classes, split."""
    dictionary = spark.createDataFrame([(w, None) for w in WORDS] + NATURES, "word string, nature string")
    config = PrepConfig(group_col="source", text_col="text", mode="longest", mod=MOD)
    rows = prepared_split(texts(spark, sf_dir, "source"), Lexicon(dictionary, STOP_WORDS), config)
    return rows.select("doc_id", "group", "text", "part")


# Records


def quoted_records(spark, sf_dir):
    """The documents as quoted text files, texts with their line breaks, and read again in parallel splits."""
    path = shared_path(spark, "records")
    ordered = table(spark, sf_dir, "documents").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select("lang", "text")
    plain = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.options(**plain).csv(path)
    return read_numbered_tickets(spark, path, header=False).withColumnRenamed("doc_id", "row_num")


# Classes, splits, indices


def label_index(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")

    def index(field: str) -> DataFrame:
        return labels.label_index(documents, field, JOB).select(F.lit(field).alias("field"), "*")

    return index("lang").unionByName(index("source"))


def label_decode(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    index = labels.label_index(documents, "source", JOB)
    coded = labels.encode(documents, index, "source").select("doc_id", "label")
    return labels.decode(coded, index, "label", "decoded")


def class_profile(spark, sf_dir):
    return corpus.class_frequency(table(spark, sf_dir, "documents"), "source", min_rows=2)


def corpus_profile(spark, sf_dir):
    rows = texts(spark, sf_dir, "source")
    return corpus.corpus_profile(rows, "source", "text", whitespace_tokens(F.col("text")))


def corpus_profile_sketched(spark, sf_dir):
    """The profile from sketches of three parts, and whether its estimates are close to the exact counts."""
    rows, words = texts(spark, sf_dir, "source"), whitespace_tokens(F.col("text"))
    sketches = stored(corpus.profile_sketches(rows, "source", "text", words, F.pmod("doc_id", F.lit(3))), "sketches")
    exact = corpus.corpus_profile(rows, "source", "text", words).select("kind", F.col("n_distinct").alias("exact"))
    off = F.abs(F.col("n_distinct") - F.col("exact")) / F.col("exact")
    return corpus.merged_profile(sketches).join(exact, "kind").select("kind", "n_rows", "n_chars", (off <= 0.04).alias("is_close"))


def drop_singleton_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return corpus.drop_singleton_classes(rows, "n_chars").select("doc_id", "n_chars")


def modulo_split(spark, sf_dir):
    return corpus.modulo_split(table(spark, sf_dir, "documents"), "doc_id", "n_chars", MOD).select(
        "doc_id", "n_chars", "row_num", "part"
    )


def hash_split(spark, sf_dir):
    return corpus.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8)


def vocab_index(spark, sf_dir):
    return corpus.vocab_index(tokenized(spark, sf_dir), "doc_id", F.col("tokens"))


def vocab_index_grown(spark, sf_dir):
    """The vocabulary, grown by the documents in three batches."""
    rows = stored(tokenized(spark, sf_dir).select("doc_id", "tokens"), "tokens")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    path = shared_path(spark, "vocabulary")
    for k in range(3):
        from_id, to_id = (low + (high + 1 - low) * i // 3 for i in (k, k + 1))
        grown = corpus.grow_vocabulary(path, rows.where(F.col("doc_id").between(from_id, to_id - 1)), "doc_id", F.col("tokens"))
    return grown.select("word", "idx")


def distinct_doc_index(spark, sf_dir):
    return corpus.distinct_doc_index(tokenized(spark, sf_dir), "doc_id", F.col("tokens"))


# Evaluation


def judged(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("prediction")
    )


def eval_accuracy(spark, sf_dir):
    return evaluate.accuracy(judged(spark, sf_dir))


def test_error(spark, sf_dir):
    return evaluate.test_error(judged(spark, sf_dir))


test_error.__test__ = False


def misclassified(spark, sf_dir):
    return evaluate.misclassified(judged(spark, sf_dir))


def eval_confusion(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir))


def eval_per_class(spark, sf_dir):
    return evaluate.per_class(judged(spark, sf_dir))


# Models


def model_path(spark, sf_dir, name: str) -> str:
    """Where the model of a data folder is saved: the query that trains it puts it there, others load it."""
    folder = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()
    return f"{shared_dir(spark)}/ticketmill/models/{folder}/{name}"


def split_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Prepared documents, split by the hash of their id."""
    prepared = corpus.hash_split(prepared_texts(spark, sf_dir), "doc_id", 0.8)
    return prepared.where("part = 'train'").drop("bucket", "part"), prepared.where("part = 'test'").drop("bucket", "part")


def train_forest(spark, sf_dir, name: str, params: ForestParams, num_features: int):
    config = TrainConfig(
        job_id=JOB,
        model_dir=model_path(spark, sf_dir, name),
        output_dir=shared_path(spark, "tables"),
        num_features=num_features,
        fit_partitions=spark.sparkContext.defaultParallelism,
        forest=params,
    )
    result = train(*split_texts(spark, sf_dir), config)
    return config, result


def forest_text(spark, sf_dir):
    """Train job on the documents; the accuracy table it writes. The other queries load the model it saves."""
    return train_forest(spark, sf_dir, "forest", FOREST, FOREST_FEATURES)[1].accuracy


def forest_text_full(spark, sf_dir):
    """The train job at full size: 200 trees of depth 30 with 70 bins over 6,900 features."""
    return train_forest(spark, sf_dir, "forest_full", ForestParams(), FOREST_FEATURES)[1].accuracy


def trained_path(spark, sf_dir) -> str:
    path = f"{model_path(spark, sf_dir, 'forest')}/job_id={JOB}"
    if not exists(spark, path):
        train_forest(spark, sf_dir, "forest", FOREST, FOREST_FEATURES)
    return path


def trained_forest(spark, sf_dir) -> PipelineModel:
    return load_pipeline_model(trained_path(spark, sf_dir))


def forest_folder(spark, sf_dir) -> str:
    """The folder of the forest itself: the last stage of the saved pipeline."""
    path = f"{trained_path(spark, sf_dir)}/stages"
    last = len(trained_forest(spark, sf_dir).stages) - 1
    stages = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-00000*").load(path)
    places = stages.select(F.regexp_extract("path", r"/stages/([^/]+)/", 1).alias("stage")).distinct()
    return f"{path}/" + places.where(F.col("stage").rlike(f"^0*{last}_")).first()["stage"]


def evaluated_predictions(spark, sf_dir):
    return evaluated(trained_forest(spark, sf_dir), split_texts(spark, sf_dir)[1], JOB)


def evaluated_rows(spark, sf_dir):
    """The held-out rows as the train job evaluates them, but for the prediction."""
    return evaluated_predictions(spark, sf_dir).drop("prediction")


def score_batch(spark, sf_dir):
    rows = prepared_texts(spark, sf_dir).drop("group")
    return scored_rows(trained_forest(spark, sf_dir), rows, JOB, keep=("doc_id",))


def score_job(spark, sf_dir):
    """The score job run twice under one id: the table it leaves, but for the prediction."""
    path = trained_path(spark, sf_dir)
    out = shared_path(spark, "score")
    for _ in range(2):
        score(prepared_texts(spark, sf_dir), ScoreConfig(JOB, path, out))
    return load_job_table(spark, f"{out}/scored", JOB).select("job_id", "text", "orgtext", "label")


def read_stream(spark, sf_dir, name: str) -> DataFrame:
    """A table of the folder as a file stream, whether it is one file or a folder of part files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def score_stream(spark, sf_dir):
    """The documents as a file stream, segmented and scored in one pass."""
    documents = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    few_splits = documents.rdd.getNumPartitions() < 2 * cores
    out = shared_path(spark, "stream")
    prep = PrepConfig(group_col="", text_col="text")
    query = stream_scores(
        trained_forest(spark, sf_dir),
        read_stream(spark, sf_dir, "documents").select("doc_id", "text"),
        JOB,
        f"{out}/scored",
        f"{out}/progress",
        keep=("doc_id",),
        prepare=lambda df: prepare_text(df, Lexicon(WORDS, STOP_WORDS), prep),
        partitions=2 * cores if few_splits else None,
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/scored")


def stream_rows(spark, sf_dir):
    """What the stream leaves, but for the prediction."""
    return score_stream(spark, sf_dir).select("doc_id", "job_id", "text", "orgtext")


def model_roundtrip(spark, sf_dir):
    """Train, save, load: rows that the trained and the saved-and-loaded model score alike, and those they do not.

    Both models go their whole way from the text, one after the other in a row.
    """
    model = train_forest(spark, sf_dir, "forest", FOREST, FOREST_FEATURES)[1].model
    path = shared_path(spark, "model")
    save_stage(model, path)
    again = load_pipeline_model(path)
    rows = split_texts(spark, sf_dir)[1].select("doc_id", "text")
    first = model.transform(rows).select("doc_id", "text", F.col("prediction").alias("saved"))
    second = again.transform(first).select("doc_id", "saved", F.col("prediction").alias("loaded"))
    return second.groupBy((F.col("saved") == F.col("loaded")).alias("same")).agg(F.count("*").alias("n"))


def model_report(spark, sf_dir):
    return models.tree_report(spark, forest_folder(spark, sf_dir))


def feature_report(spark, sf_dir):
    return models.feature_report(spark, forest_folder(spark, sf_dir))


def vectors(spark, sf_dir) -> DataFrame:
    rows = array_features(table(spark, sf_dir, "embeddings"), "embedding").select(
        "vec_id", F.col("label").cast("string").alias("name"), "features"
    )
    return corpus.hash_split(rows, "vec_id", 0.8)


def feature_words(spark, sf_dir):
    """The three most frequent words of each hashed feature, with their shares of it."""
    return bucket_words(tokenized(spark, sf_dir), F.col("tokens"), 6900)


def named_feature_report(spark, sf_dir):
    """The importances of the forest's features, by the words that fall into them."""
    report = models.feature_report(spark, forest_folder(spark, sf_dir))
    words = bucket_words(prepared_texts(spark, sf_dir), F.split(F.lower("text"), r"\s"), FOREST_FEATURES)
    return named_features(report, words)


def forest_numeric(spark, sf_dir):
    rows = stored(vectors(spark, sf_dir), "vectors")
    model = models.fit_numeric_forest(rows.where("part = 'train'"), "name", "vec_id", rows)
    return model.transform(rows.where("part = 'test'")).select(
        "vec_id",
        F.col("name").alias("label"),
        "indexed_label",
        "prediction",
        "predicted_label",
        vector_to_array("probability").alias("probability"),
    )


def numeric_labels(spark, sf_dir):
    """The held-out rows of the numeric forest with their labels indexed on the whole table."""
    rows = vectors(spark, sf_dir)
    indexer, _ = models.numeric_stages(rows, "name")
    return indexer.transform(rows.where("part = 'test'")).select("vec_id", F.col("name").alias("label"), "indexed_label")


def numeric_error(spark, sf_dir):
    """Error of the numeric forest on its indexed label."""
    return evaluate.test_error(forest_numeric(spark, sf_dir), "indexed_label")


def forest_binary(spark, sf_dir):
    """Three shallow trees, 70/30 split, and their error on the held-out rows."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", (F.col("label") % 2).cast("double"))
    rows = corpus.hash_split(array_features(rows, "embedding").select("vec_id", "label", "features"), "vec_id", 0.7)
    rows = stored(rows, "binary")
    model = models.fit_small_forest(rows.where("part = 'train'"), "vec_id")
    return evaluate.test_error(model.transform(rows.where("part = 'test'")))


def judged_texts(spark, sf_dir) -> DataFrame:
    quality = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return texts(spark, sf_dir).join(quality, "doc_id")


def fit_logistic(spark, sf_dir) -> PipelineModel:
    """Fit on the labelled documents and save the pipeline where the scoring query looks for it."""
    rows = stored(judged_texts(spark, sf_dir), "judged")
    model = models.text_pipeline(NUM_FEATURES).fit(rows.select("text", "label"))
    save_stage(model, model_path(spark, sf_dir, "logistic"))
    return model


def logreg_text(spark, sf_dir):
    """Logistic regression on the labelled documents, applied to all of them."""
    model = fit_logistic(spark, sf_dir)
    return model.transform(judged_texts(spark, sf_dir)).select(
        "doc_id", "label", vector_to_array("probability").alias("probability"), "prediction"
    )


def score_unlabelled(spark, sf_dir):
    path = model_path(spark, sf_dir, "logistic")
    model = load_pipeline_model(path) if exists(spark, path) else fit_logistic(spark, sf_dir)
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return scored_unlabelled(model, turns, ["conv_id", "turn"])


# Streams


def windowed_counts(spark, sf_dir):
    """Hourly counts of the events read as a file stream.

    Equal to the batch result as long as no event comes a day or more after a later one in an earlier micro-batch: such
    events are dropped, by the lateness given here.
    """
    rows = read_stream(spark, sf_dir, "events")
    counts = windows.windowed_counts(rows.select("ts", "event_type"), "ts", "event_type", "1 hour", "1 day")
    out = shared_path(spark, "windows")
    windows.write_updates(counts, f"{out}/updates", f"{out}/progress").awaitTermination()
    counts = windows.latest(spark.read.parquet(f"{out}/updates"), ["window_start", "event_type"])
    # The event times carry no zone, so neither do the windows.
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def closed_windows(spark, sf_dir):
    """Hourly counts of the windows that the watermark has passed, each written once."""
    out = shared_path(spark, "closed")
    rows = read_stream(spark, sf_dir, "events").select("ts", "event_type")
    for query in windows.write_closed(rows, "ts", "event_type", "1 hour", "1 day", out, f"{out}/progress"):
        query.awaitTermination()
    counts = spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{out}/closed")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tokenize": tokenize,
        "term_frequency": term_frequency,
        "tf_total": tf_total,
        "hashing_tf": hashing_tf,
        "stopword_removal": stopword_removal,
        "stopword_table_removal": stopword_table_removal,
        "drop_by_nature": drop_by_nature,
        "segment_max_match": segment_max_match,
        "segment_all_matches": segment_all_matches,
        "segment_max_match_join": segment_max_match_join,
        "segment_all_matches_join": segment_all_matches_join,
        "segment_max_match_shuffled": segment_max_match_shuffled,
        "segment_all_matches_shuffled": segment_all_matches_shuffled,
        "segment_all_matches_any": segment_all_matches_any,
        "segment_best_path": segment_best_path,
        "segment_phrase_table": segment_phrase_table,
        "segment_protected": segment_protected,
        "segment_ambiguity": segment_ambiguity,
        "prepare_text": prepared_texts,
        "prepare_split": prepare_split,
        "quoted_records": quoted_records,
        "label_index": label_index,
        "label_decode": label_decode,
        "class_profile": class_profile,
        "corpus_profile": corpus_profile,
        "corpus_profile_sketched": corpus_profile_sketched,
        "drop_singleton_classes": drop_singleton_classes,
        "modulo_split": modulo_split,
        "hash_split": hash_split,
        "vocab_index": vocab_index,
        "vocab_index_grown": vocab_index_grown,
        "distinct_doc_index": distinct_doc_index,
        "eval_accuracy": eval_accuracy,
        "test_error": test_error,
        "misclassified": misclassified,
        "eval_confusion": eval_confusion,
        "eval_per_class": eval_per_class,
        "forest_text": forest_text,
        "forest_text_full": forest_text_full,
        "evaluated_predictions": evaluated_predictions,
        "evaluated_rows": evaluated_rows,
        "score_batch": score_batch,
        "score_job": score_job,
        "score_stream": score_stream,
        "stream_rows": stream_rows,
        "model_roundtrip": model_roundtrip,
        "model_report": model_report,
        "feature_report": feature_report,
        "feature_words": feature_words,
        "named_feature_report": named_feature_report,
        "forest_numeric": forest_numeric,
        "numeric_labels": numeric_labels,
        "numeric_error": numeric_error,
        "forest_binary": forest_binary,
        "logreg_text": logreg_text,
        "score_unlabelled": score_unlabelled,
        "windowed_counts": windowed_counts,
        "closed_windows": closed_windows,
    }
