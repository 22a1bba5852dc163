"""The operators as pipeline stages over ``documents``, and how stages run one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.llm import bpe, decontaminate, language, line_dedup, order_minhash
from ticketmill.llm.rows import prepare_session, store

TOKENIZER = "word_bpe_49k.json"


def _aside(documents: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that an operator would replace, and how to name them back."""
    clash = {c: f"kept aside {c}" for c in documents.columns if c.lower() in names}
    return documents.withColumnsRenamed(clash), {new: old for old, new in clash.items()}


def identify_language(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents' own languages; documents without a language go, and those for which none stands out among
    as many as were learned. Without any learned language all go."""
    columns = documents.columns
    model = language.fit(documents)
    renamed, back = _aside(documents, "lang_pred", "score")
    predicted = language.predict(renamed, model).filter(~language.is_rejected(F.col("lang_pred"), F.col("score"), language.least_score(len(model.languages))))
    return predicted.drop("lang_pred", "score").withColumnsRenamed(back).select(*columns)


def drop_lines(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks that an earlier document has; a document of which only white space is left goes. ``n_chars`` follows the text."""
    columns = documents.columns
    renamed, back = _aside(documents, "n_lines", "n_removed", "earlier")
    done = line_dedup.drop_common_lines(renamed)
    done = done.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return done.drop("n_lines", "n_removed", "earlier").withColumnsRenamed(back).select(*columns)


def drop_near_duplicates(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the smallest doc_id."""
    return order_minhash.drop_near_duplicates(documents)


def drop_contaminated(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in passages of the benchmark go."""
    return decontaminate.drop_contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids (``ids``, little-endian 32-bit integers), their number (``n_tokens``) and digests (``ids_sha256``, ``decoded_sha256``).

    It is the last stage, whose columns readers look for by these names: columns of the documents that are called so are replaced. A null text
    has no tokens; repeated rows get theirs each.
    """
    return bpe.encode_documents(documents, public_tokenizers.path(TOKENIZER), with_ids=True)


def run_stages(stages: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply (name, function) stages to ``documents``; every result is written to the shared folder and read again."""
    prepare_session(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages:
        documents = store(stage(spark, documents, sf_dir), name)
    return documents
