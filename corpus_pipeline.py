"""A pipeline over documents in five stages, each an operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next one's docs. All stages but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, library_ids, packing, quality, secrets, simhash
from tidemark.llm.queries import tokenizer_path
from tidemark.scratch import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that no language's tree codes in fewer bits a symbol is in none of them; a uniform code takes 6.
MOST_BITS = 6.0
#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
CAPACITY = 2048


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the table's own labels, with ``lang`` as found. Those without letters, or nearer to noise than to any language, go."""
    model = language.fit_languages(docs)
    found = language.predict(docs, model, keep=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_symbol") < MOST_BITS)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores LEAST_QUALITY or more by the classifier, fitted on the table of labels."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model, keep=tuple(COLUMNS)).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies (shingles of five words, 0.8 alike), that of the smallest id; null ids come last. Repeated ids and rows with a null id take part by their text."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted anew."""
    model = secrets.fit_forest(secrets.labelled_findings(spark))
    masked = secrets.redact(docs, model)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``sequence_id`` and ``offset`` in sequences of at most CAPACITY tokens."""
    encoded = library_ids.encode(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, bits=32)
    pieces = packing.table(packing.cut(encoded, CAPACITY).select("doc_id", "piece", "start", "length"))
    return packing.pack(pieces, CAPACITY)


STAGES = [("language", language_stage), ("quality", quality_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: Language models, fingerprints, forests and tokenizers are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
