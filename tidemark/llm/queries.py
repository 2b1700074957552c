"""The registered queries of this subpackage: operator N over its whole table, as op<N>_<name>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, id_files, language, library_ids, packing, periodic, quality, resampling, secrets, simhash, sketches, surrogates
from .labelled import remainder


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is; any operator takes another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit_forest(secrets.labelled_findings(spark))
    return secrets.scan(read(spark, sf_dir, "documents"), model, at_least=0.5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return both.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(read(spark, sf_dir, "documents"), key="a key of the caller")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_edits(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = language.fit_languages(documents.where("not held_out"))
    return language.predict(documents, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "bits_per_symbol")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, read(spark, sf_dir, "labels"), monotone=quality.FALLING)
    return quality.apply_rules(documents, model)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read(spark, sf_dir, "documents"), width=3, seed=42)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = id_files.store(library_ids.encode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))
    files = id_files.write_ids(encoded, parts=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return id_files.read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = library_ids.encode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, bits=32)
    pieces = packing.cut(encoded, 2048).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(packing.table(pieces), 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit_quality(documents, labels.where(~held_out))
    return quality.classify(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(read(spark, sf_dir, "documents"), plant=True)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_bpe, op3_surrogates, op4_fingerprints, op5_language, op6_quality_rules, op7_simhash, op8_id_files, op9_packing, op10_quality, op11_hamming, op12_runs, op13_resample)}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {}
