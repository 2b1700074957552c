"""Each stage on documents whose fate is known, and the whole on a table."""

import corpus_pipeline
import pytest
from helpers import documents
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.scratch import write_table


def test_stages_are_as_agreed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "dedup", "secrets", "packing"]


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plus = docs.limit(3).select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200_000, None, None, "s", 0), (200_001, "123 456 !!!", "en", "s", 11), (200_002, "", None, None, 0)], docs.schema)
    found = [docs.unionByName(plus).unionByName(odd)]
    for _, stage in corpus_pipeline.STAGES:
        found.append(write_table(stage(spark, found[-1], sf_dir), "stage"))
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_shrinking(outputs):
    for df in outputs[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    for before, after in zip(outputs, outputs[1:], strict=False):
        assert ids(after) <= ids(before)
    assert ids(outputs[3]) == ids(outputs[4]) == ids(outputs[5])


def test_texts_without_a_language_go_and_all_others_stay(outputs):
    assert ids(outputs[0]) - ids(outputs[1]) == {200_000, 200_001, 200_002}


def test_quality_keeps_the_good(spark, sf_dir, outputs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1").join(outputs[1], "doc_id", "left_semi")
    bad = labels.where("quality = 0").join(outputs[1], "doc_id", "left_semi")
    kept = outputs[2].select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    assert bad.join(kept, "doc_id", "left_semi").count() <= 0.2 * bad.count()


def test_one_copy_of_each_text_stays(outputs):
    assert outputs[3].groupBy("text").count().where("count > 1").count() == 0
    before, after = outputs[2].select("text").distinct(), outputs[3].select("text").distinct()
    assert after.count() <= before.count() and not {x for x in ids(outputs[3]) if 100_000 <= x < 100_003}


def test_one_row_of_each_class_stays_whatever_its_id(spark, sf_dir):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (5, text("a") + " more"), (5, text("c")), (None, text("a")), (None, text("d")), (None, text("d")), (6, text("e")), (6, text("f")), (7, text("f") + " more")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup_stage(spark, docs, sf_dir)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, text("d")), (1, text("a")), (2, text("b")), (5, text("c")), (6, text("e")), (6, text("f"))]


def test_secrets_are_masked(outputs):
    assert outputs[4].where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    assert outputs[4].where("n_chars <> length(text)").count() == 0


def test_pieces_are_packed(outputs):
    bins = outputs[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("low"))
    assert bins.where("n <> end or n > 2048 or low <> 0").count() == 0


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry

    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.QUERIES) <= set(names)


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    rows = documents(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, sf_dir).count() >= 0
        assert stage(spark, rows.limit(0), sf_dir).count() == 0
