"""Features tell their whole values."""

from pyspark.sql import functions as F

from tidemark.plans import table_queries


def test_spine_has_every_order_count(spark, sf_dir):
    got = table_queries.feature_spine(spark, sf_dir).where("feature = 'order_count'")
    assert got.agg(F.sum("value")).first()[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_matrix_has_every_order_count(spark, sf_dir):
    got = table_queries.feature_matrix(spark, sf_dir)
    assert got.agg(F.sum("order_count")).first()[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
