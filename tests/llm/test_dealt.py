"""Near-dedup sends no table of unknown size by way of the driver."""

from helpers import documents
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.operators import components


def written(monkeypatch, module):
    """The first plans of the tables that ``module`` writes, as they come."""
    plans, write = [], module.write_table

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(module, "write_table", kept)
    return plans


def test_exploded_variants_are_never_broadcast(spark, monkeypatch):
    """Spark tells their size by the files of the values, 64 times less than they have."""
    plans = written(monkeypatch, simhash)
    values = components.write_table(spark.range(400).select(F.col("id").alias("rep"), F.xxhash64("id").alias("simhash")), "values")
    found = simhash.links(values)
    plans.append(("links", found._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, _ in plans] == ["variants", "links"]
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_components_are_never_broadcast_and_end_when_settled(spark, monkeypatch):
    plans = written(monkeypatch, components)
    stars = spark.createDataFrame([(1, 2), (3, 1), (5, 4), (4, 4), (2, 1)], "a long, b long")
    assert {r.node: r.root for r in components.smallest_reachable(stars).collect()} == {2: 1, 3: 1, 5: 4}
    assert len(plans) == 1
    plans.clear()
    chain = spark.createDataFrame([(7, 9), (9, 8), (8, 3)], "a long, b long")
    assert {r.node: r.root for r in components.smallest_reachable(chain).collect()} == {7: 3, 8: 3, 9: 3}
    assert len(plans) > 1 and not [name for name, plan in plans if "Broadcast" in plan]
    assert components.smallest_reachable(stars.limit(0)).count() == 0


def test_texts_without_crowds_are_not_held_against_a_reference(spark, monkeypatch):
    monkeypatch.setattr(simhash, "apart_alike", lambda *_: 1 / 0)
    long = " ".join(f"word{k}" for k in range(60))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, [long, long + " more", "another text", "another text"], [0, 1, 2, 3])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}
