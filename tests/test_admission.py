"""Admission: what leads bring together, and the nearest text that is told, with rounds for crowds and without."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission, text


def sketched(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, t string")
    return rows.select("node", F.struct("node").alias("place"), text.bottom_sketch(F.col("t")).alias("sketch"))


def test_a_passage_of_many_texts_makes_no_candidates(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(60)) + f" {passage} " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(60)) for _ in range(60)]
    leads = admission._leads(sketched(spark, texts), 0.85).groupBy("key").count()
    assert leads.agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("common", [1, 4, 1000])
def test_leads_lose_no_pair(spark, monkeypatch, common):
    monkeypatch.setattr(admission, "COMMON", common)
    rnd = random.Random(6)
    texts = []
    for n in (9, 12, 30, 90, 300):
        base = [f"v{rnd.randrange(10**9)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(12):
            some = list(base)
            for _ in range(rnd.choice((1, 1, 2, 3))):
                some[rnd.randrange(n)] = f"v{rnd.randrange(10**9)}"
            texts.append(" ".join(some[rnd.randrange(3) : n - rnd.randrange(3)]))
    nodes = sketched(spark, texts)
    by = {r.node: r.sketch for r in nodes.collect()}
    plain = set()
    for a in by:
        for b in range(a + 1, len(texts)):
            union = sorted({*by[a], *by[b]})[: max(len(by[a]), len(by[b]))]
            if union and len([h for h in union if h in by[a] and h in by[b]]) / len(union) >= 0.85:
                plain.add((a, b))
    leads = admission._leads(nodes, 0.85)
    assert len(plain) > 40
    assert {(r.a, r.b) for r in admission._edges(leads, leads, nodes, 0.85, 128).collect()} == plain


@pytest.mark.parametrize("full", [64, 4])
@pytest.mark.parametrize("long_text", [150_000, 700])
def test_the_nearest_is_the_likest_admitted_before(spark, monkeypatch, full, long_text):
    monkeypatch.setattr(admission, "FULL", full)
    rnd = random.Random(7)
    texts = []
    for n in (40, 110, 160):
        base = [f"v{rnd.randrange(10**9)}" for _ in range(n)]
        for _ in range(40):
            some = list(base)
            for _ in range(rnd.choice((1, 1, 2, 3))):
                some[rnd.randrange(n)] = f"v{rnd.randrange(10**9)}"
            texts.append(" ".join(some))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    by = {r.node: r.sketch for r in sketched(spark, texts).collect()}
    plain, kept = [], []
    for i, t in enumerate(texts):
        best = (0.0, None)
        for k in kept:
            union = sorted({*by[i], *by[k]})[: max(len(by[i]), len(by[k]))]
            score = len([h for h in union if h in by[i] and h in by[k]]) / len(union)
            best = (score, k) if score >= 0.85 and score > best[0] else best
        if best[1] is None or len(t) > long_text:
            kept.append(i)
        plain.append((i, i in kept[-1:], best[1], round(best[0], 9)))
    got = admission.admit(df, "id", "t", [], long_text=long_text).collect()
    assert sorted((r.id, r.admitted, r.nearest, round(r.score or 0.0, 9)) for r in got) == plain
