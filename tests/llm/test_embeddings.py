"""Embedding near-dedup against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hamming, queries


def plain(rows, cosine=0.9):
    """(id, vector) rows to (id, n_links, component, kept), by all pairs."""
    fine = [None if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, dtype=np.float64) for _, v in rows]
    unit = [None if v is None else (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for v in fine]
    links = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= cosine] for i, x in enumerate(unit)]
    root = list(range(len(rows)))
    for start in range(len(rows)):
        seen, todo = {start}, [start]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[start] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((i, len(n), r, (i is not None and i == r) or unit[k] is None) for k, ((i, _), n, r) in enumerate(zip(rows, links, root, strict=True))), key=str)


def ours(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cosine string, n int")
    return sorted((tuple(r) for r in hamming.near_vectors(df, **more).collect()), key=str)


def near(rng, v, cosine):
    away = rng.standard_normal(len(v))
    away -= (away @ v) * v
    return cosine * v + math.sqrt(1 - cosine * cosine) * away / np.linalg.norm(away)


@pytest.fixture(scope="module")
def crowd():
    """Random vectors, pairs, a tight and a loose crowd, exact copies and chains."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    made = [*base, *(near(rng, v, c) for v, c in zip(base[:100], rng.uniform(0.9, 0.999, 100), strict=True))]
    made += [near(rng, base[150], c) for c in rng.uniform(0.985, 1, 150)] + [near(rng, base[151], 0.955) for _ in range(150)] + [near(rng, base[150], 0.91) for _ in range(20)]
    made += [base[5] * 3.0, base[5], base[6], base[6]]
    return [(i * 7 % 1009, v.tolist()) for i, v in enumerate(made)]


def test_links_counts_and_classes_of_crowds(spark, crowd):
    found, right = ours(spark, crowd), plain(crowd)
    a, b = ({r[0]: r for r in x} for x in (found, right))
    links = sum(r[1] for r in b.values())
    assert all(a[i][1] <= b[i][1] for i in b) and sum(r[1] for r in a.values()) >= 0.97 * links
    assert sum(a[i][2] == b[i][2] for i in b) >= 0.97 * len(b)
    assert all(r[3] == (r[0] == r[2]) for r in found)


def test_crowds_are_made_without_pairs(spark, crowd):
    df = spark.createDataFrame([(i, v) for i, v in crowd], "vec_id long, embedding array<double>")
    rows = hamming.units(df).where("__unit is not null").groupBy(F.col("__unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("least"))
    vectors = rows.select(F.xxhash64("unit").alias("node"), "unit", "n", "least")
    found = hamming.coded(vectors, hamming.fit(vectors, 0.9)).cache()
    joined = hamming.crowds(found, 0.9)
    assert joined.count() >= 250
    assert joined.where("cosine < 0.9").count() == 0
    assert joined.groupBy("node").count().where("count > 1").count() == 0


def test_awkward_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [1.0, 0.01, 0.0])]
    rows += [(None, [1.0, 0.0, 0.001]), (9, [1.0, 0.01, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0, 0.0]), (12, [1e300, 1e300, 0.0]), (13, [1e-300, 1e-300, 0.0]), (14, [-0.0, 1.0, 0.0]), (15, [0.0, 1.0, 0.0])]
    assert ours(spark, rows) == plain(rows)


def test_empty_one_and_only_unusable(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(4, [0.5, 0.5])]) == [(4, 0, 4, True)]
    assert ours(spark, [(4, None), (5, [0.0])]) == [(4, 0, 4, True), (5, 0, 5, True)]
    with pytest.raises(ValueError):
        ours(spark, [], cosine=0.4)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_few_dimensions(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, size)))]
    found, right = ours(spark, rows), plain(rows)
    assert sum(r[1] for r in found) >= 0.95 * sum(r[1] for r in right)


def test_codes_are_balanced_and_rotations_orthogonal():
    rng = np.random.default_rng(0)
    sample = rng.standard_normal((2000, 48)) * np.linspace(0.3, 2, 48)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    codes = hamming.Codes(sample, 100_000, 0.9)
    for r in codes.rotations:
        assert np.allclose(r @ r.T, np.eye(48))
    _, code = codes(sample)
    bits = np.unpackbits(code.astype(">i8").view(np.uint8).reshape(len(sample), -1), axis=1)[:, :48]
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.01
    assert codes.tables > 0 and codes.width >= 10


def test_recall_at_the_threshold(spark):
    """Pairs of just 0.9 to 0.92 among many others: the hardest that count."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *(near(rng, v, c) for v, c in zip(base[:500], rng.uniform(0.9001, 0.92, 500), strict=True))])]
    assert sum(r[1] for r in ours(spark, rows)) >= 0.93 * sum(r[1] for r in plain(rows))


def test_op11_query(spark, sf_dir):
    got = sorted((tuple(r) for r in queries.op11_hamming(spark, sf_dir).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == plain(rows)
