"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import documents, empty, noisy

from tidemark.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20):
    own, theirs = [features(t) for _, t in docs], [features(t)[1] for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for f in theirs for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for k, ((i, _), (n, f)) in enumerate(zip(docs, own, strict=True)):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([k, i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is None, r[1] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[1], r[3], r[4], r[5], rank.get(r[0])) for r in rows), key=str)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op13_query(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ours(queries.op13_resample(spark, sf_dir)) == plain(rows, target)


def test_ranges_do_not_change_the_draw(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta é10".split()) for _ in range(rnd.randint(15, 60))) for _ in range(700)]
    df = documents(spark, texts, list(range(1000, 1700))).repartition(7)
    target = documents(spark, ["alpha beta gamma", "beta gamma delta eps", None], [0, 1, 2])
    right = plain(list(zip(range(1000, 1700), texts, strict=True)), ["alpha beta gamma", "beta gamma delta eps", None], percent=40)
    for range_rows in (3, 50, 4096):
        assert ours(resampling.resample(df, target, percent=40, range_rows=range_rows)) == right


def test_ties_repeats_and_null_ids(spark):
    text = " ".join(["same"] * 25)
    df = documents(spark, [text] * 40, [5] * 20 + [6] * 10 + [None] * 10)
    got = resampling.resample(df, df, percent=100, range_rows=4)
    ranks = sorted(r["rank"] for r in got.collect())
    assert ranks == list(range(1, 41))
    order = [r.doc_id for r in got.orderBy("rank").collect()]
    assert sorted(map(str, order)) == sorted(map(str, [5] * 20 + [6] * 10 + [None] * 10)) and len(set(order[:10])) == 1


def test_awkward_and_empty(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert ours(resampling.resample(df, df, percent=60)) == plain(rows, [t for _, t in rows], percent=60)
    assert resampling.resample(empty(spark), df).count() == 0
    none = resampling.resample(df, empty(spark)).collect()
    assert len(none) == len(rows) and all(r["rank"] is None for r in none)


def test_words():
    for text in noisy(200):
        assert [w.decode() for w in resampling.words_of(text.encode())] == WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 9, 40])
def test_tournament_merges_sorted_runs(runs):
    rnd = random.Random(runs)
    lists = [sorted((rnd.randrange(50), k, j) for j in range(rnd.randint(1, 30))) for k in range(runs)]
    blocks = sorted((x[i : i + 4] for x in lists for i in range(0, len(x), 4)), key=lambda b: b[0])
    right = sorted(e for x in lists for e in x)
    assert list(resampling.merge(iter(blocks), 10**9)) == right
    assert list(resampling.merge(iter(blocks), 7)) == right[:7]
