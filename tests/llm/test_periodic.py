"""Runs of words against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, empty

from tidemark.llm import periodic, queries


def plain_runs(words):
    n, found, covered = len(words), [], set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(6, 4 * p):
                inner = words[i : i + length]
                if not any(inner[q:] == inner[: length - q] for q in range(1, p)):
                    found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = (h // 10) % len(words)
            p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *told, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(kept))


def made(seed):
    rnd = random.Random(seed)
    words, letters = [], rnd.randint(1, 4)
    for _ in range(rnd.randint(0, 5)):
        words += [bytes([97 + rnd.randrange(letters)]) for _ in range(rnd.randint(1, 7))] * rnd.choice([1, 2, 4, 5, 7])
    return words * rnd.choice([1, 1, 1, 4])


def test_random_words_in_batches():
    for seed in range(0, 1200, 6):
        texts = [made(seed + k) for k in range(6)]
        for words, runs in zip(texts, periodic.runs_of_texts(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_lower_bounds_on_periods():
    for seed in range(200):
        words = made(seed)
        for least in (2, 3):
            runs = periodic.runs_of_texts([words], 2, least)[0].tolist()
            assert all(n >= least * p and words[s : s + n - p] == words[s + p : s + n] for s, n, p in runs)
            assert {tuple(r) for r in plain_runs(words)} <= {tuple(r) for r in runs}


def test_one_long_run_and_one_long_text():
    (runs,) = periodic.runs_of_texts([[b"a", b"b", b"c"] * 100_000])
    assert runs.tolist() == [[0, 300_000, 3]]
    words = [b"%d" % k for k in range(200_000)]
    (runs,) = periodic.runs_of_texts([words + [b"x"] * 9 + words])
    assert runs.tolist() == [[200_000, 9, 1]]


def test_common_prefixes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 2, 300)
    ends = np.full(300, 300)
    levels = periodic.suffix_ranks(symbols, ends)
    order = sorted(range(300), key=lambda i: symbols[i:].tolist())
    assert np.argsort(levels[-1]).tolist() == order
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    a, b = a[a != b], b[a != b]
    got = periodic.CommonPrefixes(levels[-1], periodic.neighbour_prefixes(levels))(a, b)
    for i, j, n in zip(a, b, got, strict=True):
        same = 0
        while max(i, j) + same < 300 and symbols[i + same] == symbols[j + same]:
            same += 1
        assert same == n


@pytest.mark.parametrize("plant", [False, True])
def test_awkward_rows(spark, plant):
    df = documents(spark)
    got = sorted((tuple(r) for r in periodic.find_runs(df, plant=plant).collect()), key=str)
    assert got == sorted((plain_row(r.doc_id, r.text, plant) for r in df.collect()), key=str)
    assert len(got) == len(AWKWARD) + 2


def test_spans_and_empty(spark):
    df = documents(spark, ["a b a b a b a b end", None], [0, 1])
    first, second = sorted(periodic.find_runs(df, spans=True).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in first.runs] == [(0, 8, 2)] and first.collapsed == "a b end"
    assert second.runs == [] and second.collapsed == "" and second.length is None
    assert periodic.find_runs(empty(spark)).count() == 0


def test_op12_query(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.op12_runs(spark, sf_dir).collect())
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    for r in rows:
        if len((r.text or "").split()) < 3000:
            assert by_id[r.doc_id] == plain_row(r.doc_id, r.text)
