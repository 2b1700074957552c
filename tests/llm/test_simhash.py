import random

import numpy as np

import xxhash
from helpers import documents, empty
from pyspark.sql import functions as F

from tidemark.llm import queries, simhash
from tidemark.operators.components import smallest_reachable


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items):
    """Smallest id reachable over links of 2 bits, by comparing all pairs."""
    root = {k: k for k, _ in items}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in items}


def test_op7_against_all_pairs(spark, sf_dir, texts):
    got = queries.op7_simhash(spark, sf_dir).toPandas().set_index("doc_id")
    marks = [(d, plain(t)) for d, t in zip(texts.doc_id, texts.text, strict=True)]
    assert {d: int(f, 16) for d, f in got.fingerprint.items()} == dict(marks)
    assert got.component_id.to_dict() == classes(marks)


def values(spark, marks):
    rows = [(k, m - (1 << 64) if m >> 63 else m) for k, m in marks]
    return spark.createDataFrame(rows, "rep long, simhash long")


def test_links_in_sparse_and_crowded_buckets(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    marks = {centre} | {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(150):  # one dense cloud and chains out of it
        m = rnd.choice(sorted(marks))
        marks.add(m ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    for _ in range(80):
        marks.add(centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    marks = list(enumerate(sorted(marks)))
    want = classes(marks)
    for bucket in (2, 8, 1000):
        roots = {r.node: r.root for r in smallest_reachable(simhash.links(values(spark, marks), bucket)).collect()}
        assert {k: roots.get(k, k) for k, _ in marks} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (500, 501)], "a long, b long")
    got = {r.node: r.root for r in smallest_reachable(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {501: 500}


def test_a_text_without_id_joins_two_others(spark, monkeypatch):
    marks = {"a": 0b1, "b": 0b111, "c": 0b11111}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: df.select("doc_id", F.element_at(F.create_map(*(F.lit(x) for p in marks.items() for x in p)), F.col("text")).cast("long").alias("simhash")))
    rows = documents(spark, ["a", "b", "c"], [7, None, 3])
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(rows).collect()} == {(7, 3), (None, 3), (3, 3)}


def test_awkward_rows(spark):
    rows = documents(spark)
    got = simhash.near_duplicate_groups(rows).collect()
    assert len(got) == rows.count()
    blank = {r.component_id for r in got if r.simhash == 0}
    assert blank == {0}
    assert simhash.near_duplicate_groups(empty(spark)).count() == 0


def test_near_copies_are_measured(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 11)))
    base = [word() for _ in range(400)]
    changed = lambda n, at=base: [word() if i in rnd.sample(range(len(at)), n) else w for i, w in enumerate(at)]
    replaced = list(base)
    replaced[200] = "somethingelse"
    texts = [" ".join(base), " ".join(base), " ".join(replaced), " ".join(base[:200] + [word() for _ in range(200)]), " ".join(word() for _ in range(300)), None, "", "x", "x", " ".join(changed(0))]
    rows = documents(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 0}
    assert simhash.near_copies(empty(spark)).count() == 0


def test_near_copies_of_the_table(spark, sf_dir, texts):
    got = simhash.near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().set_index("doc_id").component_id
    sets = {d: set(simhash.shingle_set((t or "").encode(), 5)) for d, t in zip(texts.doc_id, texts.text, strict=True)}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    linked = [(a, b) for a, b in alike if got[a] == got[b]]
    assert len(linked) == len(alike)
    near = {d: {e for p in alike for e in p if d in p} | {d} for d in sets}
    for d in sets:  # no class without an alike member
        assert got[d] == d or any(got[e] == got[d] for e in near[d] - {d})


def test_near_copies_of_a_crowd_are_one(spark):
    """More near copies of one text than a bucket holds."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(4, 11)))
    base = [word() for _ in range(150)]
    texts = [" ".join(word() if i in rnd.sample(range(150), 1) else w for i, w in enumerate(base)) for _ in range(60)]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    near = [k for k in range(60) if np.intersect1d(sets[0], sets[k]).size >= 0.8 * np.union1d(sets[0], sets[k]).size]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, texts)).collect()}
    assert all(got[k] == 0 for k in near)


def joined(sets):
    """Smallest index reachable over likenesses of 0.8, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if np.intersect1d(sets[a], sets[b]).size >= 0.8 * np.union1d(sets[a], sets[b]).size:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in range(len(sets))}


def words_of(rnd, n):
    return ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(4, 11))) for _ in range(n)]


def test_copies_that_are_alike_to_their_original_only(spark):
    """A crowd whose members hang together by one text, beside texts that share half of it, and a crowd without an original."""
    rnd = random.Random(5)
    base, other = words_of(rnd, 150), words_of(rnd, 150)
    changed = lambda base, n: " ".join(words_of(rnd, 1)[0] if i in at else w for at in [rnd.sample(range(len(base)), n)] for i, w in enumerate(base))
    texts = [changed(base, 3) for _ in range(300)] + [" ".join(base)] + [changed(base, 3) for _ in range(299)]
    texts += [" ".join(base[:75] + words_of(rnd, 75)) for _ in range(30)] + [changed(other, k % 4 + 1) for k in range(60)]
    want = joined([simhash.shingle_set(t.encode(), 5) for t in texts])
    assert sum(want[k] == 0 for k in range(600)) > 550
    assert {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, texts, list(range(len(texts))))).collect()} == want


def test_all_copies_with_passages_added_cut_or_changed(spark):
    rnd = random.Random(9)
    texts = []
    for k in range(60):
        base = words_of(rnd, 150)
        texts += [" ".join(base), " ".join([base + words_of(rnd, 20 + k % 16), base[: 122 + k % 20], base[k % 25 :], [words_of(rnd, 1)[0] if i % 50 == 9 else w for i, w in enumerate(base)]][k % 4])]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    want = joined(sets)
    assert sum(want[k] != k for k in want) > 50
    assert {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, texts, list(range(len(texts))))).collect()} == want


def test_texts_held_against_a_reference(spark):
    """All that are alike are joined whichever text is the reference, and copies edited apart make few pairs."""
    rnd = random.Random(12)
    base = words_of(rnd, 150)
    edited = lambda at, n: [words_of(rnd, 1)[0] if i in rnd.sample(range(len(at)), n) else w for i, w in enumerate(at)]
    second = edited(base, 12)
    lists = [base, second, base[:110], base[30:], *(edited(base, k % 15) for k in range(60)), *(edited(second, k % 5) for k in range(30)), *(base[:100] + words_of(rnd, k) for k in range(40))]
    texts = [" ".join(x) for x in lists] + [" ".join(words_of(rnd, 40)), "one", ""]
    kept = simhash.keyed(documents(spark, texts, list(range(len(texts)))))
    rows = kept.select(F.col("doc_id").alias("__id"), "__row", "__copy", F.col("text").cast("binary").alias("__text"))
    table = simhash.distinct_texts(rows, 5)
    of_text = {r.id: r.node for r in table.select("first.id", "node").collect()}
    want = joined([simhash.shingle_set(texts[k].encode(), 5) for k in sorted(of_text) if texts[k]])
    worded = table.where("size > 0")
    for k in (0, 1, 70, len(texts) - 3):
        members = worded.select(F.lit(of_text[k]).alias("ref"), "node", F.col("node").alias("own"), F.lit(of_text[k]).alias("ref_own"))
        pairs = simhash.apart_alike(members, table, rows, 5, 0.8)
        assert k or pairs.count() < len(texts) ** 2 / 8
        roots = {r.node: r.root for r in smallest_reachable(simhash.alike(pairs, table, rows, 5, 0.8)).collect()}
        ids = [i for i in sorted(of_text) if texts[i]]
        got = [roots.get(of_text[i], of_text[i]) for i in ids]
        assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(len(ids)) for b in range(a))
