import math
import re

import numpy as np
import pytest
from helpers import documents, empty

from tidemark.llm import boosting, doc_stats, language, quality, queries


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_ones():
    for text in ["", " \n ", "a b c d e a b c d e", "a a a a a a", "x\nx\n \ny\nx ", "é|é <b>\x0b*", "a b c d e f\n" * 3, "1 2 3 4 5 6 1 2 3 4 5"]:
        assert tuple(doc_stats.statistics([text.encode()])[0][0]) == plain_counts(text), text


def test_op6(spark, sf_dir, texts):
    got = queries.op6_quality_rules(spark, sf_dir).toPandas().set_index("doc_id")
    for doc, text in zip(texts.doc_id, texts.text, strict=True):
        if len(text or "") < 4000:
            row, want = got.loc[doc], plain_counts(text)
            assert tuple(int(row[c]) for c in doc_stats.BASE) == want
            assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert not got[got.base_failed].kept.any() and got.kept.mean() > 0.5


def test_op10_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op10_quality(spark, big).toPandas()
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.9
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_monotone_columns_never_raise_the_score():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] + np.sin(4 * x[:, 1]) + rng.normal(size=2000) * 0.3) > 0).astype(float)
    free, bound = boosting.fit(x, y), boosting.fit(x, y, monotone={1: -1})
    grid = np.repeat(x[:100], 50, axis=0)
    grid[:, 1] = np.tile(np.linspace(-3, 3, 50), 100)
    assert np.diff(free.margin(grid).reshape(100, 50), axis=1).max() > 0.1
    assert np.diff(bound.margin(grid).reshape(100, 50), axis=1).max() <= 1e-9
    assert (bound.margin(x) == bound.margin(x.copy())).all() and ((free.probability(x) > 0.5) == (y > 0)).mean() > 0.9


@pytest.mark.parametrize("labels", [[], [1.0] * 30])
def test_forest_without_labels_or_with_one_class(labels):
    forest = boosting.fit(np.zeros((len(labels), 2)), np.array(labels))
    p = forest.probability(np.zeros((3, 2)))
    assert (p == 0.5).all() if not labels else (p > 0.9).all()


def test_quality_awkward_rows(spark):
    rows = documents(spark)
    labels = spark.createDataFrame([(0, 1), (5, 1), (7, 0), (8, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit_quality(rows, labels)
    assert quality.classify(rows, model).count() == quality.apply_rules(rows, model).count() == rows.count()
    assert quality.document_statistics(empty(spark)).count() == quality.classify(empty(spark), model).count() == 0
    assert quality.fit_quality(empty(spark), labels.limit(0)).probability(np.zeros((1, 16)))[0] == 0.5


def plain_bits(samples, text, lang):
    """Code length by the definition: dictionaries of counts, the longest context first."""
    model = language.fit(samples)
    code = lambda t: model.symbols[language.folded(t)].tolist()
    counts = {}
    for x, t in samples:
        if x == lang:
            s = code(t)
            s = [s[0]] * 3 + s[1:]
            for i in range(3, len(s)):
                for k in range(4):
                    counts.setdefault(tuple(s[i - k : i]), {}).setdefault(s[i], 0)
                    counts[tuple(s[i - k : i])][s[i]] += 1
    s = code(text)
    s = [s[0]] * 3 + s[1:]
    total = 0.0
    for i in range(3, len(s)):
        p = 1.0
        for k in (3, 2, 1, 0):
            seen = counts.get(tuple(s[i - k : i]))
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if s[i] in seen:
                p *= seen[s[i]] / (n + q)
                break
            p *= q / (n + q)
        else:
            p /= language.ALPHABET
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact():
    samples = [("a", b"the cat sat on the mat"), ("a", b"that hat"), ("b", "über öde höhen".encode()), ("b", b"")]
    scorer = language.Scorer(language.fit(samples))
    for text in (b"the hat", "öde katze über".encode(), b"q", b"zzzz 123 the"):
        bits, _ = scorer.model.code_lengths(text)
        for k, lang in enumerate(("a", "b")):
            assert bits[k] == pytest.approx(plain_bits(samples, text, lang), rel=1e-5)


def test_op5_held_out(spark, sf_dir, docs):
    got = queries.op5_language(spark, sf_dir).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 40 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_awkward_rows(spark):
    rows = documents(spark)
    model = language.fit_languages(rows)
    got = {r.doc_id: r for r in language.predict(rows, model, keep=("score",)).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and got[17].lang_pred == "und" and got[3].lang_pred in ("de", "en")
    assert got[12].lang_pred != "und"
    none = language.fit_languages(empty(spark))
    assert {r.lang_pred for r in language.predict(rows, none).collect()} == {"und"}
