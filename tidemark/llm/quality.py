"""Quality classifier and quality rules: boosted trees over statistics of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, quoted
from .boosting import Forest, fit
from .doc_stats import BASE, FEATURES, statistics
from .labelled import bounded_sample

#: Labelled rows that a model is fitted on, at most (see bounded_sample).
TRAIN_ROWS = 20_000
#: Of the rules' model: more of these may only lower the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "doubled_share")


def _features() -> list:
    return [*((c, T.LongType(), pa.int64()) for c in BASE), ("features", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))]


def _measure(texts: list[bytes]) -> list:
    base, features = statistics(texts)
    return [*base.T, list(features)]


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts BASE and the array ``features`` (FEATURES) of every whole text; null and empty texts have zeros."""
    return map_texts(df, lambda: _measure, _features(), text_col, (id_col,))


def fit_quality(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS, monotone: tuple[str, ...] = (), **options) -> Forest:
    """A forest for ``label_col`` (0 or 1; null labels and ids are left out), fitted on at most about ``most`` labelled documents.

    The labels' sample is bounded, so it is broadcast and its statistics come to the driver. Without labels the forest scores one half.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("double").alias("__label"))
    chosen = bounded_sample(known, id_col, most)
    texts = documents.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias(text_col)).join(F.broadcast(chosen), id_col)
    # in the order of ids, so that sums of gradients and thus ties fall alike in any run
    rows = map_texts(texts, lambda: _measure, _features(), text_col, (id_col, "__label")).select(id_col, "__label", "features").toPandas().sort_values([id_col, "__label"], kind="stable")
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["__label"].to_numpy(dtype=np.float64), monotone={FEATURES.index(c): -1 for c in monotone}, **options)


def classify(df: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``score`` (0 to 1, higher: better) and ``predicted`` (1 if score >= at_least) of every whole text.

    Null, empty and blank texts have zero statistics and their score.
    """

    def kernel(texts: list[bytes]) -> list:
        score = model.probability(statistics(texts)[1])
        return [score, (score >= at_least).astype(np.int32)]

    return map_texts(df, lambda: kernel, [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())], text_col, (id_col, *keep))


def apply_rules(df: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``id_col``, the counts BASE, ``base_failed``, ``score`` and ``kept`` of every whole text.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: false if base_failed, else whether the model's score, monotone in the columns FALLING when fitted so, is ``at_least``. Null and empty texts have no words and fail.
    """

    def kernel(texts: list[bytes]) -> list:
        base, features = statistics(texts)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        score = model.probability(features)
        return [*base.T, failed, score, ~failed & (score >= at_least)]

    fields = [*((c, T.LongType(), pa.int64()) for c in BASE), ("base_failed", T.BooleanType(), pa.bool_()), ("score", T.DoubleType(), pa.float64()), ("kept", T.BooleanType(), pa.bool_())]
    return map_texts(df, lambda: kernel, fields, text_col, (id_col,))
