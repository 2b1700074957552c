"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .batches import map_texts, quoted

#: Training documents of each language, at most.
TRAIN_DOCS = 400
#: Symbols: the commonest folded bytes of the training texts have one each, all others share the last.
ALPHABET = 64
#: Longest context in symbols.
ORDER = 3
#: Text bytes scored at once.
SCORED_AT_ONCE = 1 << 20
UNKNOWN = "und"

# Folding: letters in lower case, each run of other ASCII as one space, so that digits and symbols say nothing.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(text: bytes) -> np.ndarray:
    """Bytes of ``text`` as read by the model, a space before and after."""
    raw = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    again = np.concatenate(([False], (raw[1:] == 32) & (raw[:-1] == 32)))
    return raw[~again]


@dataclass(frozen=True)
class Model:
    """Frozen context trees of all languages.

    ``bits3[c, l]`` is the code length of symbol d after symbols a b, for c = (a, b, d), from contexts of two symbols and shorter; ``escape[c, l]`` is that of leaving the context c of three symbols (0 if it never occurred); ``bits4`` has a row for each sequence of four symbols that occurred, numbered by ``rows`` (0: none did), not a number for languages in which it didn't. For look-up ``rows`` has a line of symbols for each context of three that occurred, numbered by ``lines`` (0: an empty line).
    """

    languages: tuple[str, ...]
    symbols: np.ndarray
    bits3: np.ndarray
    escape: np.ndarray
    rows: np.ndarray
    bits4: np.ndarray
    lines: np.ndarray | None = None

    def code_lengths(self, text: bytes) -> tuple[np.ndarray, int]:
        """Bits that each language's tree needs for the text, and the number of symbols coded."""
        s = self.symbols[folded(text)].astype(np.int64)
        total, n = np.zeros(len(self.languages)), len(s) - 1
        s = np.concatenate(([s[0]] * ORDER, s[1:]))
        for at in range(0, n, SCORED_AT_ONCE):
            part = s[at : min(n, at + SCORED_AT_ONCE) + ORDER]
            context = (part[:-3] * ALPHABET + part[1:-2]) * ALPHABET + part[2:-1]
            lower = self.bits3[(part[1:-2] * ALPHABET + part[2:-1]) * ALPHABET + part[3:]]
            total += (self.escape[context] + lower).sum(axis=0, dtype=np.float64)
            row = self.rows[self.lines[context] * ALPHABET + part[3:]]
            seen = np.flatnonzero(row)
            exact = self.bits4[row[seen]]
            total += np.where(np.isnan(exact), 0, exact - self.escape[context[seen]] - lower[seen]).sum(axis=0, dtype=np.float64)
        return total, n


def _grams(s: np.ndarray, k: int) -> np.ndarray:
    code = np.zeros(len(s) - k + 1, dtype=np.int64)
    for i in range(k):
        code = code * ALPHABET + s[i : len(s) - k + 1 + i]
    return code


def fit(samples: list[tuple[str, bytes]]) -> Model:
    """Context trees by method C: a context seen n times with q distinct symbols gives a symbol seen c times c / (n + q), and leaving it q / (n + q); at the end all symbols are alike."""
    languages = tuple(sorted({x for x, _ in samples}))
    texts = {x: [folded(t) for y, t in samples if y == x] for x in languages}
    counts = np.zeros(256, dtype=np.int64)
    for x in languages:
        for t in texts[x]:
            counts += np.bincount(t, minlength=256)
    symbols = np.full(256, ALPHABET - 1, dtype=np.uint8)
    for k, byte in enumerate(sorted(range(256), key=lambda b: (-counts[b], b))[: ALPHABET - 1]):
        symbols[byte] = k
    size = ALPHABET**3
    bits3, escape, sparse = np.zeros((size, len(languages)), dtype=np.float32), np.zeros((size, len(languages)), dtype=np.float32), []
    for i, x in enumerate(languages):
        coded = [symbols[t] for t in texts[x]]
        coded = [np.concatenate(([t[0]] * ORDER, t[1:])).astype(np.int64) for t in coded]
        p = np.full(ALPHABET, 1 / ALPHABET)
        for k in (1, 2, 3):
            c = np.zeros((ALPHABET ** (k - 1), ALPHABET))
            for t in coded:
                if len(t) > ORDER:
                    c += np.bincount(_grams(t[ORDER - k + 1 :], k), minlength=ALPHABET**k).reshape(c.shape)
            n, q = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            lower = np.tile(p.reshape(-1, ALPHABET), (len(c) // p.reshape(-1, ALPHABET).shape[0], 1))
            leave = np.where(n > 0, q / np.maximum(n + q, 1), 1)
            p = np.where(c > 0, c / np.maximum(n + q, 1), leave * lower)
        bits3[:, i] = -np.log2(p.reshape(-1))
        grams = [_grams(t, 4) for t in coded if len(t) > ORDER]
        gram, c = np.unique(np.concatenate(grams) if grams else np.zeros(0, dtype=np.int64), return_counts=True)
        n, q = np.bincount(gram // ALPHABET, c, size), np.bincount(gram // ALPHABET, minlength=size)
        escape[:, i] = np.where(n > 0, -np.log2(np.maximum(q, 1) / np.maximum(n + q, 1)), 0)
        sparse.append((gram, -np.log2(c / (n + q)[gram // ALPHABET])))
    every = np.unique(np.concatenate([g for g, _ in sparse])) if sparse else np.zeros(0, dtype=np.int64)
    bits4 = np.full((len(every) + 1, len(languages)), np.nan, dtype=np.float32)
    for i, (gram, bits) in enumerate(sparse):
        bits4[np.searchsorted(every, gram) + 1, i] = bits
    return Model(languages, symbols, bits3, escape, every, bits4)


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """A model from whole texts of at most ``most`` documents of each language, those of the smallest hashes of their ids.

    Rows with a null text or language are left out; with no rows left the model has no language and finds UNKNOWN everywhere.
    """
    ids = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("__lang"), F.xxhash64(F.lit("ppm"), F.col(id_col)).alias("__hash")).agg(F.min(id_col).alias("__id"))
    # the smallest hashes of each part first, so that no language meets in one task as a whole
    part = W.partitionBy("__lang", "__part").orderBy("__hash", "__id")
    whole = W.partitionBy("__lang").orderBy("__hash", "__id")
    few = ids.withColumn("__part", F.pmod("__hash", F.lit(64))).withColumn("__at", F.row_number().over(part)).where(F.col("__at") <= most)
    few = few.withColumn("__at", F.row_number().over(whole)).where(F.col("__at") <= most).select(F.col("__id").alias(id_col), F.col("__lang"))
    rows = labelled.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias("__text"), F.col(quoted(lang_col)).alias("__own")).join(F.broadcast(few), id_col).where("__own = __lang")
    return fit(sorted((r["__lang"], r["__text"].encode()) for r in rows.select("__lang", "__text").collect()))


class Scorer:
    """A model with its sequences of four symbols laid out for look-up."""

    def __init__(self, model: Model):
        contexts = np.unique(model.rows // ALPHABET)
        lines = np.zeros(ALPHABET**3, dtype=np.int64)
        lines[contexts] = np.arange(1, len(contexts) + 1)
        rows = np.zeros((len(contexts) + 1) * ALPHABET, dtype=np.int32)
        rows[lines[model.rows // ALPHABET] * ALPHABET + model.rows % ALPHABET] = np.arange(1, len(model.rows) + 1)
        self.model = Model(model.languages, model.symbols, model.bits3, model.escape, rows, model.bits4, lines)

    def __call__(self, texts: list[bytes]) -> list:
        found, scores, rates = [], [], []
        for text in texts:
            if not self.model.languages or not has_letter(text):
                found.append(UNKNOWN)
                scores.append(0.0)
                rates.append(0.0)
                continue
            bits, n = self.model.code_lengths(text)
            best = int(bits.argmin())
            found.append(self.model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            rates.append(float(bits[best] / max(n, 1)))
        return [found, scores, rates]


def has_letter(text: bytes) -> bool:
    if text.lower() != text.upper():  # an ASCII letter
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``lang_pred``, ``score`` (the language's posterior under equal priors, 0 to 1) and ``bits_per_symbol`` of every whole text.

    Texts that are null or have no letter get UNKNOWN and 0; ties go to the first language in order.
    """
    fields = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("bits_per_symbol", T.DoubleType(), pa.float64())]
    return map_texts(df, lambda: Scorer(model), fields, text_col, (id_col, *keep))
