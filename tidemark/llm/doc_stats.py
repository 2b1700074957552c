"""Statistics of whole texts, for quality rules and classifiers."""

from __future__ import annotations

import numpy as np

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: Counts that quality rules report.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Inputs of the models, all shares or logarithms, so that a text and its double score alike.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "non_ascii_share", "mark_share",
    "dup_line_share", "repeat_share", "doubled_share", "distinct_share", "words_per_line", "long_word_share", "stop_share", "pipe_share",
)

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_CLASSES = np.stack([
    ~_SPACE & ~_CONTINUED,  # code points in words
    np.isin(np.arange(256), list(SYMBOLS)),
    (np.arange(256) >= 65) & (np.arange(256) <= 90),
    (np.arange(256) >= 48) & (np.arange(256) <= 57),
    np.isin(np.arange(256), list(b".,;:?'\"-")),
    np.arange(256) >= 0xC0,
    np.isin(np.arange(256), list(b"!")),
    np.isin(np.arange(256), list(b".?")),
    np.isin(np.arange(256), list(b"|")),
]).astype(np.float64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in some window of ``width`` words found twice or more, the first find included.

    Windows are numbered exactly, by numbering pairs of numbers, so that no hash can mistake one for another.
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    window = ids
    for k in range(1, width):
        m = n - k
        _, window = np.unique(window[:m] * n + ids[k:], return_inverse=True)
    often = np.bincount(window)[window] > 1
    covered = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BASE counts (long) and FEATURES (double), a row for each text."""
    base = np.zeros((len(texts), len(BASE)), dtype=np.int64)
    features = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        n = len(words)
        chars, symbols, upper, digits, punct, non_ascii, marks, stops, pipes = _CLASSES @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
        repeated = repeated_words(words)
        base[i] = n, chars, symbols, dup, repeated
        if n:
            doubled = sum(map(bytes.__eq__, words, words[1:]))
            features[i] = (
                np.log1p(n), chars / n, symbols / chars, upper / chars, digits / chars, punct / chars, non_ascii / chars, marks / chars,
                dup / len(lines), repeated / n, doubled / n, len(set(words)) / n, n / len(lines), sum(len(w) > 20 for w in words) / n, stops / n, pipes / n,
            )
    return base, features
