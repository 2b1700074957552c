"""Small tables with all the awkward rows."""

from __future__ import annotations

import random

AWKWARD = [
    None, "", " \n\t ", "a", "Word", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten",
    "x" * 5000, "the same line\nthe same line\nthe same line\n", "é è ü ñ ça vaut où naïve", "\x0b \x85\xa0 odd　spaces here", "<|endoftext|> is text <|startoftext|>",
    "ΑΣ İ ẞ ŉ 漢字 👍🏽", "it's we'll 'S they're", "!!! ### $$$ | | |", "word " * 3000, "tab\tnew\r\nline", "1234 567 ½ ²",
]


def documents(spark, texts=None, ids=None):
    """The awkward texts, with a null id, a repeated row and columns whose names operators use too."""
    texts = AWKWARD if texts is None else texts
    rows = [(i if ids is None else ids[i], t, ["en", "de", None][i % 3], f"src{i % 2}", len(t or ""), 0.5, "mine", 7) for i, t in enumerate(texts)]
    if ids is None:
        rows += [rows[5], (None, "no id here at all", "en", "src0", 17, 0.5, "mine", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, n int")


def empty(spark):
    return documents(spark, [], [])


def noisy(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab c\n\t'sdt.!é  Σ0²<|>\xa0") for _ in range(rnd.randint(0, 80))) for _ in range(n)]
