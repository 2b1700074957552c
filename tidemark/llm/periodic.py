"""Periodic runs of words by the runs theorem: Lyndon roots from next-smaller values, extended over a sparse table of longest common prefixes."""

from __future__ import annotations

from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, quoted

#: A run has so many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, until all differ.

    ``symbols`` (from 0) holds several texts one after another and ``ends`` the end of the text of each place; a suffix goes to the end of its text, and suffixes of different texts never have one rank. A rank is the number of smaller suffixes. Only suffixes that still share a rank are sorted again.
    """
    n = len(symbols)
    if not n:
        return [np.zeros(0, dtype=np.int64)]
    key = ends.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = first
    levels, open_ = [ranks], order[~(new & np.r_[new[1:], True])]
    step = 1
    while len(open_):
        after = open_ + step
        second = np.full(len(open_), -1, dtype=np.int64)
        inside = after < ends[open_]
        second[inside] = ranks[after[inside]]
        key = ranks[open_] * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = ranks[open_]
        group = np.r_[True, np.diff(old) != 0]
        new = np.r_[True, np.diff(key) != 0]
        place = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(group, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        ranks = ranks.copy()
        ranks[open_] = old + first - start
        levels.append(ranks)
        open_ = open_[~(new & np.r_[new[1:], True])]
        step *= 2
    return levels


def neighbour_prefixes(levels: list[np.ndarray]) -> np.ndarray:
    """For each place of the suffix array, the common prefix with the suffix before: descending steps, each taken where the ranks by so many symbols agree."""
    n = len(levels[-1])
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[levels[-1]] = np.arange(n)
    length = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(np.r_[False, levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]])
    a, b = suffixes[at - 1], suffixes[at]
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + length[at], b + length[at]
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        length[at[same]] += 1 << k
    return length


class CommonPrefixes:
    """Common prefixes of any two suffixes: the least neighbour prefix between their ranks, by a sparse table. Powers are made when a question first needs them."""

    def __init__(self, ranks: np.ndarray, lengths: np.ndarray):
        self.ranks, self.table = ranks, [lengths]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of suffixes ``a`` and ``b``, which must differ pairwise."""
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        x, y = self.ranks[a], self.ranks[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        power = np.frexp((high - low).astype(np.float64))[1] - 1
        while len(self.table) <= power.max():
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))
        found = np.empty(len(a), dtype=np.int64)
        for p in np.unique(power):
            at = power == p
            found[at] = np.minimum(self.table[p][low[at]], self.table[p][high[at] - (1 << p)])
        return found


def next_beyond(ranks: np.ndarray, ends: np.ndarray, smaller: bool) -> np.ndarray:
    """For each place the next one of its text with a smaller (greater) rank, or the text's end. Places skip over what is known to lie between, so that steps double."""
    value = ranks if smaller else -ranks
    at, todo = np.arange(1, len(ranks) + 1), np.arange(len(ranks))
    while len(todo):
        todo = todo[at[todo] < ends[todo]]
        todo = todo[value[at[todo]] > value[todo]]
        at[todo] = at[at[todo]]
    return at


def runs_of(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of at least ``least_words`` symbols and ``least_periods`` (2 or more) periods, by start and period.

    ``starts`` and ``ends`` are those of the text of each place. The longest Lyndon word that begins at a place ends at the next smaller suffix, by either order of symbols (the inverse order of symbols inverts the ranks); the root of every run that lies first in it is such a word under one of the orders. A word whose own length of symbols does not repeat often enough is no such root. Roots are extended to the right by a common prefix, to the left by halving over common prefixes, for less than one period: beyond, an earlier root of the same run does it.
    """
    if not len(symbols):
        return np.zeros((0, 3), dtype=np.int64)
    levels = suffix_ranks(symbols, ends)
    ranks = levels[-1]
    pairs = []
    for smaller in (True, False):
        after = next_beyond(ranks, ends, smaller)
        at = np.flatnonzero(after < ends)
        pairs.append((at, after[at]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    like = symbols[a] == symbols[b]
    fits = a + least_periods * (b - a) - (b - a) + 1 <= ends[a]
    a, b = a[like & fits], b[like & fits]
    if not len(a):
        return np.zeros((0, 3), dtype=np.int64)
    common = CommonPrefixes(ranks, neighbour_prefixes(levels))
    right = common(a, b)
    period = b - a
    far = right >= (least_periods - 2) * period
    a, b, right, period = a[far], b[far], right[far], period[far]
    low, high = np.zeros(len(a), dtype=np.int64), np.minimum(period, a - starts[a])
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo] + 1) // 2
        holds = common(a[todo] - middle, b[todo] - middle) >= middle
        low[todo[holds]] = middle[holds]
        high[todo[~holds]] = middle[~holds] - 1
    start, length = a - low, low + period + right
    whole = (low < period) & (length >= np.maximum(least_words, least_periods * period))
    found = np.unique(np.stack([start[whole], period[whole], length[whole]], axis=1), axis=0)
    return found[:, [0, 2, 1]]


def runs_of_texts(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """``runs_of`` each of several texts of words, in one go; starts count from the text's first word."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(texts)), dtype=np.int64, count=int(sizes.sum()))
    last = np.cumsum(sizes)
    found = runs_of(symbols, np.repeat(last - sizes, sizes), np.repeat(last, sizes), least_words, least_periods)
    cuts = np.searchsorted(found[:, 0], np.r_[0, last])
    return [found[i:j] - np.array([size, 0, 0]) for i, j, size in zip(cuts[:-1], cuts[1:], (last - sizes).tolist(), strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay if each run keeps its first period only; a word that any run drops goes."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def longest_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """(start, length, period) of the greatest length; of equal ones the smallest start, then period."""
    if not len(runs):
        return None
    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    return start, length, period


def made_periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words of a document with a tail that repeats some words of it, by a rule of ``h``, the crc32 of its id, if that ends in 0; else as they are."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    root = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * ((n - a) // len(root) + 1))[: n - a]


_LONGS = ("n_runs", "start", "length", "period", "exponent_milli")


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, spans: bool = False) -> DataFrame:
    """``id_col``, ``n_runs``, ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run, ``runs_sha256``, ``collapsed_sha256`` and, with ``spans``, ``runs`` (an array of start, length, period) and ``collapsed`` (the text with every run cut to its first period, words joined by one space).

    Words are what ASCII white space parts. A null, empty or blank text has no words and no run, and the hashes of empty bytes. Whole texts are looked at, in memory of about 150 bytes a word and doubling of the longest repeated passage. ``plant`` first gives a tenth of the documents a periodic tail (``made_periodic``; a null id: none). Repeated rows keep their number; other columns are not read; an empty table gives no rows.
    """
    source = df.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text")) if text_col != id_col else df.withColumn("__text", F.col(quoted(text_col)))
    if plant:
        source = source.withColumn("__text", F.concat(F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")).cast("string"), F.lit("")).cast("binary"), F.lit(b"\n"), F.coalesce(F.col("__text").cast("binary"), F.lit(b""))))
    row = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    arrow_row = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    fields = [(c, T.LongType(), pa.int64()) for c in _LONGS] + [("runs_sha256", T.StringType(), pa.string()), ("collapsed_sha256", T.StringType(), pa.string())]
    fields += [("runs", row, arrow_row), ("collapsed", T.StringType(), pa.string())] if spans else []

    def kernel(texts: list[bytes]) -> list:
        if plant:
            parts = [x.partition(b"\n") for x in texts]
            words = [made_periodic(x.split(), int(h)) if h else x.split() for h, _, x in parts]
        else:
            words = [x.split() for x in texts]
        columns: list[list] = [[] for _ in fields]
        for some, runs in zip(words, runs_of_texts(words), strict=True):
            start, length, period = longest_run(runs) or (None, None, None)
            collapsed = b" ".join(np.array(some, dtype=object)[kept_words(len(some), runs)].tolist() if len(runs) else some)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
            values = [len(runs), start, length, period, length and 1000 * length // period, sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest()]
            values += [[{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], collapsed.decode()] if spans else []
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return columns

    return map_texts(source, lambda: kernel, fields, "__text", (id_col,))
