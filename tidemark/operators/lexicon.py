"""Names of a dictionary in texts: spans that do not overlap, at their places in the original."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms that are sent to every task at most.
MOST_FORMS = 1_000_000
_POSSESSIVE = re.compile(r"(?:'s|s')?\s*")
_WORD = re.compile(r"[a-z0-9'.]+")


class _Folded(dict):
    """Single characters to what they are folded to, worked out once each."""

    def __missing__(self, code: int) -> int:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        low = base[0].lower() if len(base) == 1 else chr(code)
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case without accents, with as many characters as before: what would become several, or none, stays as it is."""
    return text.translate(_FOLDED)


def folded(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, the fold of a text (null stays null)."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([None if t is None else fold(t) for t in texts], pa.string())], names=[*kept, out])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


class Lexicon:
    """Forms with what they stand for. A form that stands for two things is ambiguous: like a decoy it takes its span and gives nothing, so that a shorter form in it is not found by mistake."""

    def __init__(self, forms: Iterable[tuple[str, str]], decoys: Iterable[str] = (), followers: Iterable[str] = ()):
        self.names: dict[str, str | None] = {}
        for form, name in forms:
            key = self._key(form)
            if key:
                self.names[key] = name if self.names.get(key, name) == name else None
        for form in decoys:
            if key := self._key(form):
                self.names[key] = None
        self.ambiguous = frozenset(k for k, v in self.names.items() if v is None)
        self.followers = frozenset(self._key(f) for f in followers)
        if len(self.names) > MOST_FORMS:
            raise ValueError(f"{len(self.names)} forms; at most {MOST_FORMS} are sent to every task")

    @staticmethod
    def _key(form: str) -> str:
        return " ".join(fold(form).split())

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for key in self.names:
            made.add_word(key, key)
        if self.names:
            made.make_automaton()
        return made

    def spans(self, automaton, text: str) -> list[tuple[int, int, str]]:
        """(start, end, name) of one text, by start: at each place the longest form that neither a letter nor a digit touches; spans do not overlap, the leftmost first. White space in a form is any run of it in the text. A span is dropped if one of the ``followers`` stands right behind it, or behind its possessive, as the next one or two words."""
        if not text or not self.names:
            return []
        low = fold(text)
        plain = np.array([c.isspace() for c in low], dtype=bool)
        kept = np.flatnonzero(~(plain & np.r_[False, plain[:-1]]))
        flat = "".join(" " if plain[k] else low[k] for k in kept.tolist()) if plain.any() else low
        touch = lambda k: 0 <= k < len(flat) and (flat[k] in "0123456789" or "a" <= flat[k] <= "z")
        longest: dict[int, int] = {}
        for last, key in automaton.iter(flat):
            start, end = last + 1 - len(key), last + 1
            if longest.get(start, 0) < end and not touch(start - 1) and not touch(end):
                longest[start] = end
        found, free = [], 0
        for start in sorted(longest):
            if start < free:
                continue
            free = longest[start]
            name = self.names[flat[start:free]]
            if name is not None and not self._followed(flat, free):
                found.append((int(kept[start]), int(kept[free - 1]) + 1, name))
        return found

    def _followed(self, flat: str, end: int) -> bool:
        if not self.followers:
            return False
        tail = flat[end : end + 64]
        words = _WORD.findall(tail[_POSSESSIVE.match(tail).end() :])[:2]
        return any(" ".join(words[:n]).strip(".") in self.followers for n in range(1, len(words) + 1))


def find_spans(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """``id_col``, ``place`` (from 0), ``start``, ``end`` (characters of the original text) and ``name`` of every span. Null, empty and plain texts have none. The automaton of all forms is made once a task; whole texts are looked at."""
    schema = T.StructType([df.schema[id_col], T.StructField("place", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            at, rows = [], []
            for k in range(batch.num_rows):
                for place, span in enumerate(lexicon.spans(automaton, batch.column(1)[k].as_py() or "")):
                    at.append(k)
                    rows.append((place, *span))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], names=[f.name for f in schema.fields])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def ancestors(parents: DataFrame) -> DataFrame:
    """``name`` and ``ancestor`` for every name of ``parents`` (name, parent) and all that it folds into, itself included; cycles end."""
    from .graph import reachable

    edges = parents.where("name is not null and parent is not null").select(F.col("name").alias("src"), F.col("parent").alias("dst"))
    names = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    up = reachable(edges, names).where("origin <> node").select(F.col("origin").alias("name"), F.col("node").alias("ancestor"))
    return up.unionByName(names.select(F.col("node").alias("name"), F.col("node").alias("ancestor")))
