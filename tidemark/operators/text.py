"""Texts: keys of exact copies, sketches, chunks, densities, dictionaries, routes, pages and turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def copy_key(text: Column) -> Column:
    return F.md5(normalized(text))


def shingles(text: Column, k: int) -> Column:
    """Distinct hashes of ``k`` words in a row of the normalized text; a shorter text is one shingle, an empty one none."""
    words = F.filter(F.split(normalized(text), " "), lambda w: w != "")
    # the words are bound once, as the one value of an array, not worked out anew at every place
    hashes = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array().cast("array<bigint>"))), F.lit(0))


def bottom_sketch(text: Column, k: int = 8, size: int = 128) -> Column:
    """The ``size`` smallest shingle hashes, in order."""
    return F.slice(F.sort_array(shingles(text, k)), 1, size)


def sketch_jaccard(a: Column, b: Column, size: int = 128) -> Column:
    """Estimate of the likeness of two shingle sets from the smallest hashes of their union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, F.least(F.lit(size), F.greatest(F.size(a), F.size(b))))
    shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, shared / F.size(union)).otherwise(0.0)


def chunks(df: DataFrame, id_col: str, text_col: str, target: int) -> DataFrame:
    """Pieces of about ``target`` characters: whole paragraphs, long ones by sentences, packed in order, with offsets and the piece before and after.

    Null and blank texts have none. Packing is a fold over one text's own parts, so it stays in the row's task.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            rows = []
            for key, text in zip(frame["id"], frame["text"], strict=True):
                atoms = []
                for m in re.finditer(r"[^\n]+(?:\n(?!\n)[^\n]+)*", text or ""):
                    if len(m[0]) <= target:
                        atoms.append((m.start(), m.end()))
                    else:
                        atoms += [(m.start() + s.start(), m.start() + s.end()) for s in re.finditer(r"\S.*?(?:[.!?](?=\s)|\Z)", m[0], re.S)]
                start = end = None
                n = 0
                for a, b in [*atoms, (None, None)]:
                    if start is not None and (a is None or b - start > target):
                        rows.append((key, n, start, end, text[start:end]))
                        n, start = n + 1, None
                    if a is not None:
                        start, end = (a if start is None else start), b
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "end", "chunk_text"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(pack, f"id {kind}, chunk int, start int, end int, chunk_text string")
    w = W.partitionBy("id").orderBy("chunk")
    return made.withColumns({"previous": F.lag("chunk").over(w), "next": F.lead("chunk").over(w)}).withColumnRenamed("id", id_col)


def density(text: Column, markers: list[str]) -> Column:
    """How much a text reads like prose, 0 to 1: the mean of its share of letters and spaces, of its sentences' nearness to 20 words, of markers found, and of what isn't digits."""
    n = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z ]", "")) / n
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    sentences = F.greatest(F.length(F.regexp_replace(text, "[^.!?]", "")), F.lit(1))
    length = 1 - F.least(F.abs(words / sentences - 20) / 20, F.lit(1.0))
    found = sum((F.contains(F.lower(text), F.lit(m)).cast("int") for m in markers), F.lit(0)) / max(len(markers), 1)
    digits = 1 - F.length(F.regexp_replace(text, "[^0-9]", "")) / n
    return (letters + length + found + digits) / 4


def dictionary_hits(text: Column, forms: list[str]) -> Column:
    """How many of the forms occur as words."""
    words = F.split(F.lower(text), "[^a-z]+")
    return F.size(F.array_intersect(words, F.array(*map(F.lit, forms))))


def route(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that is found."""
    label = F.lit(otherwise)
    for pattern, name in reversed(rules):
        label = F.when(text.rlike(pattern), name).otherwise(label)
    return label


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags off, the common entities read, white space collapsed."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    plain = F.regexp_replace(plain, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def links(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The targets of links in order, one row each."""
    found = F.regexp_extract_all(html_col, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return df.select(id_col, F.posexplode(found).alias("position", "href"))


def sections(df: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """Parts of a text between headings, numbered from 0."""
    return df.select(id_col, F.posexplode(F.split(text_col, heading)).alias("section", "section_text"))


def turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn with its place, the role before, the length of its text and of the conversation so far."""
    w = W.partitionBy(conversation).orderBy(turn)
    return df.withColumns({"place": F.row_number().over(w), "role_before": F.lag(role).over(w), "chars": F.length(text), "chars_so_far": F.sum(F.length(text)).over(w.rowsBetween(W.unboundedPreceding, 0))})
