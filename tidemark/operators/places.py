"""Places in documents that were joined from pages: which page a character of the whole stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a document that are joined together; pages and offsets meet in such stretches, so that no document's pages meet all its offsets.
STRETCH = 65_536


def _blank_lead(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))


def page_spans(pages: DataFrame, doc: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``pages`` without their text, each with ``start`` and ``end``: the characters that it takes of the document, its pages in ``order`` with ``separator`` between them and blanks in front taken off. A separator counts to the page before it, a null text is empty. Blanks in front that are taken off have negative places.

    Only lengths go through the window; texts stay where they are read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lengths = pages.withColumns({"__length": F.length(body), "__lead": _blank_lead(body)}).drop(text)
    so_far = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    apart = len(separator)
    last = F.lead(F.lit(1)).over(W.partitionBy(doc).orderBy(order)).isNull()
    placed = lengths.withColumns({"__from": F.coalesce(F.sum(F.col("__length") + apart).over(so_far), F.lit(0)), "__last": last})
    # the first character that is no blank; a separator of other characters is one itself
    inked = F.when(F.col("__lead") < F.col("__length"), F.col("__from") + F.col("__lead"))
    if separator.strip():
        mark = len(separator) - len(separator.lstrip())
        inked = F.coalesce(inked, F.when(~F.col("__last"), F.col("__from") + F.col("__length") + mark))
    placed = placed.withColumn("__ink", inked).withColumn("__first", F.min("__ink").over(whole))
    total = F.max(F.col("__from") + F.col("__length")).over(whole)
    shift = F.coalesce("__first", total)
    end = F.col("__from") + F.col("__length") + F.when(F.col("__last"), 0).otherwise(apart)
    return placed.withColumns({"start": F.col("__from") - shift, "end": end - shift}).drop("__length", "__lead", "__from", "__last", "__ink", "__first")


def page_at(offsets: DataFrame, spans: DataFrame, doc: str, at: str, page: str) -> DataFrame:
    """``offsets`` with the ``page`` of ``page_spans`` that holds the character ``at`` (from 0) of their document. A null or negative offset, one past the end and an unknown document give null, never a near page. Repeated offsets keep their number."""
    stretches = F.sequence(F.floor(F.greatest(F.col("start"), F.lit(0)) / STRETCH), F.floor((F.col("end") - 1) / STRETCH))
    held = spans.where((F.col("end") > F.col("start")) & (F.col("end") > 0)).select(F.col(doc).alias("__doc"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col(page).alias("__page"), F.explode(stretches).alias("__stretch"))
    here = (F.col(doc) == F.col("__doc")) & (F.floor(F.col(at) / STRETCH) == F.col("__stretch")) & (F.col(at) >= F.greatest(F.col("__start"), F.lit(0))) & (F.col(at) < F.col("__end"))
    return offsets.join(held, here, "left").select(*(F.col(f"`{c}`") for c in offsets.columns if c != page), F.col("__page").alias(page))
