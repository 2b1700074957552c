"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows of ``rows`` (all, if there are fewer), chosen by a hash of their id, so that any run chooses the same.

    The share is ``most`` over the count of rows; the hash is even, so that the number exceeds ``most`` by more than a tenth with no practical chance.
    """
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(most / total * 1_000_000))


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the split into folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(divisor))
