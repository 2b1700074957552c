"""Packing of pieces into sequences of bounded length by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import quoted
from ..scratch import write_table


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with numbers of uses, whose sum is the largest that fits ``room``: subset sums as bits of one integer, longest lengths first, so that of equal sums one of long pieces is found."""
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        seen.append((length, reach))
        most, step = min(counts[length], room // length), 1
        while most:
            step = min(step, most)
            reach |= reach << (step * length) & mask
            most -= step
            step *= 2
        if reach >> room & 1:
            break
    target, uses = reach.bit_length() - 1, {}
    for length, before in reversed(seen):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            uses[length] = n
    return uses


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Bins as (first number, how many alike, uses by length). Each holds the longest length left and the fullest combination beside it, as often as the counts allow."""
    left, bins, number = {x: n for x, n in counts.items() if n}, [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        uses = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        alike = min(left[x] // n for x, n in uses.items())
        bins.append((number, alike, uses))
        number += alike
        for x, n in uses.items():
            left[x] -= n * alike
            if not left[x]:
                del left[x]
    return bins


def cut(encoded: DataFrame, most: int, bits: int = 32, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``piece`` (from 0), ``start``, ``length`` and ``ids`` of the pieces of at most ``most`` tokens of packed documents; only longer documents are cut. Documents without tokens have no piece."""
    size = bits // 8
    rows = encoded.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(ids_col)).alias("__ids")).withColumn("__n", F.floor(F.length("__ids") / size)).where("__n > 0")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__n") / most) - 1).cast("int"))))
    start = F.col("piece").cast("long") * most
    return rows.select(id_col, "piece", start.alias("start"), F.least(F.lit(most), F.col("__n") - start).cast("long").alias("length"), F.substring("__ids", (start * size + 1).cast("int"), F.lit(most * size)).alias("ids"))


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece has its place in a sequence of at most ``capacity`` tokens, gapless from 0.

    ``pieces`` is read more than once, so it should be a table; ``keys`` tell its rows apart (rows that they don't tell apart are placed in any order). Only the counts of each length come to the driver, at most ``capacity`` numbers. A row's rank among those of its length, counted in parts of each length so that a common one meets in no task, gives its place by arithmetic. Lengths that are null, under 1 or over ``capacity`` raise ValueError. Columns named sequence_id and offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(F.when(F.col(length_col).between(1, capacity), F.col(length_col))).count().collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} pieces have no length from 1 to {capacity}")
    bins = plan(counts, capacity)
    rows, taken = [], dict.fromkeys(counts, 0)
    for number, alike, uses in bins:
        offset = 0
        for length, n in sorted(uses.items(), reverse=True):
            rows.append((length, taken[length], number, n, offset))
            taken[length] += n * alike
            offset += length * n
    spots = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)

    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = pieces.withColumn("__salt", F.pmod(F.xxhash64(*(quoted(k) for k in keys)), F.lit(salts)))
    before = marked.groupBy(length_col, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(F.col(length_col).alias("__length"), F.col("__salt").alias("__s"), (F.sum("__n").over(W.partitionBy(length_col).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))).alias("__before"))
    ranked = marked.withColumn("__at", F.row_number().over(W.partitionBy(length_col, "__salt").orderBy(*(quoted(k) for k in keys))) - 1)
    ranked = ranked.join(before, (F.col(length_col) == F.col("__length")) & (F.col("__salt") == F.col("__s")))
    ranked = ranked.withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__at")).select(*(quoted(c) for c in pieces.columns), "__rank")
    kept = len(pieces.columns)
    length_at = pieces.columns.index(length_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = spots[:, 0] << 42 | spots[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (length_at, kept))
            spot = spots[np.searchsorted(first, length << 42 | rank, side="right") - 1]
            turn = rank - spot[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(spot[:, 2] + turn // spot[:, 3]), pa.array(spot[:, 4] + turn % spot[:, 3] * length)], names=[*batch.schema.names[:kept], "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``sequence_id`` and ``ids``: the packed tokens of each sequence, its pieces laid end to end."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex(quoted(ids_col)).alias("hex")))).alias("parts"))
    return parts.select("sequence_id", F.unhex(F.array_join("parts.hex", "")).alias("ids"))


def table(pieces: DataFrame) -> DataFrame:
    """Pieces kept in the shared folder, for ``pack`` to read."""
    return write_table(pieces, "pieces")
