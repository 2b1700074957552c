"""Importance resampling towards a target distribution: hashed n-gram weights, keyed noise and an exact draw of the highest scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import few_at_once, map_texts, quoted, slices
from ..scratch import write_table

WIDTH = 3
BUCKETS = 10_000
#: Drawn rows that one merge is meant to give; limits between merges are set for it, results don't depend on it.
RANGE_ROWS = 4096
#: Rows of a sorted run that move together.
BLOCK = 512
#: A-Z lowered; digits, a-z and all that isn't ASCII kept; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: After every head of a run.
_LAST = (math.inf,)


def words_of(text: bytes) -> list[bytes]:
    """Words of one text in UTF-8."""
    return text.translate(_FOLD).split()


def buckets_of(words: list[bytes], width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``width`` words joined by one space: crc32 of the bytes. A longer run's crc goes on from that of the run without its last word."""
    spaced = [b" " + w for w in words]
    crcs = list(map(crc32, words))
    found = [np.array(crcs, dtype=np.int64)]
    for more in range(1, min(width, len(words))):
        crcs = list(map(crc32, spaced[more:], crcs))
        found.append(np.array(crcs, dtype=np.int64))
    return np.concatenate(found) % buckets


def bucket_counts(df: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``df`` by bucket. Every task adds up its own, so that ``buckets`` numbers a task are moved and as many reach the driver."""
    few_at_once(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in slices(batch, 0):
                for text in texts:
                    total += np.bincount(buckets_of(words_of(text), width, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = df.select(F.col(quoted(text_col)).cast("binary").alias("__text")).mapInArrow(run, "bucket long, n long")
    found = np.zeros(buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of how much likelier it is in the target than in the source, one added to every count; rounded down."""
    most, least = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * most / ((s + 1) * least))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``n_features`` and ``weight`` (the sum of the gains of a text's features, with repeats)."""

    def kernel(texts: list[bytes]) -> list:
        words, features, weights = ([0] * len(texts) for _ in range(3))
        for k, text in enumerate(texts):
            some = words_of(text)
            at = buckets_of(some, width, len(gain))
            words[k], features[k], weights[k] = len(some), len(at), int(gain[at].sum())
        return [words, features, weights]

    return map_texts(docs, lambda: kernel, [(name, T.LongType(), pa.int64()) for name in ("n_words", "n_features", "weight")], text_col, keep)


def noise(id_col: str, seed: int):
    """1000 times a Gumbel number drawn by the id: from the first 8 hex digits of sha256 of ``seed:id``; rounded down. A null id counts as empty text."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


class Tournament:
    """A tree in which the heads of many sorted runs play against each other: the winner is known at once, and when a head changes only the games on its way to the root are played again. Leaves of exhausted runs serve new ones."""

    def __init__(self, leaves: int = 2):
        self.heads: list[tuple] = [_LAST] * leaves
        self.free = list(range(leaves))
        self._play_all()

    def _play_all(self) -> None:
        n = len(self.heads)
        self.won = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            self._play(node)

    def _play(self, node: int) -> None:
        a, b = self.won[2 * node], self.won[2 * node + 1]
        self.won[node] = a if self.heads[a] <= self.heads[b] else b

    def enter(self, head: tuple) -> int:
        """The leaf that a new run with this head gets."""
        if not self.free:
            n = len(self.heads)
            self.heads += [_LAST] * n
            self.free = list(range(2 * n - 1, n - 1, -1))
            self._play_all()
        leaf = self.free.pop()
        self.replace(leaf, head)
        return leaf

    def replace(self, leaf: int, head: tuple) -> None:
        self.heads[leaf] = head
        node = (leaf + len(self.heads)) // 2
        while node:
            self._play(node)
            node //= 2

    def leave(self, leaf: int) -> None:
        self.replace(leaf, _LAST)
        self.free.append(leaf)

    @property
    def winner(self) -> int:
        return self.won[1]


def merge(blocks: Iterator[list[tuple]], most: int) -> Iterator[tuple]:
    """The first ``most`` of the elements of sorted ``blocks``, in order. Blocks come by their first elements, so that one is only held from the time when its first element is due."""
    tree, held = Tournament(), {}
    due = next(blocks, None)
    while most > 0:
        while due is not None and due[0] <= tree.heads[tree.winner]:
            held[tree.enter(due[0])] = (due, 1)
            due = next(blocks, None)
        leaf = tree.winner
        head = tree.heads[leaf]
        if head is _LAST:
            return
        yield head
        most -= 1
        block, at = held.pop(leaf)
        if at < len(block):
            held[leaf] = (block, at + 1)
            tree.replace(leaf, block[at])
        else:
            tree.leave(leaf)


def ranked(rows: DataFrame, draw: int, score_col: str, id_col: str, row_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row_col`` and ``rank`` (from 1) of the ``draw`` rows of highest score; ties go to smaller ids (null last), then to smaller ``row_col``, which tells rows apart.

    Limits by approximate quantiles cut the scores to ranges, and exact counts of the ranges tell which are drawn whole, in part or not at all. Each partition sorts its rows of these (Spark's sort spills) and cuts them to blocks; a range's blocks meet in one task, ordered by their first elements, and a tournament merges them, which ends with the last drawn row. Two numbers a range reach the driver.
    """
    spark = rows.sparkSession
    parts = max(1, math.ceil(draw / range_rows))
    if parts > 1:
        total = rows.count()
        shares = [1 - draw / total * k / parts for k in range(1, parts + 1)]
        limits = np.unique(np.array(rows.agg(F.percentile_approx(score_col, shares, max(10_000, int(40 * parts * total / draw)))).first()[0], dtype=np.int64))
    else:
        limits = np.zeros(0, dtype=np.int64)
    data = rows.select(F.col(quoted(row_col)).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(score_col)).alias("score"))
    in_range = T.StructType([*data.schema.fields, T.StructField("range", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(len(limits) - np.searchsorted(limits, score, side="right"))], names=["row", "id", "score", "range"])

    marked = data.mapInArrow(mark, in_range)
    counts = dict(marked.groupBy("range").count().collect())
    plan, before = {}, 0
    for k in sorted(counts):
        if before < draw:
            plan[k] = (before, min(counts[k], draw - before))
        before += counts[k]
    runs = marked.where(F.col("range") <= max(plan, default=-1)).sortWithinPartitions("range", F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    fields = [T.StructField("range", T.LongType()), T.StructField("first_score", T.LongType()), T.StructField("first_id", data.schema["id"].dataType), T.StructField("first_row", T.LongType())]
    fields += [T.StructField(f"{c}s", T.ArrayType(data.schema[c].dataType)) for c in ("score", "id", "row")]
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(3).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            starts = [at for a, b in zip(starts, [*starts[1:], len(of)], strict=True) for at in range(a, b, BLOCK)]
            if starts:
                score, ids, row = batch.column(2), batch.column(1), batch.column(0)
                offsets = pa.array([*starts, len(of)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, c) for c in (score, ids, row)]
                at = pa.array(starts)
                yield pa.RecordBatch.from_arrays([batch.column(3).take(at), score.take(at), ids.take(at), row.take(at), *lists], names=names)

    blocks = runs.mapInArrow(cut, T.StructType(fields)).repartition(F.col("range")).sortWithinPartitions("range", F.col("first_score").desc(), F.col("first_id").asc_nulls_last(), "first_row")

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def elements() -> Iterator[tuple[int, list[tuple]]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    score, ids, row = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                    yield batch.column(0)[k].as_py(), [(-s, i is None, 0 if i is None else i, r) for s, i, r in zip(score, ids, row, strict=True)]

        stream = elements()
        due = next(stream, None)
        while due is not None:
            at = due[0]

            def of_range(at: int = at) -> Iterator[list[tuple]]:
                nonlocal due
                while due is not None and due[0] == at:
                    block = due[1]
                    due = next(stream, None)
                    yield block

            before, take = plan[at]
            mine = of_range()
            rank, got = before, []
            for element in merge(mine, take):
                rank += 1
                got.append((element[3], rank))
                if len(got) == BLOCK * 8:
                    yield _ranks(got)
                    got = []
            yield _ranks(got)
            for _ in mine:
                pass

    return blocks.mapInArrow(play, "row long, rank long").withColumnRenamed("row", row_col) if plan else spark.createDataFrame([], f"`{row_col}` long, rank long")


def _ranks(got: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), pa.array([k for _, k in got], pa.int64())], names=["row", "rank"])


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``: those of at least ``least_words`` words compete, and the floor of ``percent`` hundredths of their number with the highest scores are drawn; others have a null rank.

    Scores are weights with Gumbel noise by the id, so that the draw is one without replacement in proportion to the weights' likelihood ratios. A null text has no words; repeated rows each take part; an empty target makes rare features gain; empty ``docs`` give no rows. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    weighed = weigh(docs, gain, text_col, (id_col,)).withColumn("score", F.col("weight") + noise(id_col, seed)).withColumn("__row", F.monotonically_increasing_id())
    scored = write_table(weighed, "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    ranks = ranked(eligible, eligible.count() * percent // 100, "score", id_col, "__row", range_rows)
    return scored.join(ranks, "__row", "left").drop("__row")
