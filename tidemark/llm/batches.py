"""Arrow batches of documents: from a DataFrame of texts to columns that a kernel computes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a kernel gets at once; a longer text comes alone.
SLICE_BYTES = 1 << 20

#: Documents that Python gets at once, at most.
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

Kernel = Callable[[list[bytes]], list]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def few_at_once(spark: SparkSession) -> None:
    """Documents may be long: a session that hands Python more than ROWS_AT_ONCE rows at once, or all of a task, is brought down to it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS_AT_ONCE:
        spark.conf.set(_BATCH, str(ROWS_AT_ONCE))


def parts_of(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``most`` bytes of text in ``column``, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of ``batch`` of at most SLICE_BYTES of text, or one row, with their texts in UTF-8 (null: empty)."""
    for part in parts_of(batch, column):
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, make_kernel: Callable[[], Kernel], fields: list[tuple[str, T.DataType, pa.DataType]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``df`` and those that the kernel makes of each text.

    ``make_kernel`` runs once in each task and gives a function from a list of texts in UTF-8 to one list or array for each of ``fields``. A kept column with the name of a field gives way to the field; other columns of ``df`` don't reach Python.
    """
    made = {name for name, _, _ in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in made]
    columns = [F.col(quoted(c)) for c in kept]
    own = text_col in kept
    source = df.select(*columns) if own else df.select(*columns, F.col(quoted(text_col)).cast("binary").alias("__text"))
    at = kept.index(text_col) if own else len(kept)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in fields])
    names = kept + [name for name, _, _ in fields]
    kinds = [kind for _, _, kind in fields]

    few_at_once(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            for part, texts in slices(batch, at):
                values = [pa.array(x, type=kind) for x, kind in zip(kernel(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + values, names=names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return source.mapInArrow(run, schema)
