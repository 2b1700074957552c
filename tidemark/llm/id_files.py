"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import quoted
from ..scratch import new_path, write_table

#: Ids of one block, at least, unless the part ends; a block holds whole documents.
BLOCK_IDS = 1 << 16
#: Data bytes of each of the four values of a control byte.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four lengths each, the first lowest) and data bytes (1 to 4 a value, lowest first) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    lengths = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``: lengths by table look-up of control bytes, all data bytes placed at once."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    if int(lengths.sum()) != len(data):
        raise ValueError("control and data bytes disagree")
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


@dataclass(frozen=True)
class IdFiles:
    """Where the files are: ``blocks`` (part, block, start_in_part, n_ids, doc_ids, n_tokens, control, data), ``parts`` (part, start) and ``ranks`` (rank, id)."""

    folder: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def count_ids(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``id`` and ``n`` over all documents of packed 16-bit ids, summed in each task before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            joined = b"".join(x for x in batch.column(0).to_pylist() if x)
            total += np.bincount(np.frombuffer(joined, dtype="<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return encoded.select(ids_col).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(encoded: DataFrame, parts: int, id_col: str = "doc_id", ids_col: str = "ids") -> IdFiles:
    """Write packed 16-bit ids as files in ascending order of ``id_col`` (nulls first, equal ids by their tokens) and say where.

    Part k holds documents that come before those of part k + 1; in a part, blocks and documents are in order. The rank of an id is its place by falling count, then rising id; there are at most 65,536, so ranks are held by every task. Parts and their starts are as many as ``parts``. An empty table gives empty files.
    """
    spark = encoded.sparkSession
    files = IdFiles(new_path(spark, "ids"))
    ranks = count_ids(encoded, ids_col).toPandas().sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(ranks)], "rank int, id int").coalesce(1).write.parquet(f"{files.folder}/ranks")
    rank_of = np.zeros(1 << 16, dtype=np.uint32)
    rank_of[ranks] = np.arange(len(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start, docs, sizes, held, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def flush():
            control, data = pack(rank_of[np.frombuffer(b"".join(held), dtype="<u2")])
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start_in_part": start, "n_ids": n, "doc_ids": docs, "n_tokens": sizes, "control": control, "data": data}], schema=arrow)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids or b""
                docs.append(doc)
                sizes.append(len(ids) // 2)
                held.append(ids)
                n += len(ids) // 2
                if n >= BLOCK_IDS:
                    yield flush()
                    block, start, docs, sizes, held, n = block + 1, start + n, [], [], [], 0
        if docs:
            yield flush()

    arrow = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
    schema = "part int, block long, start_in_part long, n_ids long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
    rows = encoded.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(ids_col)).alias("ids"))
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "ids").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{files.folder}/blocks")
    # a row for each part, which are as many as the caller asked for
    sums = files.table(spark, "blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for row in sums:
        starts.append((row["part"], at))
        at += row["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{files.folder}/parts")
    return files


def read_ids(spark: SparkSession, files: IdFiles, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (packed, unsigned 32 bits, little endian) of each document in the files."""
    ranks = files.table(spark, "ranks").orderBy("rank").toPandas()["id"].to_numpy(dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, sizes, control, data = (batch.column(k)[row].as_py() for k in range(5))
                n = np.array(sizes, dtype=np.int64)
                ends = np.cumsum(n)
                packed = ranks[unpack(control, data, int(ends[-1]))].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array([packed[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), sizes, strict=True)], pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    blocks = files.table(spark, "blocks").join(F.broadcast(files.table(spark, "parts")), "part")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return blocks.select((F.col("start") + F.col("start_in_part")).alias("start"), "doc_ids", "n_tokens", "control", "data").mapInArrow(run, schema)


def store(encoded: DataFrame) -> DataFrame:
    """Keep encoded documents in the shared folder, so that counting and writing do not encode them again."""
    return write_table(encoded, "encoded")
