"""Micro-batch jobs over files that arrive: windows, sessions, duplicates, and revisions threaded through state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = "3650 days") -> DataFrame:
    """Count and sum of each window and key; rows later than ``late`` are left out."""
    grouped = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "n", "value")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], late: str = "3650 days") -> DataFrame:
    """Number of rows of each session, which ends when ``gap`` passes without a row."""
    grouped = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("session_window.start").alias("session_start"), "n")


def revisions(df: DataFrame, key: str, known_at: str, value: str) -> DataFrame:
    """Each release with its change against the release before, carried from batch to batch in state. Within a batch releases are put in order; one that arrives in a later batch than its successor is compared with what state holds."""
    kind = df.schema[key].dataType.simpleString()

    def thread(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([known_at, value], kind="stable")
        before = state.get[0] if state.exists else None
        known = rows[value].dropna()
        previous = rows[value].shift().ffill()
        if before is not None:
            previous = previous.fillna(before)
        if len(known):
            state.update((float(known.iloc[-1]),))
        yield pd.DataFrame({key: k[0], known_at: rows[known_at], value: rows[value], "revision": rows[value] - previous})

    return df.select(key, known_at, value).groupBy(key).applyInPandasWithState(thread, f"{key} {kind}, {known_at} timestamp, {value} double, revision double", "last double", "append", "NoTimeout")


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(spark: SparkSession, path: str, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a streaming job over all files at ``path`` that are there now and give what it has written: to Parquet for ``append``, by batches whose last stands for ``complete``."""
    schema = spark.read.parquet(path).schema
    folder = _folder(spark)
    # a pattern, as a stream's path may else not be a single file
    stream = job(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.outputMode("append").format("parquet").option("path", f"{folder}/out").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    done = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out-{n}")
        done.append(n)

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out-{max(done)}")
