"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``.

    Only a local session may do without that setting: it gets a temporary folder of this machine.
    A cluster session without it raises ValueError, for no other folder is known to be shared.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _FOLDERS[context.applicationId] = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[context.applicationId])
    return _FOLDERS[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone when Python ends; the folder's name tells whose it was
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends here, and the shuffle files of the write are no longer needed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table of ``write_table`` that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.toString().find("/tidemark-") >= 0:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
