"""The folder that all executors share, for what a query writes on its way."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set a local session, as in tests, gets one of its own until it ends; a cluster has to name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folioflow-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        # The part of the folder that is this application's own goes when it ends.
        _PATHS.append((spark, sc.getCheckpointDir()))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    _PATHS.append((spark, path))
    return path


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table written to the shared folder, in parts by a column, and read again: each use reads its part and columns only."""
    path = new_path(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there now, as a table: run to its end and written batch by batch.

    In ``update`` mode a column ``batch`` tells later results from earlier ones.
    """
    spark = stream.sparkSession
    path = new_path(spark)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", new_path(spark))
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _PATHS:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner clears it then
            return
