"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The Parquet table of that name.

    ``spread`` is for work in Python: a table of fewer partitions than cores,
    as a small single file is, is dealt out to all cores. Larger tables are read
    as they are, without a shuffle.
    """
    t = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and t.rdd.getNumPartitions() < cores:
        return t.repartition(cores)
    return t


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table of that name as a stream of its files, with its schema as stored."""
    path = f"{folder}/{name}.parquet"
    # A stream wants a folder or a pattern; the pattern holds for a table in one file and in several.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
