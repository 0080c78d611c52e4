"""Intermediate tables with an owner: written to the shared folder, removed when the work is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakekit.session import run_dir


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables below one folder of the shared store; leaving the ``with`` block removes them.

    A table that is used more than once, or must survive a lost executor, goes through ``keep``.
    What an operator returns may not read from here; it is stored for itself.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = run_dir(spark, label)
        self._made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        delete(self.spark, self.path)

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._made += 1
        path = f"{self.path}/{self._made}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
        return self.spark.read.schema(df.schema).parquet(path)
