"""Columnar sources: a folder of parquet files, a table by name or path, an outside location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_folder(spark: SparkSession, folder: str, wildcard: str = "*.parquet") -> DataFrame:
    """The parquet files directly inside one folder.

    The wildcard is part of the path, so sub-folders (plain or ``key=value``) are not entered.
    Spark raises PATH_NOT_FOUND when nothing matches.
    """
    return spark.read.parquet(f"{folder.rstrip('/')}/{wildcard}")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Every column of a catalog table, named ``table``, ``schema.table`` or with a catalog."""
    return spark.table(name).select("*")


def read_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table by its storage path."""
    return spark.read.format(fmt).load(path)


def link_external(
    spark: SparkSession,
    name: str,
    location: str,
    subpath: str = "",
    fmt: str = "parquet",
    temporary: bool = False,
) -> DataFrame:
    """Expose an outside location under a name without copying it.

    A temporary link lives for the session, the other kind is an external catalog table:
    dropping it leaves the files alone.
    """
    path = "/".join([location.rstrip("/"), subpath.strip("/")]).rstrip("/")
    if temporary:
        read_path(spark, path, fmt).createOrReplaceTempView(name)
    else:
        spark.catalog.createTable(name, path=path, source=fmt)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table on all cores, for costly work per row such as pattern search over texts.

    Only a table with fewer splits than cores is moved; a large one has splits enough and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
