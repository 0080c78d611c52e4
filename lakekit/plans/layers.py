"""From a source folder through the layers of the lakehouse."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.constants import DEFAULT_SCHEMA
from lakekit.sinks.tables import merge_files, publish
from lakekit.sources.tables import read_folder, read_path, read_table

TARGET_FILE_BYTES = 1024**3


def table_path(root: str, layer: str, table: str, schema: str = DEFAULT_SCHEMA) -> str:
    return f"{root.rstrip('/')}/{layer}/Tables/{schema}/{table}"


def file_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/Files/{name}"


def source_bytes(spark: SparkSession, folder: str, wildcard: str = "*.parquet") -> int:
    """The total size of the matching files, from their listing; no content is read."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{wildcard}")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def land(
    spark: SparkSession,
    folder: str,
    target: str,
    wildcard: str = "*.parquet",
    target_file_bytes: int = TARGET_FILE_BYTES,
) -> str:
    """Merge the parquet files of a folder into one dataset without staging; returns its path.

    A source up to ``target_file_bytes`` becomes one file, a larger one as many as its size asks for.
    """
    files = math.ceil(source_bytes(spark, folder, wildcard) / target_file_bytes)
    merge_files(read_folder(spark, folder, wildcard), target, max(1, files))
    return target


def copy_layer(spark: SparkSession, source: str, table: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Publish the table at one path as a table of the next layer, and read it back by name."""
    publish(read_path(spark, source, fmt), table, path, fmt)
    return read_table(spark, table)


def create_schema(spark: SparkSession, schema: str, root: str, layer: str) -> None:
    """A layer's schema; its managed tables live below the layer's own folder."""
    location = table_path(root, layer, "", schema).rstrip("/")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}` LOCATION '{location}'")


def run_chain(spark: SparkSession, folder: str, root: str, name: str, wildcard: str = "*.parquet") -> DataFrame:
    """Land a folder in bronze and publish it to silver under ``silver.<name>``; returns the silver table."""
    landed = land(spark, folder, file_path(root, "bronze", f"{name}.parquet"), wildcard)
    create_schema(spark, "silver", root, "silver")
    return copy_layer(spark, landed, f"silver.{name}", table_path(root, "silver", name))
