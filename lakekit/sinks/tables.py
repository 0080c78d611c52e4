"""Sinks: merged landing files, overwritten tables, filtered copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.constants import COPY_NOTE
from lakekit.session import run_dir

FILE_FORMATS = ("parquet", "orc", "json", "csv", "avro")
_VERSION = "-version-"


def merge_files(df: DataFrame, target: str, files: int = 1) -> None:
    """Write snappy parquet to a directory, merging the input's partitions into ``files`` files.

    Merging needs no shuffle. Choose ``files`` so that one file is what one task can write; see
    ``land``, which does so from the size of the source.
    """
    df.coalesce(files).write.mode("overwrite").option("compression", "snappy").parquet(target)


def publish(df: DataFrame, table: str, path: str | None = None, fmt: str = "parquet", staged: bool = False) -> None:
    """Replace a catalog table: a managed one, or one at an explicit path.

    A managed table of plain files is written beside what it holds, as a version of its own; only a
    whole version is put in place, by one change in the catalog, and the one before is removed after
    that. A write that fails leaves the old rows and no files, and rows may be read from the table
    that they replace. A version with other columns becomes a table first, which then takes the name.

    At an explicit path the files have to be where the path says, so they are overwritten there; ``staged``
    first writes the rows to the shared folder, which is needed if they are read from that path. The stage
    stays only if the replacement fails, as it is then the one whole copy.
    """
    spark = df.sparkSession
    if path is None and fmt in FILE_FORMATS and spark.catalog.tableExists(table):
        _swap(df, table, fmt)
        return
    stage = run_dir(spark, "stage") if staged else None
    if stage:
        df.write.format(fmt).save(stage)
        df = spark.read.format(fmt).load(stage)
    writer = df.write.format(fmt).mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    if stage:
        remove(spark, stage)


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalog says about a table, by the names it uses."""
    return {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}


def _swap(df: DataFrame, table: str, fmt: str) -> None:
    spark = df.sparkSession
    about = _described(spark, table)
    old, version = about["Location"], uuid.uuid4().hex[:12]
    base = old.rstrip("/").partition(_VERSION)[0]
    same = about["Provider"] == fmt and _shape(spark.table(table).schema) == _shape(df.schema)
    if same and about["Type"] == "MANAGED":
        new = f"{base}{_VERSION}{version}"
        try:
            df.write.format(fmt).save(new)
        except Exception:
            remove(spark, new)
            raise
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
        spark.catalog.refreshTable(table)
        remove(spark, old)
        return
    # The catalog does not let a table of files change its columns, so another table takes its place.
    schema, _, name = table.rpartition(".")
    schema, name = schema or spark.catalog.currentDatabase(), f"{name.strip('`')}_{version}".lower()
    other = f"{schema}.{name}"
    try:
        df.write.format(fmt).saveAsTable(other)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {other}")
        folder = spark.sql(f"DESCRIBE SCHEMA {schema}").filter("info_name = 'Location'").first().info_value
        remove(spark, f"{folder}/{name}")
        raise
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {other} RENAME TO {table}")


def _shape(schema: T.StructType) -> list[tuple]:
    return [(field.name, field.dataType) for field in schema]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def append_copy(
    items: DataFrame,
    target: str,
    types: list[str] | None = None,
    description: str = COPY_NOTE,
    type_column: str = "type",
    fmt: str = "parquet",
) -> None:
    """Append the items of one space, or only those of the given types, to another at a path."""
    chosen = items.filter(F.col(type_column).isin(types)) if types else items
    chosen.withColumn("description", F.lit(description)).write.format(fmt).mode("append").save(target)
