"""A tree of text files as rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.constants import CORPUS_GLOB, UNIT_CONFIG_FILE, UNKNOWN_TYPE
from lakekit.functions.paths import item_name, item_type, not_skipped, relative_to


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def split_root(root: str) -> tuple[str, str]:
    """The store a root is in, as far as it names one, and the path in it."""
    scheme, found, rest = root.partition(":")
    if not found or "/" in scheme:
        return "", root
    if not rest.startswith("//"):
        return f"{scheme}:", rest
    authority, _, path = rest[2:].partition("/")
    return f"{scheme}://{authority}", f"/{path}"


def _plain_root(root: str) -> str:
    return split_root(root)[1]


def as_glob(name: str) -> str:
    """A name for the reader, which takes brackets and the like for wildcards."""
    return re.sub(r"([\[\]{}*?,\\])", r"\\\1", name)


def files_at(spark: SparkSession, *paths: str, names: str | None = None, below: bool = False) -> DataFrame:
    """Files by their paths or globs, or with ``below`` all files of these names under the folders, as Spark reads them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower())
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    return reader.load(list(paths)).withColumn("path", _plain_path(F.col("path")))


def _listed(spark: SparkSession, glob: str) -> Sequence:
    """What a glob names, as the store's own client answers; hidden names count too."""
    place = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []


def hidden_folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below a root whose name begins with ``_`` or ``.``, at any depth.

    Spark's listing passes over such folders, unless one is a root by itself. They are found by globs, one for
    each depth, which the store's own client answers; only their names reach the driver.
    """
    found, above = [], as_glob(root.rstrip("/"))
    while len(_listed(spark, f"{above}/*")):
        folders = [status.getPath() for status in _listed(spark, f"{above}/{{_*,.*}}") if status.isDirectory()]
        found += [path.toString() for path in folders if _is_hidden(path.getName())]
        above += "/*"
    return found


def _is_hidden(name: str) -> bool:
    """Spark's own rule: a leading underscore may still begin a partition's folder or a metadata file."""
    kept = "=" in name or name.startswith(("_metadata", "_common_metadata"))
    return name.startswith(".") or (name.startswith("_") and not kept)


def _files(spark: SparkSession, root: str, names: str) -> DataFrame:
    folders = [root.rstrip("/"), *hidden_folders(spark, root)]
    return files_at(spark, *[as_glob(folder) for folder in folders], names=names, below=True)


def read_corpus(spark: SparkSession, root: str, names: str = CORPUS_GLOB, unit: str | None = None) -> DataFrame:
    """The deployable text files below a root, or below one unit of it.

    Columns: unit (folder below the root), rel_path (below the unit), file (from the root's own
    name on), name, item_type, item_name, text. Files on the skip list, files outside a typed folder, and
    files that are not valid UTF-8 give no row. Folders may have any name, also one that Spark takes
    for hidden; files whose own name begins with ``_`` or ``.`` are out of its reader's reach.
    """
    base = _plain_root(root).rstrip("/")
    below = relative_to(F.col("path"), base)
    folder = root if unit is None else f"{root.rstrip('/')}/{unit}"
    return (
        _files(spark, folder, names)
        .withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
        .filter(not_skipped(F.col("name")))
        .withColumn("item_type", item_type(F.col("path")))
        .filter(F.col("item_type") != UNKNOWN_TYPE)
        .withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
        .filter(F.col("text").isNotNull())
        .select(
            F.substring_index(below, "/", 1).alias("unit"),
            F.regexp_replace(below, "^[^/]*/", "").alias("rel_path"),
            F.concat(F.lit(base.rsplit("/", 1)[-1] + "/"), below).alias("file"),
            "name",
            "item_type",
            item_name(F.col("path")).alias("item_name"),
            "text",
        )
    )


def read_tree(spark: SparkSession, root: str, names: str) -> DataFrame:
    """Any valid UTF-8 files below a root: path (relative to it) and text."""
    return _files(spark, root, names).select(
        relative_to(F.col("path"), _plain_root(root)).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    ).filter(F.col("text").isNotNull())


def config_files(spark: SparkSession, root: str, name: str = UNIT_CONFIG_FILE) -> DataFrame:
    """The units whose own folder holds a file of the given name, be it empty. Only that depth is listed, no file is read."""
    found = _listed(spark, f"{as_glob(root.rstrip('/'))}/*/{as_glob(name)}")
    units = [(status.getPath().getParent().getName(),) for status in found if status.isFile()]
    return spark.createDataFrame(units, "unit string")
