"""Landing, publishing, linking and copying of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions import typed_copy
from lakekit.plans.layers import copy_layer, create_schema, file_path, land, table_path
from lakekit.session import run_dir
from lakekit.sinks import append_copy, publish
from lakekit.sources import link_external, read_folder, read_path, read_table


def _schema(spark: SparkSession, root: str, layer: str) -> str:
    name = f"{layer}_{uuid.uuid4().hex}"
    create_schema(spark, name, root, layer)
    return name


def land_and_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = run_dir(spark, "layers")
    landed = land(spark, sf_dir, file_path(root, "bronze", "orders.parquet"), wildcard="orders*.parquet")
    silver = _schema(spark, root, "silver")
    return copy_layer(spark, landed, f"{silver}.orders_silver", table_path(root, "silver", "orders_silver"))


def wildcard_not_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{run_dir(spark, 'folder')}/in"
    part = read_folder(spark, sf_dir, "part.parquet")
    part.repartition(4, "p_partkey").write.parquet(folder)
    part.write.parquet(f"{folder}/older")
    part.filter(F.col("p_size") > 25).write.parquet(f"{folder}/p_size=26")
    return read_folder(spark, folder)


def managed_overwrite_shrinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{_schema(spark, run_dir(spark, 'managed'), 'gold')}.customer"
    publish(read_path(spark, f"{sf_dir}/customer.parquet"), table)
    publish(read_table(spark, table).filter(F.col("c_acctbal") > 0), table, staged=True)
    return read_table(spark, table)


def typed_copy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_path(spark, f"{sf_dir}/part.parquet").select(
        "p_partkey",
        "p_name",
        "p_size",
        "p_retailprice",
        F.col("p_retailprice").alias("whole_price"),
        (F.col("p_size") > 25).alias("is_large"),
        (F.col("p_size") > 25).alias("large_text"),
    )
    target = T.StructType(
        [
            T.StructField("p_partkey", T.ByteType()),
            T.StructField("p_name", T.VarcharType(5)),
            T.StructField("p_size", T.StringType()),
            T.StructField("p_retailprice", T.DecimalType(10, 1)),
            T.StructField("whole_price", T.IntegerType()),
            T.StructField("is_large", T.IntegerType()),
            T.StructField("large_text", T.StringType()),
        ]
    )
    return typed_copy(part, target)


def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_path(spark, f"{sf_dir}/lineitem.parquet")
    first = ["l_orderkey", "l_linenumber"]
    return lineitem.orderBy(*first, *[c for c in lineitem.columns if c not in first]).limit(1000)


def external_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same location behind a session link and behind a catalog link, one row set each."""
    name = f"supplier_{uuid.uuid4().hex}"
    session_link = link_external(spark, f"session_{name}", sf_dir, "supplier.parquet", temporary=True)
    catalog_link = link_external(spark, f"catalog_{name}", sf_dir, "supplier.parquet")
    return session_link.withColumn("link", F.lit("session")).unionByName(
        catalog_link.withColumn("link", F.lit("catalog"))
    )


def copy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{run_dir(spark, 'space')}/events"
    events = read_path(spark, f"{sf_dir}/events.parquet")
    append_copy(events, target, description="first copy", type_column="event_type")
    append_copy(events, target, types=["purchase", "signup"], type_column="event_type")
    return read_path(spark, target)


QUERIES = {
    "land_and_publish": land_and_publish,
    "wildcard_not_recursive": wildcard_not_recursive,
    "managed_overwrite_shrinks": managed_overwrite_shrinks,
    "typed_copy": typed_copy_part,
    "ordered_limit": ordered_limit,
    "external_link": external_link,
    "copy_filtered": copy_filtered,
}

ORACLES = {
    "land_and_publish": "SELECT * FROM orders",
    "wildcard_not_recursive": "SELECT * FROM part",
    "managed_overwrite_shrinks": "SELECT * FROM customer WHERE c_acctbal > 0",
    "typed_copy": """
        SELECT TRY_CAST(p_partkey AS TINYINT) AS p_partkey,
               left(p_name, 5) AS p_name,
               CAST(p_size AS VARCHAR) AS p_size,
               CAST(p_retailprice AS DECIMAL(10, 1)) AS p_retailprice,
               CAST(trunc(p_retailprice) AS INTEGER) AS whole_price,
               CAST(NULL AS INTEGER) AS is_large,
               CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS large_text
        FROM part
    """,
    "ordered_limit": """
        SELECT * FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                 l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        LIMIT 1000
    """,
    "external_link": """
        SELECT *, 'session' AS link FROM supplier UNION ALL SELECT *, 'catalog' AS link FROM supplier
    """,
    "copy_filtered": """
        SELECT *, 'first copy' AS description FROM events
        UNION ALL
        SELECT *, 'Migrated from source workspace' AS description FROM events
        WHERE event_type IN ('purchase', 'signup')
    """,
}
