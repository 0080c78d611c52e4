from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions import typed_copy
from lakekit.plans.layers import copy_layer, create_schema, file_path, land, run_chain, source_bytes, table_path
from lakekit.session import run_dir, stored
from lakekit.sinks import append_copy, merge_files, publish
from lakekit.sources import read_path, read_table, spread


def parts(path):
    return sorted(p.name for p in Path(path).glob("part-*"))


def test_landing_merges_files(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "Files" / "rows.parquet")
    spark.range(1000).repartition(6).write.parquet(source)
    (tmp_path / "in" / "note.txt").write_text("x")
    spark.range(5).write.parquet(f"{source}/sub")
    assert land(spark, source, target) == target
    assert [p.endswith(".snappy.parquet") for p in parts(target)] == [True]
    assert read_path(spark, target).count() == 1000


def test_large_sources_land_in_several_files(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).repartition(6).write.parquet(source)
    # Small splits, so that there are as many partitions to merge as a large source would have.
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        land(spark, source, target, target_file_bytes=source_bytes(spark, source) // 3 + 1)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(parts(target)) == 3
    assert read_path(spark, target).count() == 1000


def test_merge_overwrites(spark, tmp_path):
    target = str(tmp_path / "t")
    merge_files(spark.range(100).repartition(4), target)
    merge_files(spark.range(10).repartition(4), target, files=2)
    assert read_path(spark, target).count() == 10
    assert len(parts(target)) == 2


def test_publish_replaces(spark, as_rows):
    publish(spark.range(10), "published")
    publish(spark.range(3), "published")
    assert as_rows(read_table(spark, "published")) == [(0,), (1,), (2,)]


def test_publish_from_the_table_itself(spark, as_rows):
    publish(spark.range(10), "shrinking")
    publish(read_table(spark, "shrinking").filter("id > 7"), "shrinking", staged=True)
    assert as_rows(read_table(spark, "shrinking")) == [(8,), (9,)]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path, as_rows):
    publish(spark.range(10), "kept")
    publish(spark.range(5), "kept")
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        publish(bad, "kept")
    with pytest.raises(Exception, match="no"):
        publish(bad.withColumn("more", F.lit(1)), "kept")
    assert as_rows(read_table(spark, "kept")) == [(i,) for i in range(5)]
    place = Path(spark.sql("DESCRIBE EXTENDED kept").filter("col_name = 'Location'").first().data_type.removeprefix("file:"))
    assert [p.name for p in place.parent.iterdir() if p.name.startswith("kept")] == [place.name]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("kept")] == ["kept"]


def test_columns_may_change(spark, as_rows):
    publish(spark.range(3), "changing")
    publish(read_table(spark, "changing").select(F.lit("x").alias("a"), (F.col("id") * 2).alias("b")), "changing")
    publish(read_table(spark, "changing").filter("b > 0"), "changing")
    assert as_rows(read_table(spark, "changing")) == [("x", 2), ("x", 4)]
    spark.sql("DROP TABLE changing")


def test_a_stage_does_not_stay(spark, tmp_path, monkeypatch, as_rows):
    stage = str(tmp_path / "stage")
    monkeypatch.setattr("lakekit.sinks.tables.run_dir", lambda spark, label: stage)
    publish(spark.range(4), "at_path", str(tmp_path / "t"), staged=True)
    assert as_rows(read_path(spark, str(tmp_path / "t"))) == [(i,) for i in range(4)] and not Path(stage).exists()


def test_publish_at_a_path_reads_the_same_both_ways(spark, tmp_path, as_rows):
    path = table_path(str(tmp_path), "silver", "things")
    assert path == f"{tmp_path}/silver/Tables/dbo/things"
    source = file_path(str(tmp_path), "bronze", "things.parquet")
    spark.range(4).write.parquet(source)
    by_name = copy_layer(spark, source, "things_silver", path)
    assert as_rows(by_name) == as_rows(read_path(spark, path)) == [(0,), (1,), (2,), (3,)]
    assert spark.catalog.getTable("things_silver").tableType == "EXTERNAL"


def test_a_layer_holds_its_managed_tables(spark, tmp_path):
    create_schema(spark, "gold_layer", str(tmp_path), "gold")
    publish(spark.range(2), "gold_layer.t")
    assert parts(table_path(str(tmp_path), "gold", "t", "gold_layer"))


def test_chain_from_folder_to_silver(spark, tmp_path):
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "source"))
    silver = run_chain(spark, str(tmp_path / "source"), str(tmp_path / "lake"), "nine")
    assert silver.count() == read_table(spark, "silver.nine").count() == 9
    assert parts(table_path(str(tmp_path / "lake"), "silver", "nine"))


def test_copies_are_appended(spark, tmp_path, as_rows):
    items = spark.createDataFrame([("n1", "Notebook"), ("l1", "Lakehouse"), ("r1", "Report")], "name string, type string")
    target = str(tmp_path / "space")
    append_copy(items, target, types=["Lakehouse", "Notebook"])
    append_copy(items.filter("name = 'r1'"), target, description="again")
    note = "Migrated from source workspace"
    assert as_rows(read_path(spark, target)) == [("l1", "Lakehouse", note), ("n1", "Notebook", note), ("r1", "Report", "again")]


COPY = {
    "long text": ("abcdef", T.StringType(), T.VarcharType(3), "abc", True),
    "short text": ("ab", T.StringType(), T.VarcharType(3), "ab", False),
    "decimal scale": (1.25, T.DoubleType(), T.DecimalType(5, 1), 1.3, True),
    "fraction": (3.999, T.DoubleType(), T.IntegerType(), 3, True),
    "whole number": (3.0, T.DoubleType(), T.IntegerType(), 3, False),
    "out of range": (300, T.LongType(), T.ByteType(), None, True),
    "in range": (100, T.LongType(), T.ByteType(), 100, False),
    "no number": ("x", T.StringType(), T.IntegerType(), None, True),
    "number as text": (12, T.LongType(), T.StringType(), "12", False),
    "boolean as number": (True, T.BooleanType(), T.IntegerType(), None, True),
    "number as boolean": (1, T.LongType(), T.BooleanType(), None, True),
    "boolean as text": (False, T.BooleanType(), T.StringType(), "false", False),
    "missing": (None, T.StringType(), T.IntegerType(), None, False),
}


@pytest.mark.parametrize("case", COPY)
def test_typed_copy(spark, case):
    value, source, target, want, loses = COPY[case]
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", source)]))
    schema = T.StructType([T.StructField("c", target)])
    got = typed_copy(df, schema).first().c
    assert (float(got) if want == 1.3 else got) == want
    if loses:
        with pytest.raises(Exception, match="does not fit"):
            typed_copy(df, schema, allow_truncation=False).collect()
    else:
        assert typed_copy(df, schema, allow_truncation=False).first().c == want


def test_shared_folder_is_the_session_s(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert run_dir(spark, "x").startswith(named)
    assert run_dir(spark, "x") != run_dir(spark, "x")
    assert stored(spark.range(3).filter(F.col("id") > 0)).count() == 2


def test_only_few_splits_are_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert spread(read_path(spark, str(tmp_path / "one"))).rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 20)
    assert spread(wide) is wide
