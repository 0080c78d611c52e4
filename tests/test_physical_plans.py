"""What the plans of the main operators must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from lakekit.operators.coverage import compile_rules, uncovered, uncovered_by_literals
from lakekit.operators.extract import block_lines, explode_lines, extract_ids, field_ids, notebook_ids
from lakekit.operators.reconcile import existing, reconcile
from lakekit.operators.rewrite import rewrite
from lakekit.operators.rollup import findings_per_unit, roll_up
from lakekit.sources import normalise_rules, read_path

RULES = "source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string, replacement string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "t")
    spark.range(40).select(
        F.col("id").alias("k"), F.lit("a\nb").alias("text"), F.lit("T").alias("item_type"), F.lit("p").alias("rel_path"), F.lit(1).alias("unused")
    ).write.parquet(path)
    return read_path(spark, path)


@pytest.fixture(scope="module")
def rules(spark):
    rows = [("f", 1, 1, "a", None, None, None, "b"), ("f", 1, 2, "(a)", "true", None, None, "c")]
    return normalise_rules(spark.createDataFrame(rows, RULES))


@pytest.mark.parametrize(
    "extract",
    [
        lambda t: extract_ids(explode_lines(t)).select("k", "id"),
        lambda t: block_lines(t).select("k", "line", "inside"),
        lambda t: notebook_ids(t).select("k", "id"),
        lambda t: field_ids(t).select("k", "id"),
    ],
    ids=["ids", "blocks", "notebook", "fields"],
)
def test_extraction_neither_shuffles_nor_reads_more_than_it_needs(texts, extract):
    got = plan(extract(texts))
    assert "Exchange" not in got and "Python" not in got
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", got)[1].split(",")) == {"k:bigint", "text:string"}


def test_field_filter_reaches_the_scan(texts):
    assert "StringContains(text" in plan(field_ids(texts, fields=["one"]).select("k", "id"))


def test_rewriting_does_not_move_the_texts(texts, rules):
    done = rewrite(texts.select("k", "text", "item_type", "rel_path"), rules, ["visit_no", "rule_no"])
    outer = plan(done).split("Subquery")[0]
    assert "Join" not in outer and "Exchange" not in outer and "Python" not in outer


def test_small_rules_are_broadcast_and_patterns_are_constants(texts, rules):
    occurrences = texts.select("k", "item_type", "rel_path", F.col("text").alias("id"), F.col("text").alias("context"))
    got = plan(uncovered(occurrences, rules))
    assert "BroadcastHashJoin" in got and "NestedLoop" not in got and "Cartesian" not in got
    assert "regexp_extract(text" in got


def test_many_rules_are_hashed_not_looped(texts, rules, monkeypatch):
    monkeypatch.setattr("lakekit.operators.coverage.fits_broadcast", lambda df: False)
    occurrences = texts.select("k", "item_type", "rel_path", F.col("text").alias("id"), F.col("text").alias("context"))
    texts.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = plan(uncovered_by_literals(occurrences, compile_rules(rules)))
    finally:
        texts.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in got and "NestedLoop" not in got and "_salt" in got


def test_reconciling_is_one_shuffle_of_combined_keys(texts):
    got = plan(reconcile(texts.select("k"), texts.filter("k > 3").select("k"), ["k"]))
    assert got.count("Exchange") == 1 and "Join" not in got
    assert got.count("partial_bool_or") > 0 or "partial_max" in got


def test_counts_are_combined_before_the_shuffle(texts):
    outcomes = texts.select("k", (F.col("k") > 3).alias("success"))
    assert "partial_count" in plan(roll_up(outcomes, ["k"]))
    findings = findings_per_unit(texts.select(F.col("k").alias("unit")), texts.select(F.col("k").alias("unit")))
    assert "partial_count" in plan(findings)


def test_semi_join_reduces_the_right_side_first(texts):
    got = plan(existing(texts.select("k", "unused"), texts.select("k"), ["k"]))
    assert "BroadcastHashJoin" in got and "LeftSemi" in got
