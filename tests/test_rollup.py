import json

import pytest
from pyspark.sql import functions as F

from lakekit.operators.rollup import (
    count_by,
    findings_per_unit,
    flatten_document,
    flatten_fragments,
    gate,
    overall,
    result_document,
    roll_up,
    roll_up_requested,
)

OUTCOMES = "environment string, duration double, folder string, name string, success boolean, error string"


def whole(fragments, run):
    """The documents, by their run, put together by position."""
    texts = {}
    for row in sorted(fragments.collect(), key=lambda r: r.position):
        texts[row[run]] = texts.get(row[run], "") + row.fragment
    return {name: json.loads(text) for name, text in texts.items()}


def outcomes(spark):
    rows = [
        ("dev", 12.5, "Zebra", "[D] Zebra", True, ""),
        ("dev", 12.5, "Alpha", "[D] Alpha", False, "broken"),
        ("dev", 12.5, "Mike", "", True, None),
    ]
    return spark.createDataFrame(rows, OUTCOMES)


def test_counts(spark, as_rows):
    assert as_rows(roll_up(outcomes(spark))) == [(3, 2, 1)]
    assert as_rows(roll_up(outcomes(spark).filter("false"))) == [(0, 0, 0)]


def test_without_outcomes_all_requested_failed(spark, as_rows):
    requested = outcomes(spark).select("folder")
    assert as_rows(roll_up_requested(requested, outcomes(spark).filter("false"), ["folder"])) == [(3, 0, 3)]
    assert as_rows(roll_up_requested(requested, outcomes(spark).filter("success"), ["folder"])) == [(3, 2, 1)]


def test_document_is_sorted_by_name(spark):
    assert whole(result_document(outcomes(spark), ["environment", "duration"]), "environment") == {
        "dev": {
            "environment": "dev",
            "duration": 12.5,
            "total_workspaces": 3,
            "successful_count": 2,
            "failed_count": 1,
            "workspaces": [
                {"name": "Alpha", "full_name": "[D] Alpha", "status": "failure", "error": "broken"},
                {"name": "Mike", "full_name": "Mike", "status": "success", "error": ""},
                {"name": "Zebra", "full_name": "[D] Zebra", "status": "success", "error": ""},
            ],
        }
    }


@pytest.mark.parametrize("size", [1, 5, 50_000])
def test_a_document_has_one_form_at_every_size(spark, size):
    many = spark.range(size).select(
        F.when(F.col("id") % 3 == 0, "test").otherwise("prod").alias("environment"),
        F.format_string("u%06d", F.col("id") % 20_000).alias("folder"),
        F.lit("").alias("name"),
        (F.col("id") % 5 > 0).alias("success"),
        F.lit("").alias("error"),
    )
    got = whole(result_document(many.repartition(5), ["environment"]), "environment")
    wanted = {"test": [], "prod": []}
    for no in range(size):
        wanted["prod" if no % 3 else "test"].append(f"u{no % 20_000:06d}")
    assert {e: [w["name"] for w in d["workspaces"]] for e, d in got.items()} == {e: sorted(n) for e, n in wanted.items() if n}
    assert all(d["total_workspaces"] == len(d["workspaces"]) for d in got.values())


def test_runs_without_a_name_and_without_outcomes(spark):
    unnamed = outcomes(spark).withColumn("environment", F.lit(None).cast("string"))
    got = whole(result_document(unnamed, ["environment"]), "environment")
    assert [(w["name"], got[None]["total_workspaces"]) for w in got[None]["workspaces"]] == [("Alpha", 3), ("Mike", 3), ("Zebra", 3)]
    assert [r.total_workspaces for r in flatten_fragments(result_document(unnamed, ["environment"]), ["environment"]).collect()] == [3, 3, 3]
    assert result_document(unnamed.filter("false"), ["environment"]).count() == 0


def test_flattening_gives_the_outcomes_back(spark, as_rows):
    wanted = [("Alpha", "failure", "broken"), ("Mike", "success", ""), ("Zebra", "success", "")]
    fragments = result_document(outcomes(spark), ["environment"])
    assert as_rows(flatten_fragments(fragments, ["environment"]).select("name", "status", "error")) == wanted
    text = json.dumps(whole(fragments, "environment")["dev"])
    flat = flatten_document(spark.createDataFrame([(text,)], "document string"), {"environment": "string"})
    assert as_rows(flat.select("name", "status", "error")) == wanted


def test_gate(spark, as_rows):
    assert as_rows(gate(spark.range(5))) == [(True, 1)]
    assert as_rows(gate(spark.range(0))) == [(False, 0)]


def test_clean_units_are_reported(spark, as_rows):
    units = spark.createDataFrame([("a",), ("b",), ("a",)], "unit string")
    findings = spark.createDataFrame([("a", 1), ("a", 2)], "unit string, n int")
    per_unit = findings_per_unit(units, findings)
    assert as_rows(per_unit) == [("a", 2, False), ("b", 0, True)]
    assert as_rows(overall(per_unit)) == [(2, 1, 2)]


def test_count_by(spark, as_rows):
    items = spark.createDataFrame([("Lakehouse",), ("Notebook",), ("Lakehouse",)], "type string")
    assert as_rows(count_by(items, "type")) == [("Lakehouse", 2), ("Notebook", 1)]
