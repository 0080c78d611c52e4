import pytest
from pyspark.sql import functions as F

from lakekit.functions import display_name, status_of
from lakekit.operators.checks import (
    in_domain,
    look_up,
    only_unit,
    outside_domain,
    quarantine,
    require_domain,
    require_mapping,
    without_mapping,
)


@pytest.fixture(scope="module")
def environments(spark):
    return spark.createDataFrame([("dev",), ("TEST",), ("Prod",), ("staging",), ("",), (None,)], "e string")


def test_domain(environments, as_rows):
    assert as_rows(outside_domain(environments, "e")) == sorted([("staging",), ("",), (None,)], key=repr)
    assert require_domain(environments.limit(3), "e").count() == 3
    with pytest.raises(Exception, match="invalid value 'staging', must be one of: dev, prod, test"):
        require_domain(environments.filter("e = 'staging'"), "e").collect()
    wrong = require_domain(environments.withColumn("n", F.lit(1)), "e")
    for checked in (wrong.count, wrong.select("n").collect):
        with pytest.raises(Exception, match="invalid value"):
            checked()


def test_environment_map(spark, as_rows):
    names = spark.createDataFrame([("dev", "[D] X"), ("prod", "[P] X")], "e string, name string")
    asked = spark.createDataFrame([("dev",), ("test",)], "e string")
    assert as_rows(look_up(asked, names, "e", "name")) == sorted([("dev", "[D] X"), ("test", None)], key=repr)
    assert as_rows(without_mapping(asked, names, "e")) == [("test",)]
    with pytest.raises(Exception, match="no mapping for 'test'"):
        require_mapping(asked, names, "e", "name").collect()
    with pytest.raises(Exception, match="no mapping for 'test'"):
        require_mapping(asked, names, "e", "name").count()
    with pytest.raises(Exception, match="no mapping for 'test'"):
        require_mapping(asked, names, "e", "name").select("e").collect()
    assert require_mapping(asked.filter("e = 'dev'"), names, "e", "name").first().name == "[D] X"


def test_one_unit(spark, as_rows):
    units = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, n int")
    assert as_rows(only_unit(units, "b")) == [("b", 2)]
    with pytest.raises(ValueError, match="no unit named 'B'"):
        only_unit(units, "B")


def test_values(spark, as_rows):
    df = spark.createDataFrame([("n", "f", True), ("", "f", False), (None, "f", True)], "n string, f string, ok boolean")
    got = df.select(display_name(F.col("n"), F.col("f")), status_of(F.col("ok")))
    assert as_rows(got) == [("f", "failure"), ("f", "success"), ("n", "success")]


def test_quarantine_counts_while_it_writes(spark, environments, as_rows, tmp_path):
    rows = environments.withColumn("n", F.length("e"))
    checked = quarantine(rows, {"domain": in_domain("e"), "short": F.col("n") < 5}, f"{tmp_path}/q")
    assert as_rows(checked.valid) == [("Prod", 4), ("TEST", 4), ("dev", 3)]
    assert as_rows(checked.rejected) == sorted([("", 0, ["domain"]), ("staging", 7, ["domain", "short"]), (None, None, ["domain", "short"])], key=repr)
    assert as_rows(checked.violations) == [("domain", 3, 6), ("short", 2, 6)]
    assert as_rows(checked.gate) == [(True, 1)]
    clean = quarantine(rows.filter("e = 'dev'"), {"domain": in_domain("e")})
    assert as_rows(clean.gate) == [(False, 0)] and clean.rejected.count() == 0
    none = quarantine(rows.limit(0), {"domain": in_domain("e")})
    assert as_rows(none.violations) == [("domain", 0, 0)] and none.valid.columns == ["e", "n"]
