import pytest

from lakekit.operators.reconcile import discover_units, existing, find_by_name, missing, orphans, reconcile


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame([("Alpha", "id-1"), ("Beta", "id-2"), ("Beta", "id-0"), (None, "id-9")], "name string, id string")


def test_exact_name_gives_the_id(spark, inventory, as_rows):
    wanted = spark.createDataFrame([("Alpha",), ("alpha",), ("Beta",), ("Alpha ",), (None,)], "name string")
    assert as_rows(find_by_name(wanted, inventory)) == sorted(
        [("Alpha", "id-1"), ("alpha", None), ("Beta", "id-0"), ("Alpha ", None), (None, None)], key=repr
    )
    assert find_by_name(wanted, inventory.filter("false")).filter("id is not null").count() == 0


def test_grant_needs_every_part_of_the_key(spark, as_rows):
    grants = spark.createDataFrame([("w", "p", "Admin"), ("w", "q", "Viewer"), ("v", "p", "Viewer")], "w string, p string, r string")
    asked = spark.createDataFrame(
        [("w", "p", "Admin"), ("w", "p", "Viewer"), ("w", "q", "Admin"), ("v", "p", "Admin"), ("x", "p", "Admin")],
        "w string, p string, r string",
    )
    assert as_rows(existing(asked, grants, ["w", "p", "r"])) == [("w", "p", "Admin")]


def test_missing_is_created_once_and_is_idempotent(spark, as_rows):
    desired = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), (None, 3), ("", 4)], "k string, v int")
    actual = spark.createDataFrame([("a",), ("c",)], "k string")
    created = missing(desired, actual, ["k"])
    assert as_rows(created) == [("b", 1)]
    assert missing(desired, actual.union(created.select("k")), ["k"]).count() == 0


def test_orphans_keep_their_rows(spark, as_rows):
    actual = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3)], "k string, v int")
    desired = spark.createDataFrame([("a",), ("b",)], "k string")
    assert as_rows(orphans(actual, desired, ["k"])) == [("c", 2), ("c", 3)]
    assert orphans(actual, desired, ["k"], skip=True).count() == 0


def test_reconcile_covers_both_sides(spark, as_rows):
    desired = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    actual = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    assert as_rows(reconcile(desired, actual, ["k"])) == [("a", "keep"), ("b", "create"), ("c", "orphan")]


def test_units_are_sorted_and_need_a_configuration(spark):
    units = spark.createDataFrame([("Zebra",), ("Alpha",), ("Mike",), ("NoConfig",)], "unit string")
    owners = units.filter("unit <> 'NoConfig'")
    assert [r.unit for r in discover_units(units, owners).collect()] == ["Alpha", "Mike", "Zebra"]
    assert discover_units(units, owners.filter("false"), required=False).count() == 0
    with pytest.raises(ValueError, match="configuration"):
        discover_units(units, owners.filter("false"))
