"""Hand-traced cases of rule coverage, each through every way of running it."""

import pytest
from pyspark.sql import functions as F

from lakekit.operators import coverage
from lakekit.operators.coverage import compile_rules, uncovered, uncovered_by_literals, uncovered_by_patterns
from lakekit.sources import normalise_rules

G = "aaaaaaaa-1111-4111-8111-000000000001"
H = "bbbbbbbb-1111-4111-8111-000000000002"
ID = "([0-9a-f-]{36})"
SILVER = "x/2_Silver/t/n.Notebook/notebook-content.py"
GOLD = "x/3_Gold/t/n.Notebook/notebook-content.py"

# name: (find_value, is_regex, item_type, file_path), id, line, item type, path, covered
CASES = {
    "literal": ((G, "false", None, None), G, "l", "Notebook", SILVER, True),
    "literal is case sensitive": ((G, "false", None, None), G.upper(), "l", "Notebook", SILVER, False),
    "literal is not a pattern": ((".*", "false", None, None), G, "l", "Notebook", SILVER, False),
    "group is the id": ((f'"k": "{ID}"', "true", None, None), G, f'"k": "{G}"', "Notebook", SILVER, True),
    "group is another id": ((f'"k": "{ID}"', "true", None, None), H, f'"k": "{G}" "{H}"', "Notebook", SILVER, False),
    "match holds the id": (('"k": ".*"', "true", None, None), G, f'"k": "{G}"', "Notebook", SILVER, True),
    "match holds no id": (('"k":', "true", None, None), G, f'"k": "{G}"', "Notebook", SILVER, False),
    "non-capturing group": (("(?:k|j): .*", "true", None, None), G, f"j: {G}", "Notebook", SILVER, True),
    "escaped bracket": ((r"\(k\) .*", "true", None, None), G, f"(k) {G}", "Notebook", SILVER, True),
    "bracket in a class": (("[(]k[)] .*", "true", None, None), G, f"(k) {G}", "Notebook", SILVER, True),
    "named group": ((f"k=(?P<the_id>{ID[1:]}", "true", None, None), G, f"k={G}", "Notebook", SILVER, True),
    "look-ahead": ((f"(?=k)k={ID}", "true", None, None), G, f"k={G}", "Notebook", SILVER, True),
    "group takes no part": ((f"k(?:={ID})?", "true", None, None), G, f"k {G}", "Notebook", SILVER, False),
    "first match": ((f"k={ID}", "true", None, None), G, f"k={G} k={H}", "Notebook", SILVER, True),
    "second match": ((f"k={ID}", "true", None, None), H, f"k={G} k={H}", "Notebook", SILVER, False),
    "does not compile": (("k=(", "true", None, None), G, f"k=({G}", "Notebook", SILVER, False),
    "type": ((G, "false", "Notebook", None), G, "l", "Notebook", SILVER, True),
    "other type": ((G, "false", "Notebook", None), G, "l", "CopyJob", SILVER, False),
    "one of the types": ((f"k={ID}", "true", '["CopyJob", "Notebook"]', None), G, f"k={G}", "Notebook", SILVER, True),
    "none of the types": ((f"k={ID}", "true", '["CopyJob"]', None), G, f"k={G}", "Notebook", SILVER, False),
    "path": ((G, "false", None, "**/2_Silver/**/notebook-content.py"), G, "l", "Notebook", SILVER, True),
    "other path": ((G, "false", None, "**/2_Silver/**/notebook-content.py"), G, "l", "Notebook", GOLD, False),
    "pattern path": ((f"k={ID}", "true", None, '["1*", "**/3_Gold/**"]'), G, f"k={G}", "Notebook", GOLD, True),
    "pattern other path": ((f"k={ID}", "true", None, "**/1_Bronze/**"), G, f"k={G}", "Notebook", GOLD, False),
    "id after column 120": ((f"k={ID}", "true", None, None), G, "-" * 150 + f"k={G}", "Notebook", SILVER, True),
}
RULES = "unit string, source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string"


@pytest.fixture(scope="module")
def tables(spark):
    """Every case is a unit of its own, so a rule meets only its own occurrence."""
    rules = [(name, "f", 1, no, *case[0]) for no, (name, case) in enumerate(CASES.items())]
    occurrences = [(name, *case[1:5]) for name, case in CASES.items()]
    return (
        spark.createDataFrame(occurrences, "unit string, id string, context string, item_type string, rel_path string"),
        normalise_rules(spark.createDataFrame(rules, RULES)),
    )


@pytest.fixture(params=["constants", "indexed", "shuffled"])
def way(request, monkeypatch):
    """The ways a rule table may be held against the occurrences, by its size."""
    if request.param != "constants":
        monkeypatch.setattr(coverage, "INLINE_RULES", 0)
        monkeypatch.setattr(uncovered_by_patterns, "__defaults__", (None, 0))
    if request.param == "shuffled":
        monkeypatch.setattr(coverage, "fits_broadcast", lambda df: False)
    return request.param


def test_cases(tables, way):
    left = {r.unit for r in uncovered(*tables, by=["unit"]).collect()}
    assert left == {name for name, case in CASES.items() if not case[5]}


def test_without_units_every_rule_counts(spark, tables, way, as_rows):
    occurrences, rules = tables
    left = uncovered(occurrences.filter("unit = 'literal'"), rules.filter("unit <> 'literal'"))
    assert left.count() == 0
    none = uncovered(occurrences, rules.filter("false"))
    assert as_rows(none) == as_rows(occurrences)


def test_hot_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(coverage, "fits_broadcast", lambda df: False)
    occurrences = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, G).otherwise(H).alias("oid"), F.col("id").alias("line_no")
    ).select(F.col("oid").alias("id"), "line_no", F.lit("T").alias("item_type"), F.lit("p").alias("rel_path"))
    rule = spark.createDataFrame([("f", 1, 1, G, None, None, None)], RULES.removeprefix("unit string, "))
    left = uncovered_by_literals(occurrences, compile_rules(normalise_rules(rule)))
    assert (left.count(), left.filter(F.col("id") == G).count()) == (1667, 0)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "_rule_salt" in plan
