"""Whole pipelines on a small authored tree."""

import json

import pytest
from pyspark.sql import functions as F

from lakekit.plans.audit import audit_corpus
from lakekit.plans.reconciliation import reconcile_and_report
from lakekit.sources import normalise_rules

SPACE = "10000000-0000-4000-8000-00000000000a"
SILVER = "20000000-0000-4000-8000-00000000000b"
BRONZE = "30000000-0000-4000-8000-00000000000c"
ZERO = "00000000-0000-4000-8000-000000000000"
TARGET = "40000000-0000-4000-8000-00000000000d"

NOTEBOOK = f"""# notebook
# META {{
# META   "default_lakehouse": "{SILVER}",
# META   "default_lakehouse_name": "silver",
# META   "default_lakehouse_workspace_id": "{SPACE}",
# META   "known_lakehouses": [
# META     {{
# META       "id": "{BRONZE}"
# META     }},
# META     {{
# META       "id": "{SILVER}"
# META     }}
# META   ]
# META }}
text = "{TARGET}"
"""
COPY = f'{{\n  "workspaceId": "{ZERO}",\n  "artifactId": "{TARGET}",\n  "id": "{SPACE}"\n}}\n'
PAIR = '"{}":\\s*"([0-9a-f]{{8}}-[0-9a-f-]{{27}})"'
RULES = [
    (PAIR.format("default_lakehouse_workspace_id"), "true", "Notebook", None),
    (PAIR.format("default_lakehouse"), "true", "Notebook", "**/2_Silver/**/notebook-content.py"),
    (SILVER, None, "Notebook", None),
    (ZERO, None, "CopyJob", None),
    (TARGET, None, "CopyJob", None),
    (BRONZE, None, "Notebook", None),
]


def rule_entry(rule):
    keys = ["find_value", "is_regex", "item_type", "file_path"]
    return {k: v for k, v in zip(keys, rule) if v is not None}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "units"
    files = {
        "First Unit/config.yml": "core:",
        "First Unit/parameter.yml": "extend:\n- ./templates/all.yml\n",
        "First Unit/templates/all.yml": json.dumps({"find_replace": [rule_entry(r) for r in RULES]}),
        "First Unit/2_Silver/t/one.Notebook/notebook-content.py": NOTEBOOK,
        "First Unit/2_Silver/t/two.Notebook/notebook-content.py": NOTEBOOK,
        "First Unit/1_Bronze/in.CopyJob/copy-content.json": COPY,
        "First Unit/1_Bronze/lake.Lakehouse/shortcuts.metadata.json": f'{{"connectionId": "{SPACE}"}}',
        "[D] Second, Unit/config.yml": "core:",
        "[D] Second, Unit/in.CopyJob/copy-content.json": COPY,
        "No Config/in.CopyJob/copy-content.json": COPY,
    }
    for name, content in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    return str(root)


def rule_table(spark, rules):
    rows = [(unit, unit, 1, no, *rule) for no, (unit, rule) in enumerate(rules)]
    schema = "unit string, source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string"
    return normalise_rules(spark.createDataFrame(rows, schema))


def test_every_id_of_the_unit_is_covered(spark, tree, as_rows):
    rules = rule_table(spark, [("First Unit", r) for r in RULES])
    audit = audit_corpus(spark, tree, rules, unit="First Unit")
    assert audit.findings.count() == 0
    assert as_rows(audit.per_unit) == [("First Unit", 0, True)]
    assert as_rows(audit.gate) == [(False, 0)]


def test_a_missing_rule_shows_in_each_notebook(spark, tree):
    rules = rule_table(spark, [("First Unit", r) for r in RULES if r[0] != BRONZE])
    found = audit_corpus(spark, tree, rules, unit="First Unit").findings.collect()
    assert [(r.file, r.item_type, r.field_name, r.id) for r in found] == [
        (f"units/First Unit/2_Silver/t/{n}.Notebook/notebook-content.py", "Notebook", "known_lakehouses", BRONZE)
        for n in ("one", "two")
    ]
    assert found[0].context == f'# META       "id": "{BRONZE}"'


def test_rules_end_at_their_unit(spark, tree, as_rows):
    rules = rule_table(spark, [("First Unit", r) for r in RULES])
    audit = audit_corpus(spark, tree, rules)
    assert [(r.unit, r.field_name) for r in audit.findings.collect()] == [
        ("[D] Second, Unit", "artifactId"),
        ("[D] Second, Unit", "workspaceId"),
    ]
    assert as_rows(audit.per_unit) == [("First Unit", 0, True), ("[D] Second, Unit", 2, False)]
    assert as_rows(audit.gate) == [(True, 1)]


def test_without_rules_every_occurrence_is_a_finding(spark, tree):
    audit = audit_corpus(spark, tree, rule_table(spark, [("Other", RULES[0])]), unit="First Unit")
    assert audit.findings.count() == 10


def test_unknown_unit_stops(spark, tree):
    with pytest.raises(ValueError, match="no unit named 'Third'"):
        audit_corpus(spark, tree, rule_table(spark, [("Other", RULES[0])]), unit="Third")


def test_reconciled_run_is_reported(spark, as_rows):
    desired = spark.createDataFrame([("a", "dev"), ("b", "dev"), ("c", "dev")], "folder string, environment string")
    actual = spark.createDataFrame([("b",), ("z",)], "folder string")
    outcomes = spark.createDataFrame(
        [("a", "A", True, "", "dev"), ("b", "", False, "broken", "dev")],
        "folder string, name string, success boolean, error string, environment string",
    )
    run = reconcile_and_report(desired, actual, outcomes, ["folder"], ["environment"])
    assert as_rows(run.actions) == [("a", "create"), ("b", "keep"), ("c", "create"), ("z", "orphan")]
    assert as_rows(run.action_counts) == [("create", 2), ("keep", 1), ("orphan", 1)]
    assert as_rows(run.summary) == [("dev", 3, 1, 2)]
    assert '"failed_count":1' in run.documents.filter("position = 0").first().fragment


def test_one_unit_whose_name_looks_like_a_wildcard(spark, tree, as_rows):
    rules = rule_table(spark, [("[D] Second, Unit", (ZERO, None, None, None))])
    audit = audit_corpus(spark, tree, rules, unit="[D] Second, Unit")
    assert as_rows(audit.findings.select("field_name")) == [("artifactId",)]
    assert as_rows(audit.per_unit) == [("[D] Second, Unit", 1, False)]


def test_rules_of_the_units_own_files(spark, tree, as_rows):
    pytest.importorskip("yaml")
    audit = audit_corpus(spark, tree)
    assert as_rows(audit.per_unit) == [("First Unit", 0, True), ("[D] Second, Unit", 2, False)]


def test_trees_without_rules_or_units(spark, tmp_path, as_rows):
    pytest.importorskip("yaml")
    file = tmp_path / "u" / "in.CopyJob" / "copy.json"
    file.parent.mkdir(parents=True)
    file.write_text(COPY)
    nothing = audit_corpus(spark, str(tmp_path))
    assert (nothing.findings.count(), nothing.per_unit.count(), as_rows(nothing.gate)) == (0, 0, [(False, 0)])
    (tmp_path / "u" / "config.yml").write_text("core:")
    assert as_rows(audit_corpus(spark, str(tmp_path)).per_unit) == [("u", 2, False)]
