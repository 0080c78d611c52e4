import pytest
from pyspark.sql import functions as F

from lakekit.operators.coverage import rejected_rules, uncovered
from lakekit.operators.extract import notebook_ids
from lakekit.operators.rewrite import resolve_replacements, rewrite
from lakekit.sources import normalise_rules

G = "11111111-aaaa-4bbb-8ccc-000000000001"
H = "22222222-aaaa-4bbb-8ccc-000000000002"
RULES = "source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string"
ORDER = ["visit_no", "rule_no"]


def rewritten(spark, text, rules, item_type="Notebook", rel_path="a/b.json", **options):
    """Rules as (find, is_regex, type, path, replacement), in order."""
    rows = [("f", 1, no, *rule) for no, rule in enumerate(rules)]
    table = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replacement string"))
    df = spark.createDataFrame([(text, item_type, rel_path)], "text string, item_type string, rel_path string")
    return rewrite(df, table, ORDER, **options).first().text


def rule(find, replacement, regex="false", item_type=None, path=None):
    return (find, regex, item_type, path, replacement)


CASES = {
    "every copy": ("x x", [rule("x", "y")], "y y"),
    "not a pattern": ("a.c abc", [rule("a.c", "$1\\")], "$1\\ abc"),
    "in order": ("a", [rule("a", "b"), rule("b", "c")], "c"),
    "against the order": ("a", [rule("b", "c"), rule("a", "b")], "b"),
    "only group 1": ('k: "g1" z "g1"', [rule(r'k: "(\w+)"', "new", "true")], 'k: "new" z "g1"'),
    "each match its own group": ("k=a k=b k=a", [rule(r"k=(\w)", "X", "true")], "k=X k=X k=X"),
    "no copy outside a match": ("zk=a k=a", [rule(r"\bk=(a)", "X", "true")], "zk=a k=X"),
    "whole match without a group": ("n12 n3", [rule("[0-9]+", "#", "true")], "n# n#"),
    "at both ends": ("aXa", [rule("a", "bb", "true")], "bbXbb"),
    "dollar in the replacement": ("a", [rule("(a)", "$1$items", "true")], "$1$items"),
    "empty matches change nothing": ("abc", [rule("x*", "-", "true")], "abc"),
    "absent group": ("k k=a", [rule("k(?:=(a))?", "X", "true")], "k k=X"),
    "group by place, not by text": ("id=1-11", [rule("id=([0-9]+)-[0-9]+", "X", "true")], "id=X-11"),
    "group after its own text": ("11-1", [rule("[0-9]+-([0-9])", "$2", "true")], "11-$2"),
    "flags before a group": ("K=a", [rule("(?i)k=(a)", "X", "true")], "K=X"),
    "brace that is a character": ('{"k": "a"}', [rule(r'{"k":\s*"(\w)"', "X", "true")], '{"k": "X"}'),
    "counted from zero": ("aab", [rule("a{,3}b", "X", "true")], "X"),
    "space beyond ASCII": ("k:\u00a0a", [rule(r"k:\s(a)", "X", "true")], "k:\u00a0X"),
    "pattern then literal": ("id=7", [rule("id=([0-9])", "seven", "true"), rule("seven", "7!")], "id=7!"),
    "other type": ("x", [rule("x", "y", item_type="CopyJob")], "x"),
    "path": ("x", [rule("x", "y", path="**/b.json"), rule("y", "z", path="c/*")], "y"),
}


@pytest.mark.parametrize("per_pass", [1000, 1])
def test_cases(spark, per_pass):
    """All cases at once: each text is of a type of its own, which limits the rules of its case to it."""
    rules, texts = [], []
    for no, (name, (text, case_rules, _)) in enumerate(CASES.items()):
        own = f"Type{no}"
        texts.append((name, text, own, "a/b.json"))
        rules += [("f", 1, len(rules) + i, r[0], r[1], r[2] or own, *r[3:]) for i, r in enumerate(case_rules)]
    table = normalise_rules(spark.createDataFrame(rules, f"{RULES}, replacement string"))
    df = spark.createDataFrame(texts, "name string, text string, item_type string, rel_path string")
    got = {r.name: r.text for r in rewrite(df, table, ORDER, rules_per_pass=per_pass).collect()}
    assert got == {name: want for name, (_, _, want) in CASES.items()}


def test_references_are_resolved_per_environment(spark):
    inventory = spark.createDataFrame(
        [
            ("dev", "Workspace", "", "id", "W-dev"),
            ("prod", "Workspace", "", "id", "W-prod"),
            ("prod", "Lakehouse", "lake.one", "id", "L-prod"),
            ("prod", "Lakehouse", "lake.one", "sqlendpoint", "S-prod"),
        ],
        "environment string, type string, name string, attribute string, value string",
    )
    values = [
        {"_ALL_": "$workspace.id"},
        {"_ALL_": "$workspace.$id"},
        {"_ALL_": "$items.Lakehouse.lake.one.$id"},
        {"_ALL_": "$items.Lakehouse.lake.one.sqlendpoint"},
        {"_ALL_": "plain", "prod": "own"},
        {"dev": "elsewhere"},
        {"_ALL_": "$items.Lakehouse.gone.id"},
    ]
    rows = [("f", 1, no, f"x{no}", None, None, None, value) for no, value in enumerate(values)]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replace_value map<string, string>"))
    got = resolve_replacements(rules, inventory, "prod").orderBy("rule_no").collect()
    assert [r.replacement for r in got] == ["W-prod", "W-prod", "L-prod", "S-prod", "own", None, None]


def test_rules_limited_by_item_name(spark):
    rows = [("f", 1, 1, "x", None, None, None, "y", "one"), ("f", 1, 2, "[z]", "true", None, None, "w", '["two", "three"]')]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replacement string, item_name string"))
    df = spark.createDataFrame(
        [("xz", "Notebook", "p", name) for name in ("one", "two", "four", None)],
        "text string, item_type string, rel_path string, item_name string",
    )
    assert {r.item_name: r.text for r in rewrite(df, rules, ORDER).collect()} == {"one": "yz", "two": "xw", "four": "xz", None: "xz"}
    assert {r.text for r in rewrite(df.drop("item_name"), rules, ORDER).collect()} == {"xz"}


def test_rules_and_references_of_one_unit(spark):
    rows = [("f", 1, 1, "aaa", None, None, None, "u1", "$workspace.id"), ("f", 1, 1, "aaa", None, None, None, "u2", "$workspace.id")]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, unit string, given string"))
    rules = rules.withColumn("replace_value", F.create_map(F.lit("_ALL_"), "given"))
    inventory = spark.createDataFrame(
        [("u1", "dev", "Workspace", "", "id", "one"), ("u2", "dev", "Workspace", "", "id", "two")],
        "unit string, environment string, type string, name string, attribute string, value string",
    )
    resolved = resolve_replacements(rules, inventory, "dev", by=["unit"])
    df = spark.createDataFrame(
        [("aaa", "Notebook", "p", unit) for unit in ("u1", "u2", "u3", None)], "text string, item_type string, rel_path string, unit string"
    )
    for per_pass in (1000, 1):
        done = rewrite(df, resolved, ORDER, by=["unit"], rules_per_pass=per_pass).collect()
        assert {r.unit: r.text for r in done} == {"u1": "one", "u2": "two", "u3": "aaa", None: "aaa"}


def test_ties_in_order_fall_alike_in_any_number_of_passes(spark):
    rows = [("b.yml", 1, 1, "y", None, None, None, "z"), ("a.yml", 1, 1, "x", None, None, None, "y"), ("c.yml", 1, 1, "z", None, None, None, "w")]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replacement string"))
    df = spark.createDataFrame([("x", "Notebook", "p")], "text string, item_type string, rel_path string")
    assert [rewrite(df, rules, ORDER, rules_per_pass=n).first().text for n in (1000, 2, 1)] == ["w", "w", "w"]


def test_rules_that_do_not_compile_are_listed_and_refused(spark):
    rows = [("f", 1, 1, "(", "true", None, None, "X"), ("f", 1, 2, "(", "false", None, None, "X"), ("f", 1, 3, "(a)", "true", None, None, "X")]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replacement string"))
    assert [(r.rule_no, r.reason) for r in rejected_rules(rules).collect()] == [(1, "pattern does not compile")]
    with pytest.raises(ValueError, match="compile"):
        rewritten(spark, "(", [rule("(", "X", "true")])


def test_unresolved_replacement_stops(spark):
    with pytest.raises(ValueError, match="resolved"):
        rewritten(spark, "x", [rule("x", None)])


def test_nothing_is_left_to_map_after_rewriting(spark):
    text = f'# META "default_lakehouse": "{G}"\n# META "known_lakehouses": ["{G}", "{H}"]'
    rows = [
        ("f", 1, 1, f'"default_lakehouse": "([0-9a-f-]{{36}})"', "true", None, None, "target"),
        ("f", 1, 2, G, "false", None, None, "target"),
        ("f", 1, 3, H, "false", "Notebook", None, "target"),
    ]
    rules = normalise_rules(spark.createDataFrame(rows, f"{RULES}, replacement string"))
    df = spark.createDataFrame([(text, "Notebook", "n.json")], "text string, item_type string, rel_path string")
    assert notebook_ids(df).count() == 3
    assert uncovered(notebook_ids(df), rules).count() == 0
    done = rewrite(df, rules, ORDER)
    assert notebook_ids(done).count() == 0
    assert done.filter(F.contains("text", F.lit("-aaaa-"))).count() == 0
