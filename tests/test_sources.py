import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lakekit.functions import glob_to_regex, item_name, item_type, matches_any_glob, relative_to
from lakekit.sources import (
    flatten_rule_files,
    link_external,
    normalise_rules,
    read_corpus,
    read_folder,
    read_path,
    read_rule_files,
    read_table,
    read_unit_rules,
)
from lakekit.sources.corpus import config_files, hidden_folders
from lakekit.sources.rule_files import reached_rule_files

G = "11111111-aaaa-4bbb-8ccc-000000000001"
RULES = "source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string"


def test_wildcard_reads_one_folder_only(spark, tmp_path):
    top = str(tmp_path / "in")
    spark.range(100).coalesce(2).write.parquet(top)
    (tmp_path / "in" / "note.txt").write_text("not parquet")
    spark.range(50).write.parquet(f"{top}/sub")
    spark.range(50).write.parquet(f"{top}/k=v")
    assert read_folder(spark, top).count() == 100
    with pytest.raises(AnalysisException):
        read_folder(spark, top, "*.nothing")


def test_wildcard_reads_dataset_directories(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "b.parquet"))
    assert read_folder(spark, str(tmp_path)).count() == 12


def test_read_by_name_and_path(spark, tmp_path, as_rows):
    path = str(tmp_path / "t")
    spark.range(3).write.option("path", path).saveAsTable("by_name")
    assert as_rows(read_table(spark, "by_name")) == as_rows(read_path(spark, path)) == [(0,), (1,), (2,)]
    assert as_rows(read_table(spark, "spark_catalog.default.by_name")) == [(0,), (1,), (2,)]


def test_links_show_files_and_leave_them(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "out" / "part"))
    linked = link_external(spark, "linked", str(tmp_path / "out"), "/part/")
    assert linked.count() == 4
    spark.sql("DROP TABLE linked")
    assert read_path(spark, str(tmp_path / "out" / "part")).count() == 4
    assert link_external(spark, "linked_view", str(tmp_path / "out" / "part"), temporary=True).count() == 4


def test_corpus_files(spark, tmp_path, as_rows):
    files = {
        "My Unit/1/a.Notebook/notebook-content.py": b"x",
        "My Unit/1/b.CopyJob/copy-content.json": "é".encode(),
        "My Unit/l.Lakehouse/shortcuts.metadata.json": b"{}",
        "My Unit/l.Lakehouse/alm.settings.json": b"{}",
        "My Unit/l.Lakehouse/x.metadata.json": b"{}",
        "My Unit/a.DataAgent/Files/stage_config.json": b"{}",
        "My Unit/c.Notebook/other.py": b"x",
        "My Unit/c.Notebook/bad.json": b"\xff\xfe",
        "My Unit/plain/file.json": b"{}",
        "My Unit/config.yml": b"core:",
        "Other/d.Report/r.json": b"{}",
        "Other/sub/config.yml": b"core:",
    }
    root = tmp_path / "units"
    for name, content in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    got = read_corpus(spark, str(root)).select("unit", "rel_path", "file", "item_type", "text")
    assert as_rows(got) == [
        ("My Unit", "1/a.Notebook/notebook-content.py", "units/My Unit/1/a.Notebook/notebook-content.py", "Notebook", "x"),
        ("My Unit", "1/b.CopyJob/copy-content.json", "units/My Unit/1/b.CopyJob/copy-content.json", "CopyJob", "é"),
        ("Other", "d.Report/r.json", "units/Other/d.Report/r.json", "Report", "{}"),
    ]
    assert as_rows(read_corpus(spark, root.as_uri()).select("file")) == as_rows(got.select("file"))
    assert as_rows(config_files(spark, str(root))) == [("My Unit",)]


def test_item_type_of_a_path(spark):
    cases = {
        "My.Project/a.Notebook/notebook-content.py": "Project",
        "/x/a.Notebook/f.json": "Notebook",
        "x/a.nb/f": "Unknown",
        "x/a.Ab/f": "Unknown",
        "x/a.Not3book/f": "Unknown",
        "x/a.v1.Report/f": "Report",
        "x/.Hidden/f": "Hidden",
        "x/f.Json": "Json",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", item_type(F.col("p")).alias("t"))
    assert {r.p: r.t for r in df.collect()} == cases


def test_item_name_of_a_path(spark):
    cases = {"x/a b.c.Notebook/f.json": "a b.c", "p/My.Project/a.Notebook/f": "My", "x/f.json": ""}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", item_name(F.col("p")).alias("t"))
    assert {r.p: r.t for r in df.collect()} == cases


def test_relative_paths(spark):
    cases = {"/r/a/b": "a/b", "\\r\\a\\b": "a/b", "/other/a": "/other/a", "/rx/a": "/rx/a"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", relative_to(F.col("p"), "/r/").alias("t"))
    assert {r.p: r.t for r in df.collect()} == cases


def test_globs(spark):
    cases = [
        ("**/2_Silver/**/notebook-content.py", "x/2_Silver/t/n.Notebook/notebook-content.py", True),
        ("**/2_Silver/**/notebook-content.py", "3_Gold/t/n.Notebook/notebook-content.py", False),
        ("*.json", "a/b.json", True),
        ("/a/*.json", "x/a/b.json", True),
        ("a/*.json", "a/b/c.json", False),
        ("a/**.json", "a/b/c.json", True),
        ("b.json", "a/bxjson", False),
        ("a?c", "abc", True),
        ("a?c", "a/c", False),
        ("..\\a\\b", "a/b", True),
        ("(x)[1]", "q/(x)[1]", True),
        ("a", "a/b", False),
        ("", "anything", True),
        ("$HOME", "a/$HOME", True),
    ]
    df = spark.createDataFrame(cases, "g string, p string, want boolean")
    got = df.select("g", "p", "want", matches_any_glob(F.col("p"), F.array("g")).alias("got"), glob_to_regex(F.col("g")).alias("r"))
    assert [tuple(r) for r in got.filter("want <> got").collect()] == []
    none = df.select(matches_any_glob(F.col("p"), F.array().cast("array<string>")).alias("got"))
    assert all(r.got for r in none.collect())


def test_rule_rows_are_normalised(spark):
    rows = [
        ("f", 1, 1, "  G \n", "TRUE", "Notebook", '["a", "b"]'),
        ("f", 1, 2, "  ", "true", None, None),
        ("f", 1, 3, None, "yes", "[broken", ""),
        ("f", 2, 1, "again", None, None, None),
        ("g", 3, 1, "H", None, "[]", "[null]"),
    ]
    got = normalise_rules(spark.createDataFrame(rows, RULES)).orderBy("visit_no", "rule_no").collect()
    assert [(r.find_value, r.is_regex, r.item_types, r.file_paths) for r in got] == [
        ("G", True, ["Notebook"], ["a", "b"]),
        ("None", False, ["[broken"], [""]),
        ("H", False, [], ["None"]),
    ]


def rule_files(spark, graph):
    rows = [(name, json.dumps(extend), [(f"{name}{i}", "false", None, None) for i in (1, 2)]) for name, extend in graph.items()]
    rule = "struct<find_value string, is_regex string, item_type string, file_path string>"
    return spark.createDataFrame(rows, f"source_file string, extend string, find_replace array<{rule}>")


@pytest.mark.parametrize(
    ("graph", "order"),
    [
        ({"root": ["b", "a"], "a": [], "b": [], "unused": []}, "b a root"),
        ({"root": ["a", "b"], "a": ["c"], "b": ["c"], "c": []}, "c a b root"),
        ({"root": ["a"], "a": ["b"], "b": ["root"]}, "b a root"),
        ({"root": ["root", "gone"], "a": []}, "root"),
        ({"root": ["a", "b"], "a": ["x"], "b": ["y"], "x": ["b"], "y": []}, "y b x a root"),
    ],
)
def test_extended_files_come_first_and_once(spark, graph, order):
    starts = spark.createDataFrame([("u", "root"), ("none", "missing")], "unit string, source_file string")
    flat = flatten_rule_files(rule_files(spark, graph), starts)
    got = [r.find_value for r in normalise_rules(flat).orderBy("visit_no", "rule_no").collect()]
    assert got == [f"{name}{i}" for name in order.split() for i in (1, 2)]


def test_units_share_parents(spark):
    files = rule_files(spark, {"one": ["shared"], "two": ["own", "shared"], "own": [], "shared": []})
    starts = spark.createDataFrame([("1", "one"), ("2", "two")], "unit string, source_file string")
    rules = normalise_rules(flatten_rule_files(files, starts)).orderBy("unit", "visit_no", "rule_no").collect()
    assert [f"{r.unit}:{r.source_file}" for r in rules[::2]] == ["1:shared", "1:one", "2:own", "2:shared", "2:two"]


def test_rule_files_are_parsed(spark, tmp_path):
    pytest.importorskip("yaml")
    files = {
        "u/parameter.yml": "extend: ./t/a.yml\nfind_replace:\n- find_value: ' x '\n- not a rule\n- item_type: Notebook\n",
        "u/t/a.yml": (
            "extend: ['../../shared.yaml', ../parameter.yml]\nfind_replace:\n"
            "- find_value:\n  is_regex: true\n  item_type: [A, B]\n  file_path: '**/x'\n  replace_value: {_ALL_: $workspace.id}\n"
        ),
        "other.yml": "when: 2024-99-99",
        "shared.yaml": '{"find_replace": [{"find_value": 5, "is_regex": "yes", "item_type": 3}]}',
        "u/broken.yml": "a: [",
        "u/list.yml": "- a",
        "v/parameter.yml": "find_replace:",
    }
    for name, content in files.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    assert {r.source_file for r in read_rule_files(spark, str(tmp_path)).collect()} == set(files) - {"other.yml", "u/broken.yml", "u/list.yml"}
    units = spark.createDataFrame([("u",), ("v",), ("w",)], "unit string")
    got = read_unit_rules(spark, str(tmp_path), units).orderBy("visit_no", "rule_no").collect()
    assert [(r.unit, r.find_value, r.is_regex, r.item_types, r.file_paths, r.replace_value) for r in got] == [
        ("u", "5", False, [], [], {}),
        ("u", "None", True, ["A", "B"], ["**/x"], {"_ALL_": "$workspace.id"}),
        ("u", "x", False, [], [], {}),
    ]


def written(root, files):
    for name, content in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_folders_that_spark_hides_are_scanned(spark, tmp_path, as_rows):
    root = tmp_path / "units [1]"
    files = ["u/a.Notebook/x.json", "u/_old/x.CopyJob/c.json", "_v/.b/_c/d.Report/e.json", "u/_k=v/x.CopyJob/c.json", "u/_old/_older/y.Report/c.json"]
    written(root, {name: "{}" for name in files} | {"u/config.yml": "", "_v/config.yml": "", "u/a/config.yml": ""})
    assert as_rows(read_corpus(spark, str(root)).select(F.concat_ws("/", "unit", "rel_path"))) == sorted((f,) for f in files)
    one = read_corpus(spark, root.as_uri().replace("%5B", "[").replace("%5D", "]").replace("%20", " "), unit="_v")
    assert as_rows(one.select("unit", "rel_path")) == [("_v", ".b/_c/d.Report/e.json")]
    assert sorted(f.rsplit("/", 1)[1] for f in hidden_folders(spark, str(root))) == [".b", "_c", "_old", "_older", "_v"]
    assert as_rows(config_files(spark, str(root))) == [("_v",), ("u",)]
    assert config_files(spark, str(root), "none.yml").count() == 0


def test_rule_files_are_reached_step_by_step(spark, tmp_path, as_rows):
    pytest.importorskip("yaml")
    root = tmp_path / "in" / "units"
    rule = "find_replace: [{find_value: %s}]"
    written(
        root,
        {
            "u/parameter.yml": "extend: [../../above.txt, t/a.rules, gone.yml, t/bad.yml]\n" + rule % "own",
            "u/t/a.rules": "extend: ../parameter.yml\n" + rule % "a",
            "u/t/bad.yml": "a: [",
            "../above.txt": "extend: ['../outside.json', 'units/_x/list.yml']\n" + rule % "above",
            "../../outside.json": '{"find_replace": [{"find_value": "outside"}, 5, {"find_value": true, "item_type": 3}], "extend": {"a": 1}}',
            "_x/list.yml": "- a",
            "v/parameter.yml": b"\xff\xfe",
            "w/unused.yml": rule % "unused",
            "deep [x], y/parameter.yml": rule % "odd",
        },
    )
    units = spark.createDataFrame([("u",), ("v",), ("w",), ("deep [x], y",)], "unit string")
    starts = units.select("unit", F.concat("unit", F.lit("/parameter.yml")).alias("source_file"))
    reached = reached_rule_files(spark, str(root), starts)
    assert as_rows(reached.files.select("source_file")) == [
        (f"{tmp_path}/in/above.txt",), (f"{tmp_path}/outside.json",), ("deep [x], y/parameter.yml",), ("u/parameter.yml",), ("u/t/a.rules",)
    ]
    assert as_rows(reached.unreadable) == [
        ("_x/list.yml", "holds no mapping"), ("u/gone.yml", "does not exist"),
        ("u/t/bad.yml", "does not parse: ParserError"), ("v/parameter.yml", "not valid UTF-8"),
    ]
    rules = read_unit_rules(spark, str(root), units).orderBy("unit", "visit_no", "rule_no").collect()
    assert [(r.unit, r.find_value, r.item_types) for r in rules] == [
        ("deep [x], y", "odd", []), ("u", "outside", []), ("u", "True", []), ("u", "above", []), ("u", "a", []), ("u", "own", [])
    ]
    none = reached_rule_files(spark, str(root), starts.filter("unit = 'w'"))
    assert none.files.count() == 0 and none.unreadable.count() == 0
