"""The index over pattern rules: what it promises of matches and paths, and whole results over many rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakekit.functions.paths import glob_to_regex
from lakekit.operators.coverage import compile_rules, uncovered
from lakekit.operators.rule_index import fixed_folder, grams, required_pieces, rule_index
from lakekit.sources import normalise_rules

PIECES = {
    "connection = abc": ["connection = abc"],
    r'token = "([0-9a-f]{40})"': ['token = "'],
    r"key\.name\[0\] = (\d+)": ["key.name[0] = "],
    "(?U)(?:left|right) margin": [" margin"],
    "lefts|rights": ["lefts", "rights"],
    "lefts|r.": None,
    "abcdx?efg": ["abcd"],
    "abcdx*": ["abcd"],
    "abcdex+yz": ["abcdex"],
    "abcde{2}fghij": ["abcde"],
    "(abcd)?efgh": ["efgh"],
    "(abcd)+efgh": ["abcd"],
    "(?<name>abcd(?:efgh(ijkl)))": ["abcdefghijkl"],
    "(?=abcd)efgh": ["efgh"],
    "(?!abcdefgh)ijkl": ["ijkl"],
    "(?<!abcdefgh)ijkl": ["ijkl"],
    r"a\\b\\c": ["a\\b\\c"],
    r"\Qabcdef\E": None,
    "(?i)abcdef": None,
    "abc(?i:defgh)": None,
    "[0-9]{16}": None,
    "[abcd]": None,
    "abc": None,
    r"abcd\x41efghi": ["efghi"],
    r"(ab)\1cdefg": ["cdefg"],
    r"abcd\bef": ["abcd"],
    "a{2,}bcde": ["bcde"],
    "[]x]abcde[^]y]": ["abcde"],
    "[a-c&&[^b]]defgh": ["defgh"],
    "": None,
}


def pieces_of(spark, patterns):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, p string")
    return {r.i: r.pieces for r in df.select("i", required_pieces(F.col("p")).alias("pieces")).collect()}


def test_required_pieces(spark):
    got = pieces_of(spark, list(PIECES))
    assert {p: got[i] for i, p in enumerate(PIECES)} == PIECES


atoms = st.sampled_from(["abcd", "wxyz", "a", "b", ".", "[ab]", r"\d", r"\.", "1", "=", r"\w"])
quantifiers = st.sampled_from(["", "", "", "?", "*", "+", "{2}", "{0,1}", "{1,2}", "+?", "*?"])
# Repeats of repeats would take a backtracking search forever.
group_quantifiers = st.sampled_from(["", "", "?", "{2}", "{0,1}", "??"])
patterns = st.recursive(
    st.builds(lambda a, q: a + q, atoms, quantifiers),
    lambda inner: st.one_of(
        st.builds(lambda parts: "".join(parts), st.lists(inner, min_size=1, max_size=4)),
        st.builds(lambda parts, q, o: f"({o}{'|'.join(parts)}){q}", st.lists(inner, min_size=1, max_size=3), group_quantifiers, st.sampled_from(["", "?:", "?="])),
    ),
    max_leaves=6,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(patterns, min_size=20, max_size=40), st.lists(st.text(alphabet="abcdwxyz1=. ", min_size=4, max_size=40), min_size=10, max_size=20))
def test_each_match_holds_a_piece(spark, many, texts):
    usable = []
    for pattern in many:
        try:
            usable.append((pattern, re.compile(pattern)))
        except re.error:
            continue
    got = pieces_of(spark, [pattern for pattern, _ in usable])
    for i, (pattern, compiled) in enumerate(usable):
        # texts made of the pattern's own letters match often enough
        for text in [*texts, pattern, "abcdwxyz" * 2, "abcdabcdwxyz1=."]:
            if got[i] is not None and compiled.search(text):
                assert any(piece in text for piece in got[i]), (pattern, text, got[i])


def test_fixed_folders(spark):
    globs = ["a/b/*.json", "./a/b/c?.json", "a\\b\\c", "*/b/c", "**/b/c", "a/**", "c.json", "a/b/", "src[1]/x.y/*", None]
    df = spark.createDataFrame([(g,) for g in globs], "g string")
    got = {r.g: r.f for r in df.select("g", fixed_folder(F.col("g")).alias("f")).collect()}
    assert got == dict(zip(globs, ["a/b/", "a/b/", "a/b/", None, None, None, None, "a/b/", "src[1]/x.y/", None]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet="ab/*.?[", min_size=1, max_size=10), min_size=30, max_size=60),
    st.lists(st.text(alphabet="ab/.[", min_size=1, max_size=14), min_size=30, max_size=60),
)
def test_selected_paths_end_in_the_fixed_folder(spark, globs, paths):
    pairs = spark.createDataFrame([(g,) for g in globs], "g string").crossJoin(spark.createDataFrame([(p,) for p in paths], "p string"))
    folder = F.regexp_extract("p", r"(?s)^(.*/)[^/]*$", 1)
    wrong = pairs.filter(fixed_folder(F.col("g")).isNotNull() & F.rlike("p", glob_to_regex(F.col("g"))) & ~F.endswith(folder, fixed_folder(F.col("g"))))
    assert wrong.count() == 0


def test_grams(spark):
    df = spark.createDataFrame([("abcdeabcd",), ("abc",), (None,), ("a\nbcd",), ("ÄÖÜ🙂x",)], "t string")
    got = [sorted(r[0]) if r[0] is not None else None for r in df.select(grams(F.col("t"))).collect()]
    assert got == [["abcd", "bcde", "cdea", "deab", "eabc"], [], None, ["\nbcd", "a\nbc"], ["ÄÖÜ🙂", "ÖÜ🙂x"]]


RULES = "source_file string, visit_no int, rule_no int, find_value string, is_regex string, item_type string, file_path string"


def rule_rows(count):
    """Rules of each kind: by pieces of the pattern, by folders, by wide globs and without any key."""
    for i in range(count):
        yield ("f", 1, 5 * i, f'name_{i} = "([0-9]+)"', "true", None, None)
        yield ("f", 1, 5 * i + 1, "[0-9]{4}", "true", None, f"unit{i}/x.Notebook/*.json")
        yield ("f", 1, 5 * i + 2, "[0-9]{5}", "true", "Report", f"**/deep{i}/**/a?.json")
        yield ("f", 1, 5 * i + 3, f"left{i}=([0-9]+)|right{i}=[0-9]+", "true", None, None)
        yield ("f", 1, 5 * i + 4, rf"^.{{0,2}}([0-9]+{i})$", "true", None, None)


@pytest.fixture(scope="module")
def many(spark):
    rules = normalise_rules(spark.createDataFrame(list(rule_rows(200)), RULES))
    n = F.col("id")
    line = (
        F.when(n % 7 == 0, F.concat(F.lit("name_"), n % 230, F.lit(' = "'), n, F.lit('"')))
        .when(n % 7 == 1, F.concat(F.lit("left"), n % 230, F.lit("="), n))
        .when(n % 7 == 2, F.concat(F.lit("x right"), n % 230, F.lit("="), n, F.lit(" end")))
        .otherwise(n.cast("string"))
    )
    path = (
        F.when(n % 5 == 0, F.concat(F.lit("unit"), n % 230, F.lit("/x.Notebook/a.json")))
        .when(n % 5 == 1, F.concat(F.lit("q/deep"), n % 230, F.lit("/b/c/a1.json")))
        .otherwise("other/a.json")
    )
    occurrences = spark.range(6_000).select(
        n.cast("string").alias("id"), line.alias("context"), path.alias("rel_path"), F.when(n % 2 == 0, "Report").otherwise("Notebook").alias("item_type")
    )
    return occurrences, rules


def expected(occurrences, rules):
    """Ids that no rule covers, every rule tried on every row."""
    tried = [
        (re.compile(r.find_value), r.item_types, [re.compile(p) for p in r.path_regexes], r.group_no)
        for r in compile_rules(rules).collect()
    ]
    left = []
    for row in occurrences.collect():
        for pattern, types, paths, group in tried:
            if (not types or row.item_type in types) and (not paths or any(p.search(row.rel_path) for p in paths)):
                found = pattern.search(row.context)
                if found and (found[1] == row.id if group else row.id in found[0]):
                    break
        else:
            left.append(row.id)
    return sorted(left)


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_thousand_patterns(many, monkeypatch, broadcast):
    occurrences, rules = many
    want = expected(occurrences, rules)
    assert 0 < len(want) < 6_000
    if not broadcast:
        monkeypatch.setattr("lakekit.operators.coverage.fits_broadcast", lambda df: False)
    left = uncovered(occurrences, rules)
    assert sorted(r.id for r in left.collect()) == want
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_are_keyed_by_what_fewest_share(many):
    _, rules = many
    compiled = compile_rules(rules, keep=["file_paths"]).withColumn("rule_no", F.monotonically_increasing_id())
    kept = compiled.cache()
    index = rule_index(kept).join(kept, "rule_no").collect()
    kinds = {}
    for row in index:
        kinds.setdefault(re.sub("[0-9]+", "#", row.find_value + str(row.file_paths)), set()).add(row.kind)
    assert kinds == {'name_# = "([#-#]+)"[]': {"line"}, "[#-#]{#}['unit#/x.Notebook/*.json']": {"folder"},
                     "[#-#]{#}['**/deep#/**/a?.json']": {"path"}, "left#=([#-#]+)|right#=[#-#]+[]": {"line"}}
    folders = [row.key for row in index if row.kind == "folder"]
    assert len(folders) == len(set(folders)) == 200


def test_groups_that_lazily_or_possessively_may_miss(spark):
    wanted = {
        "(abcd)??": None,
        "(abcd)*?": None,
        "(abcd)??efgh": ["efgh"],
        "(abcd)*?efgh": ["efgh"],
        "(abcd)?+efgh": ["efgh"],
        "(abcd)*+efgh": ["efgh"],
        "(abcd)+?efgh": ["abcd"],
        "((abcd)??wxyz)??efghi": ["efghi"],
        "abcd??efgh": ["efgh"],
        r"(abcd\?)?efgh\?": ["efgh?"],
        r"abcd\??efgh": ["abcd"],
    }
    got = pieces_of(spark, list(wanted))
    assert {pattern: got[i] for i, pattern in enumerate(wanted)} == wanted
