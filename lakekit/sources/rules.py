"""Find/replace rules as a table.

A rule row has find_value, is_regex, item_type, file_path and its origin. Values arrive as text:
a list may be one scalar or a JSON array, a flag may be spelt in several ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.text import strip_space
from lakekit.operators.matching import match
from lakekit.session import stored


def list_of(df: DataFrame, column: str) -> Column:
    """A scalar, a JSON array or an array column as ``array<string>``; null is the empty list."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        entries = F.transform(value, lambda v: F.coalesce(v.cast("string"), F.lit("None")))
    else:
        parsed = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
        entries = F.coalesce(
            F.transform(parsed, lambda v: F.coalesce(v, F.lit("None"))),
            F.when(value.isNotNull(), F.array(value)),
        )
    return F.coalesce(entries, F.array().cast("array<string>"))


def _texts(value: Column) -> Column:
    """A variant's entries as texts: of a list all, of a text itself; other kinds of value count as absent."""
    kind = F.schema_of_variant(value)
    entries = F.try_variant_get(value, "$", "array<variant>")
    shown = F.transform(entries, _shown)
    return F.when(kind == "STRING", F.array(_shown(value))).when(F.startswith(kind, F.lit("ARRAY")), shown)


def _shown(value: Column) -> Column:
    """A scalar variant as the text that rules compare: null as ``None``, truth values capitalised."""
    text = F.try_variant_get(value, "$", "string")
    truth = F.schema_of_variant(value) == "BOOLEAN"
    return F.when(value.isNull() | F.is_variant_null(value), "None").when(truth, F.initcap(text)).otherwise(text)


def rules_of_content(files: DataFrame) -> DataFrame:
    """Rule files with ``content`` (JSON) as columns: extend, find_replace (rule structs), reason.

    Here, and only here, the kinds of values a file may hold are told apart: a scalar or a list, a rule or
    something else, a value that is missing or null. A file that holds no mapping gets a reason.
    """
    parsed = files.withColumn("_c", F.try_parse_json("content"))
    mapping = F.coalesce(F.startswith(F.schema_of_variant("_c"), F.lit("OBJECT")), F.lit(False))

    def part(value: Column, name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant")

    def rule(entry: Column) -> Column:
        find, flag, values = part(entry, "find_value"), part(entry, "is_regex"), part(entry, "replace_value")
        replacements = F.try_variant_get(values, "$", "map<string, variant>")
        return F.struct(
            F.when(find.isNull(), "").otherwise(_shown(find)).alias("find_value"),
            F.when(flag.isNull(), "false").otherwise(_shown(flag)).alias("is_regex"),
            _texts(part(entry, "item_type")).alias("item_type"),
            _texts(part(entry, "file_path")).alias("file_path"),
            _texts(part(entry, "item_name")).alias("item_name"),
            F.coalesce(F.transform_values(replacements, lambda _, v: _shown(v)), F.create_map().cast("map<string,string>")).alias("replace_value"),
        )

    entries = F.try_variant_get(part(F.col("_c"), "find_replace"), "$", "array<variant>")
    rules = F.filter(entries, lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT")))
    none = F.array().cast("array<string>")
    return parsed.select(
        "source_file",
        F.coalesce(_texts(part(F.col("_c"), "extend")), none).alias("extend"),
        F.transform(F.coalesce(rules, F.array().cast("array<variant>")), rule).alias("find_replace"),
        F.coalesce("reason", F.when(~mapping, "holds no mapping")).alias("reason"),
    )


def first_visits(rows: DataFrame) -> DataFrame:
    """The rows of each source file's first visit: a file reached again, by the same unit, adds nothing."""
    file_key = [c for c in ["unit", "source_file"] if c in rows.columns]
    first = match(rows, rows, file_key, "left", keep={"_first": F.min("visit_no")})
    return first.filter(F.col("_first").isNull() | F.col("visit_no").eqNullSafe(F.col("_first"))).drop("_first")


def normalise_rules(rows: DataFrame) -> DataFrame:
    """Clean rule rows: first visit of a file only, stripped values, empty ones dropped, lists and flags typed.

    A missing find_value becomes the text "None", as it does for whoever reads rules as text. Other
    columns, such as a replacement, are passed through. The rows are stored first: rules are few,
    are used several times, and may come from a costly query.
    """
    rows = stored(rows, "rules")
    if "item_name" not in rows.columns:
        rows = rows.withColumn("item_name", F.lit(None).cast("string"))
    cleaned = ["find_value", "is_regex", "item_type", "file_path", "item_name"]
    rest = [c for c in rows.columns if c not in cleaned]
    return (
        first_visits(rows)
        .select(
            *rest,
            strip_space(F.coalesce("find_value", F.lit("None"))).alias("find_value"),
            F.coalesce(F.lower(F.col("is_regex").cast("string")) == "true", F.lit(False)).alias("is_regex"),
            list_of(rows, "item_type").alias("item_types"),
            list_of(rows, "file_path").alias("file_paths"),
            list_of(rows, "item_name").alias("item_names"),
        )
        .filter(F.col("find_value") != "")
    )


def flatten_rule_files(files: DataFrame, starts: DataFrame) -> DataFrame:
    """Rule rows of each unit's rule file and of all files it extends, parents first.

    ``files`` has source_file, extend (the source_file of each parent) and find_replace (an array
    of rule structs); ``starts`` has unit and the source_file the unit begins with. A file is
    placed where the walk first enters it, so its place is the smallest sequence of branch numbers
    that leads to it. Places only ever get smaller, so the search ends for cycles too.
    ``visit_no`` orders the files of a unit, ``rule_no`` the rules in one.
    """
    key = ["unit", "source_file"]
    files = stored(files, "rule-files")
    known = files.select("source_file")
    edges = files.select("source_file", F.posexplode(list_of(files, "extend")).alias("branch", "parent_file"))
    places = starts.join(known, "source_file", "left_semi").select(*key, F.array().cast("array<int>").alias("place"))
    changed = places
    while not changed.isEmpty():
        reached = changed.join(edges, "source_file").select(
            "unit", F.col("parent_file").alias("source_file"), F.concat("place", F.array("branch")).alias("place")
        )
        candidates = places.unionByName(reached.join(known, "source_file", "left_semi"))
        better = stored(candidates.groupBy(*key).agg(F.min("place").alias("place")), "places")
        old = places.withColumnRenamed("place", "_old")
        changed = better.join(old, key, "left").filter(~F.col("place").eqNullSafe(F.col("_old"))).select(*key, "place")
        places = better
    # A file's rules come after those of every file below it: its place is closed by a larger branch.
    order = F.concat("place", F.array(F.lit(2**31 - 1)))
    rules = files.join(places, "source_file").select(*key, order.alias("visit_no"), F.posexplode("find_replace"))
    return rules.select("unit", "visit_no", F.col("pos").alias("rule_no"), "source_file", "col.*")
