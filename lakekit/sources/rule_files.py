"""Rule files of a corpus, YAML or JSON, as rows."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.constants import ROOT_RULE_FILE
from lakekit.functions.paths import relative_to
from lakekit.session import stored
from lakekit.sources.corpus import as_glob, files_at, read_tree, split_root
from lakekit.sources.rules import flatten_rule_files, normalise_rules, rules_of_content

RULE_FILE_GLOB = "{*.yml,*.yaml}"
PATHS_PER_READ = 200

_PARSED = "source_file string, content string, reason string"
_FILE = ["source_file", "extend", "find_replace", "reason"]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's content as JSON, or the reason why there is none."""
    import yaml

    def content(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, "not valid UTF-8"
        try:
            return json.dumps(yaml.safe_load(text), default=str), None
        except Exception as problem:  # dates out of range, keys that are no text and the like are no YAMLError
            return None, f"does not parse: {type(problem).__name__}"

    for batch in batches:
        rows = [(path, *content(text)) for path, text in zip(batch["path"], batch["text"])]
        yield pd.DataFrame(rows, columns=["source_file", "content", "reason"])


def _resolved(source_file: Column, entry: Column, base: str) -> Column:
    """A path as written in a file: below the base relative to it, elsewhere whole, so each file has one name."""
    folder = F.regexp_replace(source_file, "[^/]*$", "")
    inside = F.when(F.startswith(source_file, F.lit("/")), folder).otherwise(F.concat(F.lit(f"{base}/"), folder))
    whole = F.when(F.startswith(entry, F.lit("/")), entry).otherwise(F.concat(inside, entry))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return relative_to(F.concat(F.lit("/"), F.array_join(parts, "/")), base)


def _parsed(texts: DataFrame, base: str) -> DataFrame:
    """``path, text`` of rule files as source_file, extend (paths resolved), find_replace and reason."""
    rows = rules_of_content(texts.mapInPandas(_parse, _PARSED))
    extend = F.transform("extend", lambda entry: _resolved(F.col("source_file"), entry, base))
    return rows.withColumn("extend", extend).select(*_FILE)


def read_rule_files(spark: SparkSession, root: str, names: str = RULE_FILE_GLOB) -> DataFrame:
    """All rule files below a root: source_file (relative to it), extend, find_replace.

    Files are parsed where Spark reads them. YAML needs PyYAML on the executors. Files that do not
    parse, or hold no mapping, give no row; ``reached_rule_files`` lists them.
    """
    base = split_root(root)[1].rstrip("/")
    return _parsed(read_tree(spark, root, names), base).filter("reason is null").drop("reason")


class ReachedFiles(NamedTuple):
    """The rule files that a walk reached and could read, and those it could not, with a ``reason``."""

    files: DataFrame
    unreadable: DataFrame


def reached_rule_files(spark: SparkSession, root: str, starts: DataFrame) -> ReachedFiles:
    """The files of ``starts`` (unit, source_file) and all that they extend, whatever their names and places.

    Each step reads only the files that the step before it named, also above the root and with other
    suffixes, so the rest of the tree is neither listed nor parsed. What reaches the driver are the names of
    rule files, which it passes on to Spark's reader. Names no file answers to are listed as unreadable
    if a file extends them; a unit without a rule file of its own has no rules.
    """
    prefix, base = split_root(root.rstrip("/"))
    named = {row[0] for row in starts.select("source_file").distinct().collect()}
    first, seen, steps, missing = named, set(), [], []
    while named:
        ordered = sorted(named)
        found: set[str] = set()
        follow: set[str] = set()
        for part in _parts(ordered):
            places = {posixpath.normpath(posixpath.join(base, name)): name for name in part}
            texts = _read_named(spark, prefix, places)
            if texts is None:
                continue
            read = stored(_parsed(texts, base), "rule-files")
            steps.append(read)
            found.update(row[0] for row in read.select("source_file").collect())
            follow.update(row[0] for row in read.select(F.explode("extend")).distinct().collect())
        missing += [(name, "does not exist") for name in sorted(named - found - first)]
        seen |= named
        named = follow - seen
    empty = spark.createDataFrame([], _PARSED).transform(rules_of_content).select(*_FILE)
    every = empty
    for step in steps:
        every = every.unionByName(step)
    every = stored(every, "reached-rule-files") if steps else empty
    gone = spark.createDataFrame(missing, "source_file string, reason string")
    unreadable = every.filter("reason is not null").select("source_file", "reason").unionByName(gone)
    return ReachedFiles(every.filter("reason is null").drop("reason"), unreadable)


def _parts(names: list[str]) -> Iterator[list[str]]:
    """Names to be read together; one with a character that globs use is read by itself."""
    plain = [name for name in names if as_glob(name) == name]
    yield from (plain[at : at + PATHS_PER_READ] for at in range(0, len(plain), PATHS_PER_READ))
    yield from ([name] for name in names if as_glob(name) != name)


def _read_named(spark: SparkSession, prefix: str, places: dict[str, str]) -> DataFrame | None:
    """``path`` (as named) and ``text`` of the files at these places, null if none of them exists."""
    alternatives = [as_glob(place) for place in places]
    glob = alternatives[0] if len(alternatives) == 1 else "/{" + ",".join(each.lstrip("/") for each in alternatives) + "}"
    try:
        files = files_at(spark, prefix + glob)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    names = spark.createDataFrame(list(places.items()), "path string, _name string")
    text = F.try_validate_utf8(F.col("content").cast("string")).alias("text")
    return files.join(F.broadcast(names), "path").select(F.col("_name").alias("path"), text)


def unit_starts(units: DataFrame, name: str = ROOT_RULE_FILE) -> DataFrame:
    """Where the rules of each unit begin."""
    return units.select("unit", F.concat("unit", F.lit(f"/{name}")).alias("source_file"))


def read_unit_rules(spark: SparkSession, root: str, units: DataFrame, name: str = ROOT_RULE_FILE) -> DataFrame:
    """The rules of each unit: its own rule file and all that this one extends."""
    starts = unit_starts(units, name)
    return normalise_rules(flatten_rule_files(reached_rule_files(spark, root, starts).files, starts))
