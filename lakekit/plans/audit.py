"""The corpus audit: which identifiers would be carried along unchanged because no rule covers them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.constants import NOTEBOOK_FILE
from lakekit.functions.text import report_context
from lakekit.operators.checks import only_unit
from lakekit.operators.coverage import uncovered
from lakekit.operators.extract import field_ids, notebook_ids
from lakekit.operators.matching import match
from lakekit.operators.reconcile import discover_units
from lakekit.operators.rollup import findings_per_unit, gate
from lakekit.session import stored
from lakekit.sources.corpus import config_files, read_corpus
from lakekit.sources.rule_files import read_unit_rules

FINDING_COLUMNS = ["unit", "file", "item_type", "field_name", "id", "context"]


class Audit(NamedTuple):
    """Findings sorted for a report, their number per unit (clean units too), and the gate."""

    findings: DataFrame
    per_unit: DataFrame
    gate: DataFrame


def findings_of(occurrences: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Uncovered occurrences in report form: only now is the context cut."""
    open_ids = uncovered(occurrences, rules, by)
    return open_ids.withColumn("context", report_context(F.col("context"))).select(*FINDING_COLUMNS)


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("unit", "file", "field_name", "id", "context")


def report(findings: DataFrame, units: DataFrame) -> Audit:
    """The three views of an audit. Findings are stored once in the shared folder and read three times."""
    found = stored(findings, "findings")
    return Audit(sorted_findings(found), findings_per_unit(units, found).orderBy("unit"), gate(found))


def corpus_occurrences(spark: SparkSession, root: str, units: DataFrame, unit: str | None = None) -> DataFrame:
    """Occurrences in the notebooks and JSON files of the given units.

    Notebooks and JSON files are listed apart, so each file is read once. What meets the units are
    the short rows found in the texts, never the texts.
    """
    found = notebook_ids(read_corpus(spark, root, NOTEBOOK_FILE, unit)).unionByName(
        field_ids(read_corpus(spark, root, "*.json", unit))
    )
    return match(stored(found, "occurrences"), units, ["unit"], "left_semi")


def audit_corpus(
    spark: SparkSession, root: str, rules: DataFrame | None = None, unit: str | None = None
) -> Audit:
    """Audit the units below a root that own a configuration, or one of them.

    Rules come from the units' own rule files unless given. Given ones have a ``unit`` column: a
    rule covers only what lies in its own unit.
    """
    owners = config_files(spark, root)
    units = stored(discover_units(owners, owners, required=False), "units")
    if unit is not None:
        units = only_unit(units, unit)
    if rules is None:
        rules = read_unit_rules(spark, root, units)
    occurrences = corpus_occurrences(spark, root, units, unit)
    return report(findings_of(occurrences, rules, by=["unit"]), units)
