"""Outcome counts, result documents, findings per unit, gates.

Outcomes have folder, name, success and error, next to whatever describes their run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekit.constants import EXIT_FAILED, EXIT_OK
from lakekit.functions.values import display_name, status_of
from lakekit.operators.matching import match
from lakekit.session import stored

# monotonically_increasing_id puts the number of the partition above the lower 33 bits.
_ROW_BITS = 33
# Names and types of a result document.
ENTRY_SCHEMA = "array<struct<name string, full_name string, status string, error string>>"
COUNTS = {"total_workspaces": "bigint", "successful_count": "bigint", "failed_count": "bigint"}


def roll_up(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, successful and failed outcomes; an outcome without a result failed."""
    ok = F.coalesce("success", F.lit(False))
    return outcomes.groupBy(*(by or [])).agg(
        F.count("*").alias("total_workspaces"),
        F.count_if(ok).alias("successful_count"),
        F.count_if(~ok).alias("failed_count"),
    )


def roll_up_requested(
    requested: DataFrame, outcomes: DataFrame, on: list[str], by: list[str] | None = None
) -> DataFrame:
    """The same counts over what was requested: whatever left no outcome failed."""
    wanted = requested.drop("success")
    return roll_up(match(wanted, outcomes, on, "left", keep={"success": F.bool_and("success")}), by)


def gate(failures: DataFrame) -> DataFrame:
    """One row: whether there is any failure, and the exit code. One row per task is enough to tell."""
    failed = F.count("*") > 0
    return failures.limit(1).agg(
        failed.alias("failed"), F.when(failed, EXIT_FAILED).otherwise(EXIT_OK).alias("exit_code")
    )


def findings_per_unit(units: DataFrame, findings: DataFrame, on: str = "unit") -> DataFrame:
    """Findings per unit, clean units with zero. Findings are counted before they meet the units."""
    counts = findings.groupBy(on).agg(F.count("*").alias("_n"))
    found = F.coalesce("_n", F.lit(0)).cast("bigint")
    return units.select(on).distinct().join(counts, on, "left").select(on, found.alias("findings"), (found == 0).alias("clean"))


def overall(per_unit: DataFrame) -> DataFrame:
    """The totals of a findings-per-unit table."""
    return per_unit.agg(
        F.count("*").alias("units"),
        F.count_if("clean").alias("clean_units"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
    )


def count_by(inventory: DataFrame, column: str) -> DataFrame:
    return inventory.groupBy(column).agg(F.count("*").alias("items"))


def result_document(outcomes: DataFrame, header: list[str]) -> DataFrame:
    """The result document of each run, as text fragments: the header columns, position, fragment.

    The fragments of a run, put together by position, are one JSON document: at 0 header and
    counts, then one fragment per outcome, sorted by name, and at the end the closing brackets.
    This form is the same at every size, and no task needs to hold a run. The partition an outcome
    comes from breaks ties, so that many equal entries need not share a task either.
    """
    entry = F.struct(
        F.col("folder").alias("name"),
        display_name(F.col("name"), F.col("folder")).alias("full_name"),
        status_of(F.coalesce("success", F.lit(False))).alias("status"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    placed = _numbered(outcomes.select(*header, entry.alias("entry")), header)
    comma = F.when(F.col("position") > 1, ",").otherwise("")
    entries = placed.select(*header, "position", F.concat(comma, F.to_json("entry")).alias("fragment"))
    counts = roll_up(outcomes, header)
    opening = F.regexp_replace(F.to_json(F.struct(*header, *COUNTS)), r"\}$", ',"workspaces":[')
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("position"), opening.alias("fragment")),
        F.struct((F.col("total_workspaces") + 1).alias("position"), F.lit("]}").alias("fragment")),
    )
    return entries.unionByName(counts.select(*header, F.inline(ends)))


def _numbered(entries: DataFrame, header: list[str]) -> DataFrame:
    """The entries of each run numbered from 1 in their order: rows counted per partition, then offsets."""
    key = F.to_json(F.struct(*header))
    rows = entries.select("*", key.alias("_run"), F.spark_partition_id().alias("_from"))
    order = ["_run", "entry", "_from"]
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    ordered = stored(ordered, "outcomes").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    parts = ordered.groupBy("_run", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = parts.select("_run", "_part", (F.col("_first") - before).alias("_start"))
    placed = match(ordered, starts, ["_run", "_part"], "left", keep={"_start": F.max("_start")})
    return placed.select(*header, "entry", (F.col("_at") - F.col("_start") + 1).alias("position"))


def flatten_fragments(fragments: DataFrame, header: list[str]) -> DataFrame:
    """One row per outcome of documents in fragments, with the header and counts of its run."""
    kept = fragments.withColumn("_run", F.to_json(F.struct(*header)))
    schema = ", ".join(f"{name} {kind}" for name, kind in COUNTS.items())
    opening = F.from_json(F.concat("fragment", F.lit("]}")), schema)
    heads = kept.filter("position = 0").select("_run", opening.alias("_c"))
    counts = {name: F.max(f"_c.{name}") for name in COUNTS}
    entry_schema = ENTRY_SCHEMA.removeprefix("array<").removesuffix(">")
    entry = F.from_json(F.regexp_replace("fragment", "^,", ""), entry_schema)
    entries = kept.filter("position > 0 and fragment <> ']}'").select(*header, "_run", entry.alias("_e"))
    return match(entries, heads, ["_run"], "left", keep=counts).select(*header, *COUNTS, "_e.*")


def flatten_document(documents: DataFrame, header_types: dict[str, str], document: str = "document") -> DataFrame:
    """One row per outcome of each document, with the document's header and counts."""
    fields = ", ".join(f"{name} {kind}" for name, kind in {**header_types, **COUNTS}.items())
    parsed = documents.select(F.from_json(document, f"{fields}, workspaces {ENTRY_SCHEMA}").alias("_d"))
    scalars = [F.col(f"_d.{name}") for name in [*header_types, *COUNTS]]
    return parsed.select(*scalars, F.inline("_d.workspaces"))
