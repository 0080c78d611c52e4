"""Checks on parameters and rows that stop a job or name what is wrong."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lakekit.constants import ENVIRONMENTS, EXIT_FAILED, EXIT_OK
from lakekit.operators.matching import match
from lakekit.session import run_dir


def only_unit(df: DataFrame, unit: str, column: str = "unit") -> DataFrame:
    """The rows of one named unit; an unknown name is an error."""
    chosen = df.filter(F.col(column) == unit)
    if chosen.isEmpty():
        raise ValueError(f"no unit named '{unit}'")
    return chosen


def outside_domain(df: DataFrame, column: str, domain: list[str] = ENVIRONMENTS) -> DataFrame:
    """The rows whose value, in lower case, is not one of the domain. A missing value is not."""
    return df.filter(~F.coalesce(F.lower(column).isin(domain), F.lit(False)))


def _stop_unless(df: DataFrame, valid: Column, message: Column) -> DataFrame:
    """All rows, or an error. A filter is never pruned, so counting or selecting other columns checks as well."""
    return df.filter(F.when(valid, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def require_domain(df: DataFrame, column: str, domain: list[str] = ENVIRONMENTS) -> DataFrame:
    """All rows; the job stops at the first value outside the domain and lists the domain sorted."""
    message = F.concat(
        F.lit("invalid value '"), F.coalesce(column, F.lit("")), F.lit("', must be one of: " + ", ".join(sorted(domain)))
    )
    valid = F.coalesce(F.lower(column).isin(domain), F.lit(False))
    return _stop_unless(df, valid, message)


def look_up(rows: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with the mapped value of its key, or null. A mapping has one value per key."""
    return match(rows, mapping, [key], "left", keep={value: F.min(value)})


def without_mapping(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """The rows whose key has no mapping."""
    return match(rows, mapping, [key], "left_anti")


def require_mapping(rows: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """As ``look_up``, but the job stops at a key without a mapping."""
    message = F.concat(F.lit("no mapping for '"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("'"))
    return _stop_unless(look_up(rows, mapping, key, value), F.col(value).isNotNull(), message)


def in_domain(column: str, domain: list[str] = ENVIRONMENTS) -> Column:
    """Whether the value, in lower case, is one of the domain. A missing value is not."""
    return F.coalesce(F.lower(column).isin(domain), F.lit(False))


class Checked(NamedTuple):
    """Rows that pass every check; the others with ``failed``, the names of those they fail; violations per check; the gate."""

    valid: DataFrame
    rejected: DataFrame
    violations: DataFrame
    gate: DataFrame


def quarantine(df: DataFrame, checks: dict[str, Column], path: str | None = None) -> Checked:
    """Write rows once, apart by whether they pass all checks, and count what each check rejects on the way.

    The counts are observed while the rows are written, so rows, violations and gate come from one pass over the source.
    The rows go to ``path`` or the shared folder, in folders of their own. An unknown outcome of a check is a failure.
    """
    names = list(checks)
    failing = {name: ~F.coalesce(check, F.lit(False)) for name, check in checks.items()}
    failed = F.array_compact(F.array(*[F.when(failing[name], name) for name in names])).alias("failed")
    marked = df.select("*", failed).withColumn("_passes", F.size("failed") == 0)
    seen = Observation("quarantine")
    counts = [F.count_if(F.array_contains("failed", name)).alias(f"_{place}") for place, name in enumerate(names)]
    observed = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_passes")).alias("rejected"), *counts)
    target = path or run_dir(df.sparkSession, "quarantine")
    observed.write.partitionBy("_passes").parquet(target)
    written = df.sparkSession.read.schema(marked.schema).parquet(target)
    found = seen.get
    violations = [(name, found[f"_{place}"], found["rows"]) for place, name in enumerate(names)]
    is_failed = found["rejected"] > 0
    return Checked(
        written.filter("_passes").select(*df.columns),
        written.filter("not _passes").select(*df.columns, "failed"),
        df.sparkSession.createDataFrame(violations, "check string, violations long, rows long"),
        df.sparkSession.createDataFrame([(is_failed, EXIT_FAILED if is_failed else EXIT_OK)], "failed boolean, exit_code int"),
    )
