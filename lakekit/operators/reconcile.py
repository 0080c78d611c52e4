"""Desired against actual inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.operators.matching import match

KEEP = "keep"
CREATE = "create"
ORPHAN = "orphan"


def _complete(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key has no missing part; an empty text is missing too."""
    for key in on:
        known = F.col(key).isNotNull()
        if isinstance(df.schema[key].dataType, T.StringType):
            known = known & (F.col(key) != "")
        df = df.filter(known)
    return df


def _one_per_key(df: DataFrame, on: list[str]) -> DataFrame:
    """One row per key, the smallest, so that repeated runs agree."""
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.select(*on).distinct()
    return df.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_row")).select(*on, "_row.*")


def find_by_name(wanted: DataFrame, inventory: DataFrame, name: str = "name", id_column: str = "id") -> DataFrame:
    """Each wanted row with the id of the inventory row of exactly that name, or null."""
    return match(wanted, inventory, [name], "left", keep={id_column: F.min(id_column)})


def existing(wanted: DataFrame, inventory: DataFrame, on: list[str]) -> DataFrame:
    """The wanted rows whose whole key is in the inventory, such as a grant already given."""
    return match(wanted, inventory, on, "left_semi")


def missing(desired: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """What has to be created: complete desired keys that are absent, each once."""
    wanted = _one_per_key(_complete(desired, on), on)
    return wanted.join(actual.select(*on).dropna(subset=on).distinct(), on, "left_anti")


def orphans(actual: DataFrame, desired: DataFrame, on: list[str], skip: bool = False) -> DataFrame:
    """The actual rows nobody declares; none when the environment skips their removal."""
    return match(actual.filter(F.lit(not skip)), desired, on, "left_anti")


def reconcile(desired: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Every key with its action: keep, create or orphan.

    Both sides are tagged and aggregated together: one shuffle of keys already combined per
    task, where a full outer join would sort and shuffle every row of both sides.
    """
    wanted = _complete(desired, on).select(*on, F.lit(True).alias("_wanted"), F.lit(False).alias("_present"))
    present = actual.select(*on, F.lit(False).alias("_wanted"), F.lit(True).alias("_present"))
    sides = wanted.unionByName(present).groupBy(*on).agg(
        F.bool_or("_wanted").alias("_wanted"), F.bool_or("_present").alias("_present")
    )
    return sides.select(*on, _action(F.col("_wanted"), F.col("_present")).alias("action"))


def _action(wanted: Column, present: Column) -> Column:
    return F.when(wanted & present, KEEP).when(wanted, CREATE).otherwise(ORPHAN)


def discover_units(units: DataFrame, owners: DataFrame, on: str = "unit", required: bool = True) -> DataFrame:
    """The units that own a configuration, each once and sorted.

    ``required`` stops when there is none, as a deployment must; an audit then has nothing to do.
    """
    found = (
        units.select(on).distinct().join(owners.select(on).distinct(), on, "left_semi").orderBy(on)
    )
    if required and found.isEmpty():
        raise ValueError("no unit owns a configuration")
    return found
