"""Scalar mappings used by run reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekit.constants import STATUS_FAILED, STATUS_OK


def status_of(ok: Column) -> Column:
    return F.when(ok, STATUS_OK).otherwise(STATUS_FAILED)


def display_name(name: Column, folder: Column) -> Column:
    """The name, or the folder when the name is empty or missing."""
    return F.coalesce(F.nullif(name, F.lit("")), folder)
