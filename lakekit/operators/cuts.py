"""Order without gathering: a sorted table cut into runs of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# monotonically_increasing_id puts the row number within a partition into the lower 33 bits.
_ROW_BITS = 33


def cut(df: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """Rows sorted across the cluster, with the ascending number of their run of at most ``size`` rows.

    A run never crosses a partition, so no task needs to know the others; a small table is one run.
    """
    at = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    row = F.col("_at").bitwiseAND(2**_ROW_BITS - 1)
    return ordered.withColumn(name, F.col("_at") - F.pmod(row, F.lit(size))).drop("_at")
