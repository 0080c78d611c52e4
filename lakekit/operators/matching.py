"""Equi-matching against a keyed side, for tables where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.operators.skew import FAN_OUT, ROWS_PER_SALT, frequent, row_salt
from lakekit.session import stored

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 32 * 1024 * 1024

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "fits_broadcast", "match", "row_salt"]


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is proven small: at most ``rows`` rows and ``size`` bytes of values.

    Only row sizes reach the driver, never more than ``rows + 1`` of them, and Spark stops
    scanning as soon as it has that many.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    sizes = df.select(width.alias("n")).take(rows + 1)
    return len(sizes) <= rows and sum(r.n or 0 for r in sizes) <= size


def match(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    keep: dict[str, Column] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_key_rows: int = ROWS_PER_SALT,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Semi, anti or left join to the distinct keys of ``right``; no left row is ever doubled.

    ``keep`` names aggregates of the right rows of a key that a left join brings along. Incomplete
    keys on the right match nothing. The right side is reduced to one row per key first, which
    Spark combines before its shuffle.

    A proven small right side is broadcast: one that is small as it stands, or once it is reduced
    and stored. Beyond that both sides shuffle on the key. A sketch of the left keys, one pass over
    their columns alone, tells which hold more than ``hot_key_rows`` rows; these are spread over a
    salt for each so many rows, up to ``fan_out``, and the one right row of such a key is repeated
    for each. The joined plan holds the left side once.
    """
    taken = set(keep or {}) & set(left.columns)
    if taken:
        raise ValueError(f"columns exist on both sides: {sorted(taken)}")
    complete = right.dropna(subset=on)
    if keep:
        unique = complete.groupBy(*on).agg(*[value.alias(name) for name, value in keep.items()])
    else:
        unique = complete.select(*on).distinct()
    if fits_broadcast(complete if keep else complete.select(*on), broadcast_rows):
        return left.join(F.broadcast(unique), on, how)
    unique = stored(unique, "keys")
    if fits_broadcast(unique, broadcast_rows):
        return left.join(F.broadcast(unique), on, how)
    fans = frequent(left, on, hot_key_rows, fan_out)
    return fans.spread(left).join(fans.repeat(unique), [*on, "_salt"], how).drop("_salt")
