"""Frequent keys: found in one pass by a sketch, and spread over as many salts as their share asks for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
FAN_OUT = 4_096
TRACKED_KEYS = 65_536

_SALT = "_salt"
_FAN = "_fan"
_HASH = "_hash"


def row_salt(df: DataFrame, fan_out: Column) -> Column:
    """A number below ``fan_out`` for each row, the same whenever a task is repeated.

    It hashes the whole row and the number of its partition: rows of a frequent key differ in
    their other columns, and copies of one row differ in where they come from.
    """
    row = [F.col(f"`{c}`") for c in df.columns]
    return F.pmod(F.xxhash64(*row, F.spark_partition_id()), fan_out).cast("int")


def _hash(on: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in on])


def _incomplete(on: list[str]) -> Column:
    return reduce(or_, [F.col(f"`{c}`").isNull() for c in on])


@dataclass(frozen=True)
class Fans:
    """The salts of each frequent key, by the hash of the key, and of the rows whose key is incomplete."""

    on: tuple[str, ...]
    keys: dict[int, int]
    incomplete: int

    def _table(self, spark: SparkSession) -> DataFrame:
        schema = pa.schema([(_HASH, pa.int64()), (_FAN, pa.int32())])
        return F.broadcast(spark.createDataFrame(pa.table([list(self.keys), list(self.keys.values())], schema=schema)))

    def _joined(self, df: DataFrame) -> DataFrame:
        if not self.keys:
            return df.withColumn(_FAN, F.lit(1))
        fan = F.coalesce(F.col(_FAN), F.lit(1))
        return df.withColumn(_HASH, _hash(list(self.on))).join(self._table(df.sparkSession), _HASH, "left").drop(_HASH).withColumn(_FAN, fan)

    def spread(self, df: DataFrame, salt: str = _SALT) -> DataFrame:
        """The rows of the frequent side with a salt each."""
        # rows with an incomplete key match nothing, so any salt will do
        fan = F.when(_incomplete(list(self.on)), self.incomplete).otherwise(F.col(_FAN))
        return self._joined(df).withColumn(salt, row_salt(df, fan)).drop(_FAN)

    def repeat(self, df: DataFrame, salt: str = _SALT) -> DataFrame:
        """The rows of the other side once for each salt of their key."""
        salts = F.explode(F.sequence(F.lit(0), F.col(_FAN) - 1))
        return self._joined(df).withColumn(salt, salts).drop(_FAN)


def frequent(df: DataFrame, on: list[str], rows_per_salt: int = ROWS_PER_SALT, fan_out: int = FAN_OUT) -> Fans:
    """The keys of a table that hold more rows than one task should take, with a salt per ``rows_per_salt`` rows.

    One pass over the key columns, in which each task keeps a sketch of the 65,536 most frequent keys; the sketches are
    merged. Its error is below a 16,384th of all rows, so no key above a share of that size is missed, and in a
    table too large for ``rows_per_salt`` to be told apart that share is what a salt takes. At most 16,384 keys
    can lie above it, which bounds what reaches the driver and what is broadcast.
    """
    keyed = df.select(F.when(~_incomplete(on), _hash(on)).alias("h"))
    top = F.call_function("approx_top_k", F.col("h"), F.lit(TRACKED_KEYS // 2), F.lit(TRACKED_KEYS))
    seen = keyed.agg(F.count("*").alias("rows"), F.count("h").alias("complete"), top.alias("top")).select(
        "rows",
        "complete",
        F.greatest(F.lit(rows_per_salt), F.floor(F.col("rows") * 4 / TRACKED_KEYS)).alias("share"),
        "top",
    )
    counted = F.filter("top", lambda each: each["item"].isNotNull() & (each["count"] > F.col("share")))
    found = seen.select("rows", "complete", "share", counted.alias("top")).first()

    def salts(rows: int) -> int:
        return max(1, min(fan_out, -(-rows // found["share"])))

    return Fans(tuple(on), {each["item"]: salts(each["count"]) for each in found["top"] or []}, salts(found["rows"] - found["complete"]))
