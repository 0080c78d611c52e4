"""Type conversion for a copy between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_copy(df: DataFrame, target: T.StructType, allow_truncation: bool = True) -> DataFrame:
    """Project a table onto a target schema.

    With truncation, text is cut to a CHAR/VARCHAR length, decimals are rounded to their scale,
    fractions are cut off, and a value out of range becomes null. Without it, each of these stops
    the job. Booleans are never numbers: boolean to number and number to boolean give null.
    """
    source = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[_convert(F.col(f.name), source[f.name], f.dataType, allow_truncation).alias(f.name) for f in target.fields]
    )


def _convert(value: Column, source: T.DataType, target: T.DataType, allow_truncation: bool) -> Column:
    boolean_as_number = isinstance(source, T.BooleanType) and isinstance(target, T.NumericType)
    number_as_boolean = isinstance(source, T.NumericType) and isinstance(target, T.BooleanType)
    if boolean_as_number or number_as_boolean:
        converted = F.lit(None).cast(target)
        lossless = value.isNull()
    elif isinstance(target, (T.VarcharType, T.CharType)):
        whole = value.cast("string")
        converted = F.left(whole, F.lit(target.length))
        lossless = F.coalesce(F.length(whole) <= target.length, F.lit(True))
    else:
        converted = value.try_cast(target)
        if isinstance(source, T.NumericType) and isinstance(target, T.NumericType):
            lossless = converted.try_cast(source).eqNullSafe(value)
        else:
            lossless = converted.isNotNull() | value.isNull()
    if allow_truncation:
        return converted
    return F.when(lossless, converted).otherwise(
        F.raise_error(F.concat(F.lit("value does not fit the target type: "), value.cast("string"))).cast(target)
    )
