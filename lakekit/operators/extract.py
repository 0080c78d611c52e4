"""Identifier extraction from texts, line by line.

Extraction happens inside the row that holds the text, so it does not shuffle and no text is
gathered with another. Only lines that carry an identifier leave the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.constants import (
    BLOCK_END,
    BLOCK_ID_FIELD,
    BLOCK_KEY,
    GUID_PAIR_PATTERN,
    GUID_PATTERN,
    JSON_FIELDS,
    MARKER,
    NOTEBOOK_FIELDS,
)
from lakekit.functions.text import split_lines, strip_space
from lakekit.session import stored


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1; the text itself is not carried along."""
    rest = [c for c in df.columns if c != text]
    numbered = df.select(*rest, F.posexplode(split_lines(F.col(text))).alias("_at", "line"))
    return numbered.select(*rest, (F.col("_at") + 1).cast("bigint").alias("line_no"), "line")


def extract_ids(lines: DataFrame, pattern: str = GUID_PATTERN, line: str = "line") -> DataFrame:
    """One row per identifier on a line; matches need no word boundary and do not overlap."""
    return lines.withColumn("id", F.explode(F.regexp_extract_all(F.col(line), F.lit(pattern), 0)))


def block_lines(
    df: DataFrame,
    text: str = "text",
    marker: str = MARKER,
    opens: str = BLOCK_KEY,
    closes: str = BLOCK_END,
) -> DataFrame:
    """The marker lines of each text with ``inside``: whether the line lies in a tracked block.

    A line with ``opens`` enters the block, any other line with ``closes`` leaves it, and both take
    effect on the line itself. So each such line starts a section, and a section is inside exactly
    when its first line opens one. Cutting a text into sections is one pass over it. A carriage
    return marks the cut and a newline the end of a line: no line can hold either.
    """
    rest = [c for c in df.columns if c != text]

    def turns(line: Column) -> Column:
        return F.contains(line, F.lit(opens)) | F.contains(line, F.lit(closes))

    numbered = F.transform(
        split_lines(F.col(text)),
        lambda line, at: F.when(
            F.contains(line, F.lit(marker)),
            F.concat(F.when(turns(line), "\r").otherwise(""), (at + 1).cast("string"), F.lit("\t"), line),
        ),
    )
    sections = F.split(F.array_join(F.array_compact(numbered), "\n"), "\r", -1)
    by_section = df.filter(F.contains(F.col(text), F.lit(marker))).select(*rest, F.explode(sections).alias("_section"))
    first_line = _after_number(F.substring_index("_section", "\n", 1))
    with_state = by_section.select(
        *rest,
        F.contains(first_line, F.lit(opens)).alias("inside"),
        F.explode(F.split("_section", "\n")).alias("_entry"),
    ).filter(F.col("_entry") != "")
    return with_state.select(
        *rest,
        F.substring_index("_entry", "\t", 1).cast("bigint").alias("line_no"),
        _after_number(F.col("_entry")).alias("line"),
        "inside",
    )


def _after_number(entry: Column) -> Column:
    return F.substr(entry, F.locate("\t", entry) + 1)


def block_rows(
    df: DataFrame,
    group: list[str],
    position: str,
    opens: Column,
    closes: Column,
    partitions: int | None = None,
) -> DataFrame:
    """The same state for tables whose rows are the lines, adding ``inside``.

    Rows are ranged over partitions by group and position, so a group of any size, with any gaps, takes
    as many partitions as its rows ask for. Each partition is scanned in order by itself. What one carries
    into the next is the state of its last group, one row per partition: a running pass over these gives
    each partition the state that its first group starts with. Rows that share a position are taken in the
    order: neither, closing, opening.
    """
    order = [*group, position, "_turn"]
    flagged = df.withColumn("_turn", F.when(opens, True).when(closes, False))
    # The range bounds are found by a sample, so the rows are read twice before their one shuffle.
    ranged = flagged.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    place = F.struct(*[F.col(f"`{c}`") for c in group]) if group else F.struct(F.lit(0).alias("all"))
    named = ranged.withColumn("_group", F.to_json(place, {"ignoreNullFields": "false"}))
    more = [("_part", T.IntegerType()), ("_at", T.LongType()), ("_state", T.BooleanType())]
    schema = T.StructType([*named.schema.fields, *[T.StructField(name, kind) for name, kind in more]])
    scanned = stored(named.mapInArrow(_scan, schema), "block-rows")

    tails = scanned.groupBy("_part").agg(
        F.min_by("_group", "_at").alias("_first"),
        F.max_by("_group", "_at").alias("_group"),
        F.max_by("_state", "_at").alias("_end"),
    )
    ends = F.last("_end", ignorenulls=True).over(Window.partitionBy("_group").orderBy("_part"))
    entry = tails.withColumn("_end", ends).withColumn(
        "_before", F.lag(F.struct("_group", "_end")).over(Window.orderBy("_part"))
    )
    same = F.col("_before._group") == F.col("_first")
    entry = entry.select("_part", F.col("_first").alias("_group"), F.when(same, F.col("_before._end")).alias("_entry"))
    # One row per partition of the shuffle above, so it is small whatever the table's size.
    carried = F.broadcast(stored(entry.filter("_entry is not null"), "block-carry"))
    joined = scanned.join(carried, ["_part", "_group"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_state", "_entry", F.lit(False)).alias("inside"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their partition, their number in it and the state that their own group has reached in it."""
    part, at, group, state = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("_group")
        turns = np.asarray(batch.column("_turn").cast(pa.int8()).fill_null(-1))
        changed = np.concatenate(([names[0].as_py() != group], np.asarray(pc.not_equal(names[1:], names[:-1]))))
        rows = np.arange(len(turns))
        begun = np.maximum.accumulate(np.where(changed, rows, -1))
        turned = np.maximum.accumulate(np.where(turns >= 0, rows, -1))
        own = (turned >= begun) & (turned >= 0)
        reached = np.where(own, turns[np.maximum(turned, 0)], -1)
        if state is not None:
            # up to the first change the rows still belong to the group of the batch before
            reached = np.where((begun < 0) & (turned < 0), int(state), reached)
        columns = [pa.array([part] * len(rows), pa.int32()), pa.array(at + rows, pa.int64())]
        columns.append(pa.array(reached == 1, pa.bool_(), mask=reached < 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", "_at", "_state"])
        at, group = at + len(rows), names[-1].as_py()
        state = None if reached[-1] < 0 else bool(reached[-1])


def named_ids(
    line: Column,
    inside: Column,
    fields: list[str] = NOTEBOOK_FIELDS,
    block_key: str = BLOCK_KEY,
    id_field: str = BLOCK_ID_FIELD,
    id_pattern: str = GUID_PATTERN,
    pair_pattern: str = GUID_PAIR_PATTERN,
) -> Column:
    """The (field_name, id) pairs a line yields, as an array.

    The first name/value pair decides: a checked name counts, the id field counts inside a block,
    any other name drops the line. Without a pair, a line with the block key yields all its ids.
    """
    name = F.regexp_extract(line, pair_pattern, 1)
    value = F.regexp_extract(line, pair_pattern, 2)

    def pair(field: Column, found: Column) -> Column:
        return F.struct(field.alias("field_name"), found.alias("id"))

    return (
        F.when(name.isin(fields), F.array(pair(name, value)))
        .when((name == id_field) & inside, F.array(pair(F.lit(block_key), value)))
        .when(
            (name == "") & F.contains(line, F.lit(block_key)),
            F.transform(F.regexp_extract_all(line, F.lit(id_pattern), 0), lambda g: pair(F.lit(block_key), g)),
        )
    )


def notebook_ids(
    df: DataFrame,
    text: str = "text",
    marker: str = MARKER,
    fields: list[str] = NOTEBOOK_FIELDS,
    block_key: str = BLOCK_KEY,
    block_end: str = BLOCK_END,
    id_field: str = BLOCK_ID_FIELD,
    id_pattern: str = GUID_PATTERN,
    pair_pattern: str = GUID_PAIR_PATTERN,
) -> DataFrame:
    """Identifier occurrences on the marker lines of texts: line_no, field_name, id and the stripped line."""
    rest = [c for c in df.columns if c != text]
    lines = block_lines(df, text, marker, block_key, block_end).filter(F.rlike("line", F.lit(id_pattern)))
    pairs = named_ids(F.col("line"), F.col("inside"), fields, block_key, id_field, id_pattern, pair_pattern)
    found = lines.select(
        *rest, "line_no", strip_space(F.col("line")).alias("context"), F.explode(pairs).alias("_pair")
    )
    return found.select(*rest, "line_no", "_pair.field_name", "_pair.id", "context")


def field_ids(
    df: DataFrame,
    text: str = "text",
    fields: list[str] = JSON_FIELDS,
    id_pattern: str = GUID_PATTERN,
) -> DataFrame:
    """Identifier occurrences by quoted field: every field on a line with every identifier on it."""
    rest = [c for c in df.columns if c != text]

    def quoted(where: str, field: str) -> Column:
        return F.contains(F.col(where), F.lit(f'"{field}"'))

    candidates = df.filter(reduce(or_, [quoted(text, f) for f in fields]))
    lines = explode_lines(candidates, text).filter(reduce(or_, [quoted("line", f) for f in fields]))
    with_id = extract_ids(lines, id_pattern)
    present = F.array_compact(F.array(*[F.when(quoted("line", f), f) for f in fields]))
    return with_id.select(
        *rest,
        "line_no",
        F.explode(present).alias("field_name"),
        "id",
        strip_space(F.col("line")).alias("context"),
    )
