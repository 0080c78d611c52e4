"""Line and context expressions. All are built-in functions, none needs a Python worker."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekit.constants import CONTEXT_LENGTH, RARE_LINE_BREAKS

ANY_LINE_BREAK = r"\R|[\x1c-\x1e]"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def split_lines(text: Column) -> Column:
    """The lines of a text as an array; a final line break does not open another line.

    Most texts hold only "\\n". A byte search for each other break is far cheaper than the
    general pattern, so only texts that hold one of those are split by pattern.
    """
    unusual = reduce(or_, [F.contains(text, F.lit(c)) for c in RARE_LINE_BREAKS])
    parts = F.when(unusual, F.split(text, ANY_LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    # One-element transform: binds the split result to a name, so it is computed once.
    return F.element_at(F.transform(F.array(parts), _drop_last_empty), 1)


def _drop_last_empty(parts: Column) -> Column:
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_space(line: Column) -> Column:
    """Remove all white space at both ends, not only blanks."""
    return F.regexp_replace(line, OUTER_SPACE, "")


def report_context(context: Column) -> Column:
    """The part of a matched line that is shown. Rules are matched on the full line before this."""
    return F.left(context, F.lit(CONTEXT_LENGTH))


def marker_lines(lines: Column, marker: str) -> Column:
    """Only the lines of an array that hold the marker."""
    return F.filter(lines, lambda line: F.contains(line, F.lit(marker)))


def id_count(text: Column, pattern: str) -> Column:
    """How often an identifier pattern occurs in a text."""
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")
