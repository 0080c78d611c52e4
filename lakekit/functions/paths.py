"""Path expressions: skip list, item type, relative path, glob match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekit.constants import SKIP_NAMES, SKIP_SUFFIX, UNKNOWN_TYPE


def not_skipped(name: Column) -> Column:
    return ~name.isin(SKIP_NAMES) & ~F.endswith(name, F.lit(SKIP_SUFFIX))


# The first path part whose last suffix is a capitalised word of three or more letters: name, suffix.
ITEM_PART = r"(?:^|/)([^/]*)\.(\p{Lu}\p{L}{2,})(?=/|$)"


def item_type(path: Column) -> Column:
    """The type of the item a path belongs to: the suffix of the folder that says what it is."""
    found = F.regexp_extract(path, ITEM_PART, 2)
    return F.when(found == "", F.lit(UNKNOWN_TYPE)).otherwise(found)


def item_name(path: Column) -> Column:
    """The name in front of that suffix."""
    return F.regexp_extract(path, ITEM_PART, 1)


def relative_to(path: Column, root: str) -> Column:
    """The path below a root, with forward slashes; a path elsewhere stays whole."""
    slashed = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, len(base) + 1, 2**31 - 1)).otherwise(slashed)


def glob_to_regex(glob: Column) -> Column:
    """A glob as a pattern that is open at the start and closed at the end.

    ``**`` with an optional slash crosses folders, ``*`` and ``?`` stay inside one.
    """
    plain = F.regexp_replace(F.translate(glob, "\\", "/"), "^[./]+", "")
    escaped = F.regexp_replace(plain, r"([.^$+{}\[\]|()])", r"\\$1")
    # The wide wildcard waits as a NUL, which no path can hold, until "*" has been dealt with.
    wide = F.regexp_replace(escaped, r"\*\*/?", "\x00")
    narrow = F.replace(F.replace(wide, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.replace(narrow, F.lit("\x00"), F.lit(".*")), F.lit("$"))


def matches_any_glob(path: Column, globs: Column) -> Column:
    """True when the list is empty or one of its globs matches."""
    return (F.size(globs) == 0) | F.exists(globs, lambda g: F.rlike(path, glob_to_regex(g)))
